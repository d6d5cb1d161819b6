"""Roll-ups of output rows: by institution, by country, histograms and the run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_institution(rows: DataFrame, seq: str) -> DataFrame:
    """Counts by class; country and code are those of the institution's first row."""
    c = F.col("classification")
    named = c.isin("qise_core", "quantum_foundations_or_adjacent", "unclear")
    return rows.groupBy(F.col("institution").alias("university")).agg(
        F.min_by("country", seq).alias("country"),
        F.min_by("country_code", seq).alias("country_code"),
        F.count_if(c == "qise_core").alias("qise_core"),
        F.count_if(c == "quantum_foundations_or_adjacent").alias("adjacent"),
        F.count_if(c == "unclear").alias("unclear"),
        F.count_if(~F.coalesce(named, F.lit(False))).alias("non_course"),
        F.count("*").alias("total"),
    )


def by_country(institutions: DataFrame) -> DataFrame:
    """Second level over the first; an institution counts under its own country alone."""
    sums = [F.sum(x).alias(x) for x in ("qise_core", "adjacent", "unclear", "non_course", "total")]
    return institutions.groupBy(F.coalesce("country_code", F.lit("")).alias("country_code")).agg(*sums, F.count("*").alias("universities"))


def histogram(rows: DataFrame, column: str, default: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default)).alias(column)).agg(F.count("*").alias("n"))


def run_summary(rows: DataFrame) -> DataFrame:
    """One row of totals."""
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("media_type") == "pdf").alias("pdf_rows"),
        F.count_if(F.col("extraction_status") != "extracted").alias("manual_review"),
        F.count_if("is_qise_core").alias("core_rows"),
        F.count_distinct("institution").alias("institutions"),
        F.count_distinct(F.when(F.col("media_type") == "pdf", F.col("source_url"))).alias("pdf_documents"),
    )


def university_summary(rows: DataFrame, seq: str) -> DataFrame:
    """By institution, most core rows first, ties as first seen."""
    first = rows.groupBy(F.col("institution").alias("university")).agg(F.min(seq).alias("_first"))
    out = by_institution(rows, seq).alias("a").join(first.alias("b"), F.col("a.university").eqNullSafe(F.col("b.university"))).orderBy(F.desc("qise_core"), "_first")
    return out.select("a.university", "country", "country_code", "qise_core", "adjacent", "unclear", "non_course", "total")


def country_summary(institutions: DataFrame) -> DataFrame:
    """By country, most core rows first: the sums, and the sorted names of its institutions joined by ' | '. Names are those of different
    institutions, as many as a country has."""
    sums = [F.sum(x).alias(x) for x in ("qise_core", "adjacent", "unclear", "non_course", "total")]
    names = F.array_join(F.array_sort(F.collect_set("university")), " | ").alias("universities")
    return institutions.groupBy(F.coalesce("country_code", F.lit("")).alias("country_code")).agg(F.min("country").alias("country"), *sums, names).orderBy(F.desc("qise_core"), "country_code")


def unique_core_courses(rows: DataFrame, seq: str) -> DataFrame:
    """The first core row of each exact title that isn't empty."""
    from .dedupe import keep_first

    return keep_first(rows.where((F.col("classification") == "qise_core") & (F.col("course_title") != "")), ["course_title"], seq)


def by_country_code(rows: DataFrame) -> DataFrame:
    """Rows, core rows, institutions and the sorted institutions with core rows, a country; no code counts as '??'."""
    code = F.coalesce(F.nullif(F.col("country_code"), F.lit("")), F.lit("??")).alias("country_code")
    core = F.col("classification") == "qise_core"
    return rows.groupBy(code).agg(F.count("*").alias("rows"), F.count_if(core).alias("core_rows"), F.count_distinct("institution").alias("institutions"), F.array_sort(F.collect_set(F.when(core, F.col("institution")))).alias("core_institutions"))


def crawl_totals(stats: DataFrame, counters: list[str]) -> DataFrame:
    """Sums of the counters over institutions; a missing one counts 0."""
    return stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters))
