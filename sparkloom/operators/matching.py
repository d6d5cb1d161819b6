"""Taxonomy matches with offsets, their context and classification.

Which phrases a text holds is one filter over literals; only the (text, phrase) rows that match are exploded, and only
those are searched for offsets, so no cross join of texts and phrases takes place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx


def phrase_pattern(phrase: str) -> str:
    return r"(?U)(?<![\w])" + r"\s+".join(re.escape(t) for t in phrase.split()) + r"(?![\w])"


def with_matches(df: DataFrame, text_col: str, taxonomy=None, keep: int = 20) -> DataFrame:
    """The rows exploded by match: phrase, category, tier, start (0-based), end; the first `keep` occurrences of a phrase.
    Null texts match nothing."""
    taxonomy = taxonomy or lx.TAXONOMY
    table = F.array(*(F.struct(F.lit(i).alias("term_seq"), F.lit(p).alias("phrase"), F.lit(c).alias("category"), F.lit(t).alias("tier"), F.lit(tx.spaced_phrase(p)).alias("s"), F.lit(phrase_pattern(p)).alias("pattern")) for i, (p, c, t) in enumerate(taxonomy)))
    folded = df.where(F.col(text_col).isNotNull()).withColumn("_folded", tx.fold(F.col(text_col)))
    hit = folded.withColumn("_t", F.explode(tx.once(tx.spaced(F.col("_folded")), lambda s: F.filter(table, lambda x: s.contains(x["s"])))))
    found = F.regexp_extract_all(F.col("_folded"), F.col("_t.pattern"), F.lit(0))
    parts = F.split(F.col("_folded"), F.col("_t.pattern"), -1)
    # Offsets: lengths of what stands before, cumulated over parts and matches.
    lengths = F.zip_with(F.slice(parts, 1, keep), F.slice(found, 1, keep), lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("n")))
    start = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, x: F.when(x["n"].isNull() | x["gap"].isNull(), acc).otherwise(F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end")))).alias("out"))),
        lambda acc: acc["out"],
    )
    out = hit.withColumn("_o", F.explode(start))
    return out.select(*df.columns, "_folded", F.col("_t.term_seq").alias("term_seq"), F.col("_t.phrase").alias("phrase"), F.col("_t.category").alias("category"), F.col("_t.tier").alias("tier"), F.col("_o.start").alias("start"), F.col("_o.end").alias("end"))


def specific_over_generic(matches: DataFrame, key: str) -> DataFrame:
    """Generic matches only where a row has no other."""
    from pyspark.sql import Window

    special = F.max((F.col("tier") != "generic").cast("int")).over(Window.partitionBy(key))
    return matches.withColumn("_special", special).where((F.col("_special") == 0) | (F.col("tier") != "generic")).drop("_special")


def window(text: Column, start: Column, end: Column, size: int) -> Column:
    """Up to `size` characters around a match."""
    first = F.greatest(start - size, F.lit(0))
    return F.substring(text, first + 1, end + size - first)


def sentence(text: Column, start: Column, end: Column, reach: int = 250) -> Column:
    """From the last boundary within reach before a match to the first after it."""
    first = F.greatest(start - reach, F.lit(0))
    before = F.regexp_replace(F.substring(text, first + 1, start - first), r"(?s)^.*[.!?\n]", "")
    return F.concat(before, F.substring(text, start + 1, end - start), F.regexp_extract(F.substring(text, end + 1, F.lit(reach)), r"^[^.!?\n]*", 0))


def snippet(text: Column, start: Column, end: Column, reach: int = 140) -> Column:
    """Context of a match, with an ellipsis where it is cut."""
    first, last = F.greatest(start - reach, F.lit(0)), F.least(end + reach, F.length(text))
    body = tx.collapse(F.substring(text, first + 1, last - first))
    return F.concat(F.when(first > 0, "…").otherwise(""), body, F.when(last < F.length(text), "…").otherwise(""))


def heading_like(line: Column) -> Column:
    return (F.length(line).between(3, 90)) & ~line.rlike(r"(?<!\b(?:Dr|Mg|Ing|Lic|Prof|Sr|Sra|No|Nro|vs|etc))\. ") & line.rlike(r"^[\p{Lu}\d]")


def course_title(text: Column, start: Column, end: Column) -> Column:
    """The line of a match if it is like a heading; else the nearest such of the eight lines above; else the line if 3 to 160 characters."""
    trim = lambda c: F.regexp_replace(tx.collapse(c), r"^[ |\t·—-]+|[ |\t·—-]+$", "")
    before = F.substring(text, F.lit(1), start)
    line = trim(F.concat(F.substring_index(before, "\n", -1), F.substring(text, start + 1, end - start), F.regexp_extract(F.substring(text, end + 1, F.lit(400)), r"^[^\n]*", 0)))
    above = F.split(before, "\n")
    above = F.reverse(F.slice(above, F.greatest(F.size(above) - 8, F.lit(1)), F.least(F.greatest(F.size(above) - 1, F.lit(0)), F.lit(8))))
    nearest = F.get(F.filter(F.transform(above, trim), heading_like), F.lit(0))
    return F.when(heading_like(line), line).otherwise(F.coalesce(nearest, F.when(F.length(line).between(3, 160), line), F.lit("")))


def decide(tier, source_type, coarse, strong, weak, noncourse, s_strong, s_noncourse) -> Column:
    """The class of a match; the first rule that holds."""
    formal = source_type.isin("syllabus", "curriculum_grid")
    page = formal | source_type.isin("catalog", "course_list")
    context = (strong >= 1) | page | (weak >= 2)
    return (
        F.when(source_type.isin("news", "social"), "non_course_or_contextual")
        .when((noncourse >= 1) & (strong == 0) & ~formal, "non_course_or_contextual")
        .when((s_noncourse >= 1) & (s_strong == 0), "non_course_or_contextual")
        .when((tier == "core") & coarse, F.when(strong >= 1, "qise_core").otherwise("unclear"))
        .when(tier == "core", F.when(context | (weak >= 1), "qise_core").otherwise("unclear"))
        .when(tier == "adjacent", F.when(context, "quantum_foundations_or_adjacent").otherwise("unclear"))
        .otherwise("unclear")
    )


def confidence(klass, source_type, strong, noncourse) -> Column:
    formal = source_type.isin("syllabus", "curriculum_grid")
    return (
        F.when(klass.isin("qise_core", "quantum_foundations_or_adjacent"), F.when((strong >= 1) | formal, "high").otherwise("medium"))
        .when(klass == "non_course_or_contextual", F.when(noncourse >= 1, "medium").otherwise("low"))
        .otherwise("low")
    )


# Notes of the rows that stand for documents nothing could be extracted from.
NOTES = {
    "needs_manual_review": "PDF opened but little/no extractable text (likely scanned or image-based) — manual review needed.",
    "": "PDF could not be opened by any extraction engine.",
}


def manual_review(fragments: DataFrame, key: str) -> DataFrame:
    """(key, columns of `classify`) of the fragments whose extraction_status isn't 'extracted': unclear, low, with a note."""
    if "extraction_status" not in fragments.columns:
        return fragments.limit(0).select(key)
    has = lambda c: F.col(c) if c in fragments.columns else F.lit("")
    status = F.coalesce("extraction_status", F.lit("extracted"))
    return fragments.where(status != "extracted").select(
        *fragments.columns, F.coalesce(has("academic_level_hint"), F.lit("")).alias("academic_level"), F.coalesce(has("fragment_title"), F.lit("")).alias("title"), F.lit("unclear").alias("classification"), F.lit("low").alias("confidence"),
        F.when(status == "needs_manual_review", NOTES["needs_manual_review"]).otherwise(NOTES[""]).alias("evidence_snippet"), F.concat(F.lit("extraction_status="), status).alias("explanation"),
        F.lit("").alias("phrase"), F.lit("").alias("category"), F.lit("").alias("tier"), F.array().cast("array<string>").alias("matched_keywords"),
    )


def classify(fragments: DataFrame, key: str, taxonomy=None) -> DataFrame:
    """One row a fragment, category and line: class, confidence, level, title, snippet, matched terms, explanation.
    fragments: key, raw_text, source_type, source_url, media_type; coarse, extraction_status, academic_level_hint and fragment_title if
    present. Fragments that could not be extracted come out as unclear with low confidence (`manual_review`)."""
    from pyspark.sql import Window

    cols = fragments.columns
    coarse = F.coalesce(F.col("coarse"), F.lit(False)) if "coarse" in cols else F.lit(False)
    texts = fragments.where(F.col("raw_text").isNotNull() & (F.coalesce("extraction_status", F.lit("extracted")) == "extracted" if "extraction_status" in cols else F.lit(True)))
    raw = F.col("raw_text")
    m = specific_over_generic(with_matches(texts, "raw_text", taxonomy), key)
    folded, start, end = F.col("_folded"), F.col("start"), F.col("end")
    line_before = F.substring_index(F.substring(folded, F.lit(1), start), "\n", -1)
    m = m.where(~line_before.rlike(r"(prerrequisitos?|pre-?requisitos?|prerequisites?)\s*:"))
    m = m.withColumn("title", course_title(F.col("raw_text"), start, end)).withColumn("sentence", sentence(folded, start, end))
    line_key = F.when(F.col("title") != "", tx.fold(F.col("title"))).otherwise(F.col("sentence"))
    w = Window.partitionBy(key, "category", "line_key").orderBy(F.length("phrase").desc(), "term_seq", "start")
    m = m.withColumn("line_key", line_key).withColumn("_n", F.row_number().over(w)).withColumn("matched_keywords", F.array_sort(F.collect_set("phrase").over(Window.partitionBy(key)))).where("_n = 1").drop("_n")
    m = m.withColumn("_w", tx.spaced(window(folded, start, end, 300))).withColumn("_s", tx.spaced(F.col("sentence")))
    counts = [tx.count_terms(F.col(col), words).alias(name) for name, col, words in (("strong", "_w", lx.STRONG), ("weak", "_w", lx.WEAK), ("noncourse", "_w", lx.NONCOURSE), ("s_strong", "_s", lx.STRONG), ("s_noncourse", "_s", lx.NONCOURSE))]
    m = m.select("*", *counts)
    st = F.col("source_type")
    m = m.withColumn("classification", decide(F.col("tier"), st, coarse, F.col("strong"), F.col("weak"), F.col("noncourse"), F.col("s_strong"), F.col("s_noncourse")))
    m = m.withColumn("confidence", confidence(F.col("classification"), st, F.col("strong"), F.col("noncourse")))
    address = F.concat_ws(" ", *(F.col(c) for c in ("source_url", "pdf_url", "found_on_page") if c in cols))
    url_text = F.regexp_replace(F.coalesce(address, F.lit("")), r"[-_/.+%?=&]+", " ")
    hint = F.nullif(F.col("academic_level_hint"), F.lit("")) if "academic_level_hint" in cols else F.lit(None).cast("string")
    level = F.coalesce(F.nullif(tx.academic_level(url_text), F.lit("")), F.nullif(tx.academic_level(window(raw, start, end, 300)), F.lit("")), hint, F.lit("unknown"))
    m = m.withColumn("academic_level", level).withColumn("evidence_snippet", snippet(raw, start, end))
    told = F.format_string("tier=%s cat=%s strong=%d weak=%d noncourse=%d sent_strong=%d sent_noncourse=%d src=%s/%s level=%s → %s/%s", "tier", "category", "strong", "weak", "noncourse", "s_strong", "s_noncourse", F.coalesce("source_type", F.lit("")), F.coalesce("media_type", F.lit("")), "academic_level", "classification", "confidence")
    m = m.withColumn("explanation", told).drop("_folded", "_w", "_s")
    return m.unionByName(manual_review(fragments, key), allowMissingColumns=True) if "extraction_status" in cols else m


#: The columns of an output row, in order.
OUTPUT = (
    "timestamp institution country country_code classification confidence is_qise_core academic_level semantic_category keyword_tier matched_keyword matched_keywords course_title evidence_snippet "
    "source_type media_type source_url pdf_url pdf_page found_on_page seed_origin extraction_status language"
).split()


def to_rows(candidates: DataFrame, timestamp: Column) -> DataFrame:
    """Candidates as output rows of 23 columns: empty for null, titles cut at 200 characters, snippets at 400 between words."""
    has = lambda c, default="": F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in candidates.columns else F.lit(default)
    klass = has("classification", "unclear")
    keywords = F.array_join(F.coalesce("matched_keywords", F.array().cast("array<string>")), "|") if "matched_keywords" in candidates.columns else F.lit("")
    made = {
        "timestamp": timestamp, "classification": klass, "confidence": has("confidence", "low"), "is_qise_core": klass == "qise_core", "academic_level": F.coalesce(F.nullif(has("academic_level"), F.lit("")), F.lit("unknown")),
        "semantic_category": has("category"), "keyword_tier": has("tier"), "matched_keyword": has("phrase"), "matched_keywords": keywords, "course_title": F.substring(has("title"), 1, 200),
        "evidence_snippet": tx.truncate_words(has("evidence_snippet"), 400), "pdf_page": F.col("pdf_page").cast("int") if "pdf_page" in candidates.columns else F.lit(None).cast("int"), "extraction_status": has("extraction_status", "extracted"),
    }
    return candidates.select(*(made.get(c, has(c)).alias(c) for c in OUTPUT))
