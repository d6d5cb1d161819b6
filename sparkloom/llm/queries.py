"""The queries of the corpus problems, each over its whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, institutions, langid, leakage, mojibake, near_duplicates, packing, pii, repeated_lines


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    ref = _read(spark, d, "qs_rankings")
    links = institutions.link_spellings(_read(spark, d, "qise_candidates"), "institution", ref, "qs_id", "institution_name", "country_territory", "city")
    own = ref.select("qs_id", F.col("institution_name").alias("spelling"))
    return links.select("qs_id", "spelling").join(own, ["qs_id", "spelling"], "left_anti").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(_read(spark, d, "extracted_record"), "record_id", "source_name", "raw_text")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    rec = _read(spark, d, "extracted_record")
    lines = repeated_lines.repeated_lines(rec, "record_id", "source_name", "raw_text")
    return repeated_lines.without_lines(rec.select("record_id", "source_name", "raw_text"), "record_id", "raw_text", lines).select("record_id", "source_name", "clean_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    model = langid.train(_read(spark, d, "documents"), "text", "lang")
    rows = _read(spark, d, "qise_candidates").select("candidate_id", "language", "evidence_snippet").where(F.col("evidence_snippet").rlike(r"\S"))
    found = langid.identify_column(rows, "evidence_snippet", model).select("candidate_id", langid.label(F.col("language")).alias("had"), F.col("lang_found.lang").alias("lang"))
    wrong = found.where((F.col("lang") != "und") & (F.col("had").isNull() | (F.col("had") != F.col("lang"))))
    snippets = wrong.select(F.lit("qise_candidates").alias("rec_table"), F.col("candidate_id").alias("rec_id"), F.lit(0).cast("bigint").alias("line_no"), "lang")
    lines = langid.line_languages(_read(spark, d, "extracted_record"), "record_id", "raw_text", model, foreign_only=True)
    return snippets.unionByName(lines.select(F.lit("extracted_record").alias("rec_table"), F.col("record_id").alias("rec_id"), "line_no", "lang"))


def p3_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every snippet, page (line 0) and line of a page with its language and a confidence."""
    model = langid.train(_read(spark, d, "documents"), "text", "lang")
    rows = _read(spark, d, "qise_candidates").select("candidate_id", "evidence_snippet")
    sure = F.round("confidence", 6).alias("confidence")
    snippets = langid.identify_column(rows, "evidence_snippet", model).select(F.lit("qise_candidates").alias("rec_table"), F.col("candidate_id").alias("rec_id"), F.lit(0).cast("bigint").alias("line_no"), "lang_found.lang", "lang_found.confidence")
    lines = langid.line_languages(_read(spark, d, "extracted_record"), "record_id", "raw_text", model, pages=True)
    pages = lines.select(F.lit("extracted_record").alias("rec_table"), F.col("record_id").alias("rec_id"), "line_no", "lang", "confidence")
    return snippets.unionByName(pages).select("rec_table", "rec_id", "line_no", "lang", sure)


def _body_model(rec: DataFrame) -> boilerplate.BodyModel:
    return boilerplate.train(rec, "raw_text", "title", "source_type")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rec = _read(spark, d, "extracted_record")
    return boilerplate.label_lines(rec, "record_id", "raw_text", "title", "source_type", _body_model(rec)).where(~F.col("is_body")).select("record_id", "line_no")


def p4_body(spark: SparkSession, d: str) -> DataFrame:
    rec = _read(spark, d, "extracted_record")
    return boilerplate.body_column(rec.select("record_id", "raw_text", "title", "source_type"), "raw_text", "title", "source_type", _body_model(rec)).select("record_id", "body")


_SPOILT = [("extracted_record", "record_id", "raw_text"), ("qise_candidates", "candidate_id", "evidence_snippet")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (mojibake.spoilt_rows(_read(spark, d, t), i, c).select(F.lit(t).alias("rec_table"), F.col(i).alias("rec_id")) for t, i, c in _SPOILT)
    return a.unionByName(b)


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    """The spoilt pages and snippets with the text as far as it can be restored."""
    parts = []
    for table, key, text in _SPOILT:
        rows = _read(spark, d, table).select(F.lit(table).alias("rec_table"), F.col(key).alias("rec_id"), text).where(F.col(text).rlike(mojibake.QUICK))
        parts.append(mojibake.repair_column(rows, text).where("restored.spoilt").select("rec_table", "rec_id", F.col("restored.text").alias("restored_text"), F.col("restored.complete").alias("complete")))
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = near_duplicates.near_duplicates(_read(spark, d, "qise_candidates"), "candidate_id", "evidence_snippet")
    return near_duplicates.all_pairs(members, links, "candidate_id").select(F.col("a").alias("candidate_id_a"), F.col("b").alias("candidate_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    members, links = near_duplicates.near_duplicates(_read(spark, d, "qise_candidates"), "candidate_id", "evidence_snippet")
    return near_duplicates.groups(members, links, "candidate_id")


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sample = _read(spark, d, "universities_sample").select(
        F.lit("universities_sample").alias("rec_table"), F.col("sample_id").alias("rec_id"), "institution", "country", "country_code", "city", F.array("website", "seed_urls").alias("urls")
    )
    cand = _read(spark, d, "qise_candidates").select(
        F.lit("qise_candidates").alias("rec_table"), F.col("candidate_id").alias("rec_id"), "institution", "country", "country_code", F.lit(None).cast("string").alias("city"), F.array("source_url", "found_on_page").alias("urls")
    )
    return sample, cand


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """With the confidence of each match."""
    sample, cand = _records(spark, d)
    return institutions.match_records(sample.unionByName(cand), _read(spark, d, "qs_rankings"), "qs_id", "institution_name", "country_territory", "city", sample)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).select("qs_id", "rec_table", "rec_id")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_table(_read(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_read(spark, d, "documents"), "doc_id", "text", _read(spark, d, "eval_items"), "item_id", "question").select("doc_id", "item_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that leak nothing."""
    docs = _read(spark, d, "documents").select("doc_id", "text")
    leaks = leakage.find_leaks(docs, "doc_id", "text", _read(spark, d, "eval_items"), "item_id", "question")
    return leakage.remove_leaks(docs, "doc_id", leaks).select("doc_id")


def p9_cut(spark: SparkSession, d: str) -> DataFrame:
    """The documents without the runs that leak; those that are chiefly leaked are left out."""
    return leakage.cut_leaks(_read(spark, d, "documents"), "doc_id", "text", _read(spark, d, "eval_items"), "item_id", "question").select("doc_id", "clean_text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    return pii.find_pii(docs, "doc_id", "text", pii.learn_names(docs, "text")).select("doc_id", "kind", "pii_value").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "text")
    return pii.redact(docs, "text", learnt=pii.learn_names(docs, "text")).select("doc_id", "redacted_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = "p1_found p2_found p2_clean p3_found p3_labels p4_found p4_body p5_found p5_restored p6_found p6_groups p7_found p7_matches p8_pack p9_found p9_clean p9_cut p10_found p10_redacted"
    return {n: globals()[n] for n in names.split()}


_DATE_MONTHS = "|".join(sorted(set(repeated_lines.MONTHS), key=len, reverse=True))
_DAY = r"\d{1,2}(?:er|st|nd|rd|th|º)?"
_DATE = rf"\b{_DAY}\s+(?:de\s+|of\s+)?(?:{_DATE_MONTHS})\b(?:,?\s+(?:de\s+|of\s+)?\d{{4}})?|\b(?:{_DATE_MONTHS})\s+{_DAY}(?:,?\s+\d{{4}})?\b"
_P2_LINES = rf"""
lines as (
  select record_id, source_name, n as line_no, string_split(raw_text, chr(10))[n] as line
  from (select record_id, source_name, raw_text, unnest(range(1, len(string_split(raw_text, chr(10))) + 1)) as n from extracted_record where raw_text is not null and source_name is not null)
), masks as (
  select record_id, source_name, line_no, line, trim(regexp_replace(regexp_replace(regexp_replace(translate(lower(line), '{repeated_lines.ACCENTED}', '{repeated_lines.PLAIN}'), '{_DATE}', '0', 'g'), '\d+(?:\s*[./:,-]\s*\d+)*', '#', 'g'), '[^\p{{L}}#~]+', ' ', 'g')) as mask
  from lines where regexp_matches(line, '\S')
), keys as (
  select record_id, source_name, line_no, case when mask = '' then chr(1) || regexp_replace(line, '\s+', '', 'g') else regexp_replace(regexp_replace(mask, ' +', '', 'g'), '#+', '#', 'g') end as k from masks
), totals as (select source_name, count(*) as records from extracted_record where source_name is not null group by 1
), hot as (
  select source_name, k from keys join totals using (source_name) group by source_name, k, records having count(distinct record_id) >= 5 and count(distinct record_id) >= records * 0.1
)"""


def oracle_sql() -> dict[str, str]:
    p9 = r"""
with w as (select doc_id as id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+') as t from documents where text is not null),
q as (select item_id as id, regexp_extract_all(strip_accents(lower(question)), '[\p{L}\p{N}_]+') as t from eval_items),
wg as (select distinct id, hash(array_to_string(t[i:i+7], ' ')) as g from (select id, t, unnest(range(1, len(t) - 6)) as i from w)),
qg as (select distinct id, hash(array_to_string(t[i:i+7], ' ')) as g from (select id, t, unnest(range(1, len(t) - 6)) as i from q))
select distinct wg.id as doc_id, qg.id as item_id from wg join qg using (g)"""
    return {
        "p2_found": f"with {_P2_LINES} select record_id, line_no from keys join hot using (source_name, k)",
        "p9_found": p9,
        "p9_clean": f"select doc_id from documents where doc_id not in (select doc_id from ({p9}))",
    }
