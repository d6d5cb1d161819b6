"""Queries of the engine's operators, each over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..functions import urls
from ..operators import dedupe, essays, matching, rollup, seeds, stats
from ..sources import html, loaders

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# SQL pieces that stand for column functions.
def s_fold(c: str) -> str:
    return f"lower(translate({c}, '{tx.ACCENTED}', '{tx.PLAIN}'))"


def s_spaced(c: str) -> str:
    return rf"(' ' || trim(regexp_replace(regexp_replace({c}, '([^\p{{L}}\p{{N}}_\s])', ' \1 ', 'g'), '\s+', ' ', 'g')) || ' ')"


def s_count(c: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({c}, '{tx.spaced_phrase(x)}')::int" for x in terms) + ")"


def s_any(c: str, terms: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, '{tx.spaced_phrase(x)}')" for x in terms) + ")"


def s_sub(c: str, parts: list[str], count: bool = False) -> str:
    return "(" + (" + " if count else " or ").join(f"contains({c}, '{x}')" + ("::int" if count else "") for x in parts) + ")"


# --- the flagship: fragments -> matches -> classes -> best rows -> institutions -----------------------------------


def fragments(spark: SparkSession, d: str) -> DataFrame:
    r = t(spark, d, "extracted_record")
    kind = F.when(F.col("source_type") == "news", "news").otherwise(tx.source_type_rules(F.col("url"), F.col("raw_text"), F.col("source_type") == "pdf"))
    return r.select("record_id", "raw_text", F.col("source_name").alias("institution"), "country", "country_code", F.col("url").alias("source_url"), kind.alias("source_type"), F.when(F.col("source_type") == "pdf", "pdf").otherwise("html").alias("media_type"))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return matching.classify(fragments(spark, d), "record_id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    rows = classified(spark, d).withColumn("rank", dedupe.confidence_rank(F.col("confidence"))).withColumn("title_key", tx.title_key(F.col("title")))
    best = dedupe.keep_best(rows.select("source_url", "category", "title_key", "rank", "record_id", "institution", "country", "country_code", "classification"), ["source_url", "category", "title_key"], "rank", "record_id")
    return rollup.by_institution(best, "record_id")


@query()
def evidence_by_institution(spark, d):
    return flagship(spark, d)


@query()
def classify_fragments(spark, d):
    return classified(spark, d).select("record_id", "category", "tier", "phrase", "start", "title", "classification", "confidence", "academic_level", "evidence_snippet")


# --- matching ----------------------------------------------------------------------------------------------------

_TERMS = "(values " + ", ".join(f"('{tx.spaced_phrase(p)}', '{p}', '{c}', '{k}')" for p, c, k in lx.TAXONOMY) + ") as x(s, phrase, category, tier)"


@query(f"with r as (select record_id, {s_spaced(s_fold('raw_text'))} as f from extracted_record where raw_text is not null) select record_id, phrase, category, tier from r join {_TERMS} on contains(f, s)")
def term_match_theta(spark, d):
    """Which phrases each text holds."""
    table = F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(c).alias("category"), F.lit(k).alias("tier"), F.lit(tx.spaced_phrase(p)).alias("s")) for p, c, k in lx.TAXONOMY))
    held = tx.once(tx.spaced(tx.fold(F.col("raw_text"))), lambda f: F.filter(table, lambda x: f.contains(x["s"])))
    r = t(spark, d, "extracted_record").where(F.col("raw_text").isNotNull())
    return r.select("record_id", F.explode(held).alias("x")).select("record_id", "x.phrase", "x.category", "x.tier")


@query(f"""with r as (select record_id, {s_spaced(s_fold('raw_text'))} as f from extracted_record where raw_text is not null), m as (select record_id, phrase, tier from r join {_TERMS} on contains(f, s)),
k as (select *, max((tier <> 'generic')::int) over (partition by record_id) as special from m) select record_id, phrase, tier from k where special = 0 or tier <> 'generic'""")
def specific_over_generic(spark, d):
    return matching.specific_over_generic(term_match_theta(spark, d), "record_id").select("record_id", "phrase", "tier")


@query(f"""with r as (select record_id, {s_spaced(s_fold('raw_text'))} as f from extracted_record where raw_text is not null)
select record_id, {s_count('f', lx.STRONG)}::int as strong, {s_count('f', lx.WEAK)}::int as weak, {s_count('f', lx.NONCOURSE)}::int as noncourse from r""")
def lexicon_count(spark, d):
    r = t(spark, d, "extracted_record").where(F.col("raw_text").isNotNull()).select("record_id", tx.spaced(tx.fold(F.col("raw_text"))).alias("f"))
    return r.select("record_id", tx.count_terms(F.col("f"), lx.STRONG).alias("strong"), tx.count_terms(F.col("f"), lx.WEAK).alias("weak"), tx.count_terms(F.col("f"), lx.NONCOURSE).alias("noncourse"))


@query()
def match_offsets(spark, d):
    """Occurrences with their places in the text."""
    m = matching.with_matches(t(spark, d, "extracted_record").select("record_id", "raw_text"), "raw_text")
    return m.select("record_id", "phrase", "start", "end", F.substring("raw_text", F.col("start") + 1, F.col("end") - F.col("start")).alias("surface"))


@query("""select candidate_id, case when source_type in ('news', 'social') then 'non_course_or_contextual' when n >= 1 and s = 0 and not formal then 'non_course_or_contextual'
 when keyword_tier = 'core' then case when s >= 1 or page or w >= 2 or w >= 1 then 'qise_core' else 'unclear' end
 when keyword_tier = 'adjacent' then case when s >= 1 or page or w >= 2 then 'quantum_foundations_or_adjacent' else 'unclear' end else 'unclear' end as klass
from (select candidate_id, coalesce(source_type, '') as source_type, coalesce(keyword_tier, '') as keyword_tier, coalesce(source_type, '') in ('syllabus', 'curriculum_grid') as formal, coalesce(source_type, '') in ('syllabus', 'curriculum_grid', 'catalog', 'course_list') as page, """
 + ", ".join(f"{s_count('f', words)} as {n}" for n, words in (("s", lx.STRONG), ("w", lx.WEAK), ("n", lx.NONCOURSE))) + f" from (select *, {s_spaced(s_fold('coalesce(evidence_snippet, chr(32))'))} as f from qise_candidates))")
def classify_rules(spark, d):
    """The class rules over whole snippets."""
    c = t(spark, d, "qise_candidates").select("candidate_id", F.coalesce("source_type", F.lit("")).alias("st"), F.coalesce("keyword_tier", F.lit("")).alias("tier"), tx.spaced(tx.fold(F.coalesce("evidence_snippet", F.lit(" ")))).alias("f"))
    s, w, n = (tx.count_terms(F.col("f"), x) for x in (lx.STRONG, lx.WEAK, lx.NONCOURSE))
    zero = F.lit(0)
    return c.select("candidate_id", matching.decide(F.col("tier"), F.col("st"), F.lit(False), s, w, n, zero, zero).alias("klass"))


@query(f"""select candidate_id, case when classification in ('qise_core', 'quantum_foundations_or_adjacent') then case when s >= 1 or source_type in ('syllabus', 'curriculum_grid') then 'high' else 'medium' end
 when classification = 'non_course_or_contextual' then case when n >= 1 then 'medium' else 'low' end else 'low' end as conf
from (select *, {s_count('f', lx.STRONG)} as s, {s_count('f', lx.NONCOURSE)} as n from (select *, {s_spaced(s_fold('coalesce(evidence_snippet, chr(32))'))} as f from qise_candidates))""")
def confidence_rules(spark, d):
    c = t(spark, d, "qise_candidates").withColumn("f", tx.spaced(tx.fold(F.coalesce("evidence_snippet", F.lit(" ")))))
    return c.select("candidate_id", matching.confidence(F.col("classification"), F.col("source_type"), tx.count_terms(F.col("f"), lx.STRONG), tx.count_terms(F.col("f"), lx.NONCOURSE)).alias("conf"))


@query(f"""select candidate_id, case when u and not p then 'undergraduate' when p and not u then 'graduate' else '' end as level from (select candidate_id, coalesce({s_any('f', lx.UNDERGRAD)}, false) as u, coalesce({s_any('f', lx.POSTGRAD)}, false) as p
from (select candidate_id, {s_spaced(s_fold('evidence_snippet'))} as f from qise_candidates))""")
def level_rules(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", tx.academic_level(F.col("evidence_snippet")).alias("level"))


_M = lx.LANGUAGE_MARKERS


@query(f"""select candidate_id, case when evidence_snippet is null or evidence_snippet = '' then 'unknown' when (en >= 2 or te >= 2) and es = 0 and pt = 0 then 'en' when greatest(es, pt, en) = 0 then 'unknown'
 when es = pt and {s_sub('f', _M['pt_only'])} then 'pt' when es = pt and {s_sub('f', _M['es_only'])} then 'es' when es = pt and te >= 2 then 'es'
 when (es = greatest(es, pt, en))::int + (pt = greatest(es, pt, en))::int + (en = greatest(es, pt, en))::int > 1 then 'unknown' when es = greatest(es, pt, en) then 'es' when pt = greatest(es, pt, en) then 'pt' else 'en' end as lang
from (select *, {s_sub('f', _M['es'], True)} as es, {s_sub('f', _M['pt'], True)} as pt, {s_sub('f', _M['en'], True)} as en, {s_sub('f', _M['technical'], True)} as te from (select *, {s_fold('evidence_snippet')} as f from qise_candidates))""")
def language_rules(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", tx.language_rules(F.col("evidence_snippet")).alias("lang"))


@query("select record_id, case " + " ".join(f"when {s_sub('f', parts)} then '{n}'" for n, parts in lx.SOURCE_TYPES) + f" when source_type = 'pdf' then 'pdf' else 'html_page' end as kind from (select *, {s_fold('(coalesce(url, chr(32)) || chr(32) || substring(coalesce(raw_text, chr(32)), 1, 1500))')} as f from extracted_record)")
def source_type_rules(spark, d):
    r = t(spark, d, "extracted_record")
    return r.select("record_id", tx.source_type_rules(F.coalesce("url", F.lit(" ")), F.coalesce("raw_text", F.lit(" ")), F.col("source_type") == "pdf").alias("kind"))


# --- text and addresses --------------------------------------------------------------------------------------------


@query(f"select doc_id, {s_fold('text')} as folded from documents")
def fold_text(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.fold(F.col("text")).alias("folded"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '&[a-zA-Z]+;|&#\d+;', ' ', 'g'), 'https?://\S+', ' ', 'g'), '\S+@\S+\.\S+', ' ', 'g'), '(?i)p[áa]gina\s+\d+\s+de\s+\d+', ' ', 'g'), '(?i)page\s+\d+\s+of\s+\d+', ' ', 'g'), '\s+', ' ', 'g')) as clean from documents""")
def clean_text(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.clean_course_text(F.col("text")).alias("clean"))


@query(f"select candidate_id, nullif(upper(regexp_extract(evidence_snippet, '{tx.COURSE_CODE}', 1)), '') as code from qise_candidates")
def course_code(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", tx.course_code(F.col("evidence_snippet")).alias("code"))


@query(rf"select candidate_id, regexp_replace(trim(regexp_replace({s_fold('institution')}, '[^a-z0-9_\s-]', '', 'g')), '[\s_-]+', '_', 'g') as slug from qise_candidates")
def slugify(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", tx.slugify(F.col("institution")).alias("slug"))


@query(r"select doc_id, case when length(text) <= 400 then text else (case when length(regexp_replace(substring(text, 1, 400), '(?s) [^ ]*$', '')) > 0 then regexp_replace(substring(text, 1, 400), '(?s) [^ ]*$', '') else substring(text, 1, 400) end) || '…' end as short from documents")
def truncate_words(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.truncate_words(F.col("text"), 400).alias("short"))


@query(rf"select candidate_id, trim(regexp_replace(regexp_replace(trim(regexp_replace({s_fold('course_title')}, '\s+', ' ', 'g')), '^[a-z]{{1,4}}[- ]?\d{{2,4}}[a-z]?\b[\s.:–—-]*', ''), '\s+', ' ', 'g')) as title_key from qise_candidates")
def title_key(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", tx.title_key(F.col("course_title")).alias("title_key"))


@query("select candidate_id, left(md5(source_url), 12) as k from qise_candidates")
def md5_key(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", urls.url_hash(F.col("source_url")).alias("k"))


@query("select candidate_id, case " + " ".join(f"when f = '{n}' then '{c}'" for n, c in lx.COUNTRIES.items()) + " when upper(f) in (" + ", ".join(f"'{c}'" for c in sorted(set(lx.COUNTRIES.values()))) + rf") then upper(f) end as code from (select candidate_id, trim(regexp_replace({s_fold('country')}, '[^a-z0-9]+', ' ', 'g')) as f from qise_candidates)")
def country_code_lookup(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", tx.country_code(F.col("country")).alias("code"))


_HOST = r"lower(regexp_extract(source_url, '^[a-zA-Z]+://(?:[^@/?#]*@)?([^:/?#]+)', 1))"


@query(rf"with h as (select candidate_id, {_HOST} as h from qise_candidates), p as (select candidate_id, h, string_split(h, '.') as a from h) select candidate_id, case when len(a) <= 2 then h when regexp_matches(h, '\.(edu|com|org|net|gob|gov|mil|ac)\.[a-z]{{2}}$') then array_to_string(a[-3:], '.') else array_to_string(a[-2:], '.') end as domain from p")
def url_registered_domain(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", urls.registered_domain(urls.host(F.col("source_url"))).alias("domain"))


@query(rf"select candidate_id, {_HOST} = 'itve.edu.pe.example' or ends_with({_HOST}, '.itve.edu.pe.example') as inside from qise_candidates")
def url_scope(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", urls.in_scope(F.col("source_url"), F.lit("itve.edu.pe.example")).alias("inside"))


@query(r"select candidate_id, regexp_matches(regexp_extract(u, '^[a-z]+://[^/]+([^?]*)', 1), '\.pdf$') or regexp_matches(u, '\.pdf(\?|$)') as is_pdf from (select candidate_id, regexp_replace(lower(source_url), '#.*$', '') as u from qise_candidates)")
def url_pdf_like(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", urls.looks_like_pdf(F.col("source_url")).alias("is_pdf"))


@query()
def url_tracking_params(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", urls.without_tracking(F.col("source_url")).alias("url"))


_SEED = f"""select sample_id, seed_url, 3 * least(au, 3) + 2 * least(st, 3) + (case when au > 0 and st > 0 then 4 else 0 end) + (case when cu then 5 else 0 end) + (case when pdf then 2 else 0 end) - 5 * lo as score from (
 select sample_id, seed_url, {s_count('f', lx.ACADEMIC)} as au, {s_count('f', lx.STEM)} as st, {s_count('f', lx.LOW_PRIORITY)} as lo, regexp_matches({s_fold('seed_url')}, '{lx.CURRICULUM_URL.replace('(?<![a-z])', '(?:^|[^a-z])')}') as cu, regexp_matches(lower(seed_url), '\\.pdf(\\?|$)') as pdf
 from (select sample_id, seed_url, {s_spaced(s_fold("regexp_replace(seed_url, '[-_/.+?=&%]+', ' ', 'g')"))} as f from (select sample_id, trim(unnest(string_split_regex(seed_urls, '[;|]'))) as seed_url from universities_sample where seed_urls is not null) where seed_url like 'http%'))"""


def _seeds(spark, d):
    s = t(spark, d, "universities_sample").where(F.col("seed_urls").isNotNull()).select("sample_id", F.explode(F.split("seed_urls", "[;|]")).alias("u")).select("sample_id", F.trim("u").alias("seed_url")).where(F.col("seed_url").startswith("http"))
    return s.select("sample_id", "seed_url", seeds.seed_score(F.col("seed_url"), F.lit(""), F.lit(False)).alias("score"))


@query(f"select sample_id, seed_url, score::int as score from ({_SEED})")
def seed_score(spark, d):
    return _seeds(spark, d)


@query(f"select sample_id, seed_url, score::int as score from (select *, row_number() over (partition by sample_id order by score desc, seed_url) as n from ({_SEED}) where score >= 3) where n <= 20")
def seed_topk(spark, d):
    return seeds.top_seeds(_seeds(spark, d), "sample_id")


@query()
def link_priority(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", seeds.link_priority(F.col("source_url"), F.col("course_title")).alias("priority"))


@query("with recursive e as (select distinct found_on_page as src, source_url as dst from qise_candidates where found_on_page is not null and source_url is not null), w as (select distinct src as url, 0 as depth from e union select e.dst, 1 from e join w on w.url = e.src and w.depth = 0) select url, min(depth)::int as depth from w group by url")
def link_graph_bfs(spark, d):
    e = t(spark, d, "qise_candidates").where(F.col("found_on_page").isNotNull() & F.col("source_url").isNotNull()).select(F.col("found_on_page").alias("src"), F.col("source_url").alias("dst")).distinct()
    return seeds.link_waves(e, e.select(F.col("src").alias("url")).distinct(), 1)


@query()
def html_extract(spark, d):
    """Fragments of pages built from the candidates with their whole snippets: by turns a table, course blocks, and neither."""
    c = t(spark, d, "qise_candidates").where(F.col("evidence_snippet").isNotNull())
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title, text = escaped(F.coalesce("course_title", F.lit("-"))), escaped(F.col("evidence_snippet"))
    table = F.concat(F.lit("<table><tr><th>a</th></tr><tr><td>"), title, F.lit("</td><td>"), text, F.lit("</td></tr></table>"))
    blocks = F.concat(F.lit("<div class='curso'><h2>"), title, F.lit("</h2><p>"), text, F.lit("</p></div>"))
    plain = F.concat(F.lit("<p>"), title, F.lit("</p><p>"), text, F.lit("</p>"))
    turn = F.pmod("candidate_id", F.lit(3))
    page = F.concat(F.lit("<html><title>x</title><nav>menu</nav>"), F.when(turn == 0, table).when(turn == 1, blocks).otherwise(plain), F.lit("</html>"))
    return html.html_fragments(c.select(F.concat_ws("#", "source_url", F.col("candidate_id").cast("string")).alias("u"), page.alias("h")), "u", "h")


# --- relations -----------------------------------------------------------------------------------------------------


@query("select c_custkey, c_mktsegment from customer where lower(trim(c_mktsegment)) = 'building' or c_nationkey = 7")
def filter_segment_or_code(spark, d):
    return t(spark, d, "customer").where((F.lower(F.trim("c_mktsegment")) == "building") | (F.col("c_nationkey") == 7)).select("c_custkey", "c_mktsegment")


@query("select candidate_id, (case confidence when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end)::int as conf_rank from qise_candidates")
def project_casewhen_confidence(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", dedupe.confidence_rank(F.col("confidence")).alias("conf_rank"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')")
def anti_resume(spark, d):
    done = t(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def semi_membership(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def dim_left_chain(spark, d):
    c, n, r = (t(spark, d, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query("""with o as (select o_orderpriority as p, count(*) n from orders where o_orderstatus = 'O' group by 1), f as (select o_orderpriority as p, count(*) n from orders where o_orderstatus = 'F' group by 1)
select coalesce(o.p, f.p) as priority, coalesce(o.n, 0) as open_n, coalesce(f.n, 0) as filled_n from o full join f on o.p = f.p""")
def full_outer_concat_fill0(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"))
    return o.agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_n"), F.count_if(F.col("o_orderstatus") == "F").alias("filled_n"))


@query("select source_name as university, count(*) filter (source_type = 'web') as web, count(*) filter (source_type = 'pdf') as pdf, count(*) as total from extracted_record group by 1")
def cond_count_rollup(spark, d):
    st = F.col("source_type")
    return t(spark, d, "extracted_record").groupBy(F.col("source_name").alias("university")).agg(F.count_if(st == "web").alias("web"), F.count_if(st == "pdf").alias("pdf"), F.count("*").alias("total"))


_INST = """select institution as university, arg_min(country_code, candidate_id) as country_code, count(*) filter (classification = 'qise_core') as qise_core, count(*) filter (classification = 'quantum_foundations_or_adjacent') as adjacent, count(*) filter (classification = 'unclear') as unclear,
count(*) filter (not coalesce(classification in ('qise_core', 'quantum_foundations_or_adjacent', 'unclear'), false)) as non_course, count(*) as total from (select * replace (coalesce(country_code, '') as country_code) from qise_candidates) group by 1"""


def _institutions(spark, d):
    return rollup.by_institution(t(spark, d, "qise_candidates").withColumn("country_code", F.coalesce("country_code", F.lit(""))), "candidate_id").drop("country")


@query(_INST)
def rollup_by_institution(spark, d):
    return _institutions(spark, d)


@query(f"select country_code, sum(qise_core)::bigint as qise_core, sum(adjacent)::bigint as adjacent, sum(unclear)::bigint as unclear, sum(non_course)::bigint as non_course, sum(total)::bigint as total, count(*) as universities from ({_INST}) group by 1")
def two_level_rollup(spark, d):
    return rollup.by_country(_institutions(spark, d))


@query(f"select count(*) filter (qise_core > 0) as n from ({_INST})")
def having_count(spark, d):
    return _institutions(spark, d).agg(F.count_if(F.col("qise_core") > 0).alias("n"))


@query("select coalesce(nullif(classification, ''), 'unclear') as classification, count(*) as n from qise_candidates group by 1")
def histogram_default_bucket(spark, d):
    return rollup.histogram(t(spark, d, "qise_candidates"), "classification", "unclear")


@query("""select count(*) as rows, count(*) filter (media_type = 'pdf') as pdf_rows, count(*) filter (extraction_status <> 'extracted') as manual_review, count(*) filter (is_qise_core) as core_rows,
count(distinct institution) as institutions, count(distinct case when media_type = 'pdf' then source_url end) as pdf_documents from qise_candidates""")
def run_summary(spark, d):
    return rollup.run_summary(t(spark, d, "qise_candidates"))


@query("select r_name, string_agg(n_name, ' | ' order by n_name) as names from nation join region on n_regionkey = r_regionkey group by 1")
def listagg_names(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), " | ").alias("names"))


@query("select event_type, count(distinct case when value > 50 then user_id end) as users from events group by 1")
def count_distinct_where(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("users"))


_QS = " ".join(f"when f = '{n}' then '{c}'" for n, c in lx.COUNTRIES.items()) + " when upper(f) in (" + ", ".join(f"'{c}'" for c in sorted(set(lx.COUNTRIES.values()))) + ") then upper(f)"
_RANKS = rf"""with f as (select qs_id as rank, trim(institution_name) as name, trim(regexp_replace({s_fold('country_territory')}, '[^a-z0-9]+', ' ', 'g')) as f from qs_rankings), c as (select rank, name, case {_QS} end as code from f),
v as (select * from (select *, row_number() over (partition by code, regexp_replace({s_fold('name')}, '[^a-z0-9]+', ' ', 'g') order by rank) as n from c where code is not null and name <> '') where n = 1)"""


@query(f"{_RANKS} select code as country_code, min(rank) as qs_top_rank, arg_min(name, rank) as qs_top_university, count(*) as qs_universities_in_ranking from v group by 1")
def argmin_with_tiebreak(spark, d):
    return loaders.ranking_by_country(loaders.valid_ranking(t(spark, d, "qs_rankings"), "qs_id", "institution_name", "country_territory"))


@query(f"{_RANKS}, g as (select code, min(rank) as qs_top_rank from v group by 1) select c.code as country_code, qs_top_rank from (select distinct upper(trim(country_code)) as code from qise_candidates where regexp_matches(upper(trim(country_code)), '^[A-Z]{{2}}$')) c left join g using (code)")
def geo_enrichment(spark, d):
    codes = t(spark, d, "qise_candidates").select(F.upper(F.trim("country_code")).alias("country_code"))
    qs = argmin_with_tiebreak(spark, d).select("country_code", "qs_top_rank")
    return loaders.enrich_countries(codes, qs)


@query("select institution as name, count(*) as n from universities_sample where trim(institution) <> '' group by 1")
def institution_names(spark, d):
    return t(spark, d, "universities_sample").where(F.trim("institution") != "").groupBy(F.col("institution").alias("name")).agg(F.count("*").alias("n"))


@query()
def load_institutions(spark, d):
    s = t(spark, d, "universities_sample").select("institution", "country", F.col("country_code").alias("country code"), "website", "seed_urls", "language", F.col("max_depth").alias("max depth"), F.col("max_pages").alias("max pages"))
    return loaders.institutions_from(s)


@query("select o_orderpriority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1")
def crosstab_counts(spark, d):
    return t(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0).select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("select o_orderpriority, o_orderstatus, n, round(pct, 6) as pct from (select o_orderpriority, o_orderstatus, count(*) as n, count(*) * 100.0::double / sum(count(*)) over (partition by o_orderpriority) as pct from orders group by 1, 2)")
def crosstab_row_pct(spark, d):
    return stats.crosstab_share(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus").withColumn("pct", F.round("pct", 6))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice), 2) as price, count(*) as n from lineitem group by 1, 2")
def multi_measure_group_sum(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("*").alias("n"))


_BEST = "select user_id, event_type, event_id, round(value, 4) as value from (select *, row_number() over (partition by user_id, event_type order by value desc nulls last, event_id {}) as n from events) where n = 1"


@query(_BEST.format("asc"))
def keep_best_first(spark, d):
    return dedupe.keep_best(t(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "value", "event_id").withColumn("value", F.round("value", 4))


@query(_BEST.format("desc"))
def keep_best_last(spark, d):
    return dedupe.keep_best(t(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "value", "event_id", latest=True).withColumn("value", F.round("value", 4))


@query("select institution, min(candidate_id) as candidate_id from qise_candidates group by 1")
def keep_first_distinct(spark, d):
    return dedupe.keep_first(t(spark, d, "qise_candidates").select("institution", "candidate_id"), ["institution"], "candidate_id").select("institution", "candidate_id")


@query("select l_orderkey, l_linenumber, round(l_extendedprice, 2) as price from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as n from lineitem) where n <= 2")
def topk_per_group(spark, d):
    return dedupe.top_k(t(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber")], 2).select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"))


@query("select source_name, count(*) as n from extracted_record group by 1 order by n desc, source_name limit 7")
def head_n_tiebreak(spark, d):
    return t(spark, d, "extracted_record").groupBy("source_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_name").limit(7)


@query("select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between 8 preceding and 1 preceding) as last_signup from events")
def last_heading_lookback(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-8, -1)
    return t(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("last_signup"))


@query("select institution from universities_sample where institution is not null except select institution from qise_candidates")
def except_terms(spark, d):
    return t(spark, d, "universities_sample").select("institution").where(F.col("institution").isNotNull()).distinct().join(t(spark, d, "qise_candidates").select("institution"), "institution", "left_anti")


@query("select institution, country, 'sample' as origin from universities_sample union all select institution, country, 'candidate' from qise_candidates")
def union_by_name_merge(spark, d):
    a = t(spark, d, "universities_sample").select("institution", "country", F.lit("sample").alias("origin"))
    return a.unionByName(t(spark, d, "qise_candidates").select("country", "institution", F.lit("candidate").alias("origin")))


@query("select event_id, json_extract_string(props, '$.page') as page from events")
def json_prop(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"))


# --- statistics ----------------------------------------------------------------------------------------------------


@query("select round(corr((is_qise_core)::int::double, (media_type = 'pdf')::int::double), 9) as phi from qise_candidates")
def phi_correlation(spark, d):
    c = t(spark, d, "qise_candidates").select(F.col("is_qise_core").cast("int").alias("a"), (F.col("media_type") == "pdf").cast("int").alias("b"))
    return stats.phi(c, "a", "b").select(F.round("phi", 9).alias("phi"))


@query("""with q as (select count(*) filter (x and y)::double a, count(*) filter (x and not y)::double b, count(*) filter (not x and y)::double c, count(*) filter (not x and not y)::double d from (select is_qise_core as x, media_type = 'pdf' as y from qise_candidates))
select a + b + c + d as n, round((a + b + c + d) * pow(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 6) as chi2 from q""")
def yates_chi2_stat(spark, d):
    c = t(spark, d, "qise_candidates").select("is_qise_core", (F.col("media_type") == "pdf").alias("pdf"))
    return stats.chi_square_yates(c, "is_qise_core", "pdf").select("n", F.round("chi2", 6).alias("chi2"))


@query("select l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over (), 6) as z_l_quantity from lineitem")
def zscore_population(spark, d):
    return stats.zscore(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity")), ["l_quantity"]).select("l_orderkey", "l_linenumber", F.round("z_l_quantity", 6).alias("z_l_quantity"))


@query()
def kmeans_profiles(spark, d):
    e = t(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("x"))
    c, _ = stats.kmeans(stats.zscore(e, ["q", "x"]), ["z_q", "z_x"], 3)
    return c.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("q").alias("q"), F.avg("x").alias("x"))


@query()
def logit_pvalues(spark, d):
    c = t(spark, d, "qise_candidates").select(F.col("is_qise_core").cast("double").alias("y"), (F.col("media_type") == "pdf").cast("double").alias("pdf"), (F.col("confidence") == "high").cast("double").alias("high")).dropna()
    return stats.logistic(c, "y", ["pdf", "high"])


_TOK = rf"list_filter(regexp_split_to_array({s_fold('text')}, '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"


@query(f"with w as (select {_TOK} as t from documents where text is not null) select term, count(*) as frequency from (select unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as term from w where len(t) >= 2) group by 1")
def ngram_freq(spark, d):
    return essays.ngram_frequency(t(spark, d, "documents").where(F.col("text").isNotNull()), "text", 2)


@query(f"""with w as (select doc_id, {_TOK} as t from documents where text is not null), n as (select count(*) as n from w where len(t) > 0), e as (select doc_id, len(t) as size, unnest(t) as term from w),
f as (select doc_id, term, count(*)::double / any_value(size) as tf from e group by 1, 2) select term, round(sum(tf) * ln(any_value(n)::double / count(*)) / any_value(n), 8) as tfidf_score from f, n group by term""")
def tfidf(spark, d):
    return essays.tf_idf(t(spark, d, "documents"), "doc_id", "text").withColumn("tfidf_score", F.round("tfidf_score", 8))


@query(f"""select doc_id, len(t)::int as word_count, len(list_distinct(t))::int as unique_words, round(len(list_distinct(t))::double / len(t), 4) as lexical_diversity from (select doc_id, {_TOK} as t from documents where text is not null)""")
def lexical_features(spark, d):
    return essays.lexical_features(t(spark, d, "documents").where(F.col("text").isNotNull()), "doc_id", "text", ["quantum", "qubit"]).select("doc_id", "word_count", "unique_words", "lexical_diversity")


@query("""with v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings), p as (select a.id, list_cosine_similarity(a.v, b.v) as c from v a join v b on a.id <> b.id)
select id as vec_id, round(avg(c), 9) as avg_similarity from p group by 1""")
def cosine_avg(spark, d):
    e = t(spark, d, "embeddings")
    vector = next(f.name for f in e.schema.fields if f.dataType.typeName() == "array")
    key = next(f.name for f in e.schema.fields if f.name.endswith("id"))
    return essays.cosine_avg(e, key, vector).withColumn("avg_similarity", F.round("avg_similarity", 9))


@query("select l_orderkey, l_linenumber, round(0.15 * l_quantity + 0.20 * coalesce(l_discount, 0) + 0.25 * l_tax + 0.40 * l_extendedprice, 4) as grade from lineitem")
def weighted_score_label(spark, d):
    c = lambda x: F.col(x).cast("double")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(essays.weighted_grade(c("l_quantity"), c("l_discount"), c("l_tax"), c("l_extendedprice")), 4).alias("grade"))


# --- output rows and summaries -----------------------------------------------------------------------------------


def _output(spark, d):
    c = t(spark, d, "qise_candidates")
    renamed = c.select("candidate_id", *(F.col(a).alias(b) for a, b in (("semantic_category", "category"), ("keyword_tier", "tier"), ("matched_keyword", "phrase"), ("course_title", "title"))), F.split("matched_keywords", "[|]").alias("matched_keywords"), *(x for x in matching.OUTPUT if x not in ("timestamp", "is_qise_core", "semantic_category", "keyword_tier", "matched_keyword", "matched_keywords", "course_title")))
    return renamed


@query("""select coalesce(institution, '') as institution, coalesce(classification, 'unclear') as classification, coalesce(confidence, 'low') as confidence, coalesce(classification, 'unclear') = 'qise_core' as is_qise_core,
coalesce(nullif(academic_level, ''), 'unknown') as academic_level, coalesce(semantic_category, '') as semantic_category, coalesce(matched_keywords, '') as matched_keywords, left(coalesce(course_title, ''), 200) as course_title, pdf_page::int as pdf_page,
coalesce(extraction_status, 'extracted') as extraction_status, coalesce(source_url, '') as source_url, '2025-01-01T00:00:00Z' as timestamp from qise_candidates""")
def output_rows(spark, d):
    """The 23-column projection; the columns whose rules the SQL states on its own."""
    return matching.to_rows(_output(spark, d), F.lit("2025-01-01T00:00:00Z")).select("institution", "classification", "confidence", "is_qise_core", "academic_level", "semantic_category", "matched_keywords", "course_title", "pdf_page", "extraction_status", "source_url", "timestamp")


@query(f"select country_code, sum(qise_core)::bigint as qise_core, sum(total)::bigint as total, string_agg(distinct university, ' | ' order by university) as universities from ({_INST}) group by 1")
def country_summary(spark, d):
    return rollup.country_summary(_institutions(spark, d).withColumn("country", F.lit(""))).select("country_code", "qise_core", "total", "universities")


@query("""select coalesce(nullif(country_code, ''), '??') as country_code, count(*) as rows, count(*) filter (classification = 'qise_core') as core_rows, count(distinct institution) as institutions,
coalesce(len(list(distinct institution) filter (classification = 'qise_core' and institution is not null)), 0)::int as core_institutions from qise_candidates group by 1""")
def summary_by_country(spark, d):
    return rollup.by_country_code(t(spark, d, "qise_candidates")).withColumn("core_institutions", F.size("core_institutions"))


@query("select course_title, min(candidate_id) as candidate_id from qise_candidates where classification = 'qise_core' and course_title <> '' group by 1")
def unique_core_courses(spark, d):
    return rollup.unique_core_courses(t(spark, d, "qise_candidates").select("course_title", "candidate_id", "classification"), "candidate_id").select("course_title", "candidate_id")


@query("select coalesce(seed_origin, '') as seed_origin, count(*) as n from qise_candidates group by 1")
def by_seed_origin(spark, d):
    return rollup.histogram(t(spark, d, "qise_candidates"), "seed_origin", "")


@query(f"select candidate_id, regexp_matches(lower(source_url), '{lx.HARD_SKIP_URL.replace('(?![a-z])', '(?:[^a-z]|$)')}') as skip from qise_candidates")
def hard_skip(spark, d):
    return t(spark, d, "qise_candidates").select("candidate_id", seeds.hard_skip(F.col("source_url")).alias("skip"))


@query("select x.* from (values " + ", ".join(f"('{c}', {a}, {b}, {str(e).lower()})" for c, a, b, e, _, _ in lx.COUNTRY_FACTS) + ") as x(country_code, times_top_rank, scimago_country_rank_physics, ibm_quantum_network_member) where country_code in (select upper(trim(country_code)) from qise_candidates)")
def country_facts(spark, d):
    codes = t(spark, d, "qise_candidates").select(F.upper(F.trim("country_code")).alias("country_code"))
    return loaders.enrich_countries(codes, loaders.country_facts(spark)).where("times_top_rank is not null").select("country_code", "times_top_rank", "scimago_country_rank_physics", "ibm_quantum_network_member")


@query(f"""with w as (select {_TOK} as t from documents where text is not null), b as (select list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) as t from w where len(t) >= 2), n as (select count(*) as n from b),
e as (select row_number() over () as id, t from b), f as (select id, term, count(*)::double / any_value(size) as tf from (select id, len(t) as size, unnest(t) as term from e) group by 1, 2)
select term, round(sum(tf) * ln(any_value(n)::double / count(*)) / any_value(n), 8) as tfidf_score from f, n group by term""")
def tfidf_bigrams(spark, d):
    return essays.tf_idf(t(spark, d, "documents").where(F.col("text").isNotNull()), "doc_id", "text", 2).withColumn("tfidf_score", F.round("tfidf_score", 8))
