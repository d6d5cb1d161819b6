"""Seed scores, link priorities and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as tx
from ..functions import urls
from .dedupe import top_k


def url_words(url: Column) -> Column:
    """Address, percent-decoded, with separators as spaces."""
    return F.regexp_replace(F.coalesce(F.try_url_decode(url), url), r"[-_/.+?=&%]+", " ")


def seed_score(url: Column, anchor: Column, in_sitemap: Column) -> Column:
    """Academic and STEM words for, low-priority words against; curriculum, document and sitemap bonuses."""
    u, a = tx.spaced(tx.fold(url_words(url))), tx.spaced(tx.fold(F.coalesce(anchor, F.lit(""))))
    both = F.concat(u, a)
    counts = F.struct(tx.count_terms(u, lx.ACADEMIC).alias("u"), tx.count_terms(a, lx.ACADEMIC).alias("a"), tx.count_terms(both, lx.STEM).alias("stem"), tx.count_terms(both, lx.LOW_PRIORITY).alias("low"))
    curriculum = tx.fold(F.concat_ws(" ", url, anchor)).rlike(lx.CURRICULUM_URL)
    bonus = lambda c, n: F.when(c, n).otherwise(0)
    words = tx.once(counts, lambda x: 3 * F.least(x["u"], F.lit(3)) + 2 * F.least(x["a"], F.lit(3)) + 2 * F.least(x["stem"], F.lit(3)) + bonus(((x["u"] > 0) | (x["a"] > 0)) & (x["stem"] > 0), 4) - 5 * x["low"])
    return (words + bonus(curriculum, 5) + bonus(urls.looks_like_pdf(url), 2) + bonus(in_sitemap, 1)).cast("int")


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """(url): the first source, the first anchor that isn't empty, in_sitemap if any; candidates: url, source, anchor, in_sitemap, pos."""
    return candidates.groupBy("url").agg(F.min_by("source", "pos").alias("source"), F.min_by("anchor", F.when(F.col("anchor") != "", F.col("pos"))).alias("anchor"), F.bool_or("in_sitemap").alias("in_sitemap"))


def top_seeds(scored: DataFrame, per: str, least: int = 3, k: int = 20) -> DataFrame:
    return top_k(scored.where(F.col("score") >= least), [per], [F.col("score").desc(), F.col("seed_url")], k)


def link_priority(url: Column, anchor: Column) -> Column:
    """1 is best, 6 the default; documents 1."""
    u, a = tx.fold(url), tx.fold(F.coalesce(anchor, F.lit("")))
    stem = tx.any_term(tx.spaced(F.concat(F.regexp_replace(u, r"[-_/.+%]+", " "), F.lit(" "), a)), lx.STEM)
    curriculum = u.rlike(lx.CURRICULUM_URL) | a.rlike(lx.CURRICULUM_URL)
    low = u.rlike(lx.LOW_URL) | tx.any_term(tx.spaced(a), lx.LOW_PRIORITY)
    course = u.rlike(lx.COURSE_URL) | a.rlike(lx.COURSE_ANCHOR) | stem
    return F.when(urls.looks_like_pdf(url), 1).when(curriculum, F.when(stem, 2).otherwise(3)).when(low, 5).when(course, F.when(stem, 3).otherwise(4)).otherwise(6)


def hard_skip(url: Column) -> Column:
    """Never queued: binary assets, log-ins, per-user and feed pages."""
    return F.lower(url).rlike(lx.HARD_SKIP_URL)


def link_candidates(links: DataFrame, known_hosts: DataFrame | None = None) -> DataFrame:
    """(page_url, url, anchor, seq, priority): links (page_url, url, anchor, seq) that may be queued. The first link to a host not yet known
    counts at least 2 if host or anchor speak of study or a science, or the host's first label is 2 to 4 letters, else at least 3."""
    kept = links.where(F.col("url").isNotNull() & ~hard_skip(F.col("url"))).withColumn("_host", urls.host(F.col("url"))).withColumn("_p", link_priority(F.col("url"), F.col("anchor")))
    first = kept.groupBy("_host").agg(F.min("seq").alias("seq"))
    if known_hosts is not None:
        first = first.join(known_hosts.select(F.col("host").alias("_host")), "_host", "left_anti")
    words = tx.spaced(tx.fold(F.concat_ws(" ", F.regexp_replace("_host", "[-.]", " "), "anchor")))
    speaks = tx.any_term(words, lx.ACADEMIC) | tx.any_term(words, lx.STEM) | F.substring_index("_host", ".", 1).rlike("^[a-z]{2,4}$")
    new = F.col("_new").isNotNull()
    out = kept.join(first.withColumn("_new", F.lit(True)), ["_host", "seq"], "left")
    return out.select("page_url", "url", "anchor", "seq", F.when(new, F.least("_p", F.when(speaks, 2).otherwise(3))).otherwise(F.col("_p")).cast("int").alias("priority"))


def frontier_order(candidates: DataFrame) -> DataFrame:
    """The order in which a wave's candidates are taken: priority, then discovery. The position counts within the wave's partitioned sort."""
    return candidates.orderBy("priority", "seq")


def seed_origin(has_manual: Column, discovered: Column) -> Column:
    """auto_discovered where discovery ran and found seeds, else manual or homepage_crawl."""
    return F.when(F.coalesce(discovered, F.lit(0)) > 0, "auto_discovered").when(has_manual, "manual").otherwise("homepage_crawl")


def seed_reason(academic: Column, stem: Column, curriculum: Column, pdf: Column, sitemap: Column) -> Column:
    """Why a seed scored: up to three sorted terms of each sort, and the bonuses, joined by ' + '."""
    some = lambda label, terms: F.when(F.size(terms) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(F.array_sort(terms), 1, 3), ", ")))
    return F.concat_ws(" + ", some("academic", academic), some("stem", stem), F.when(curriculum, "curriculum"), F.when(pdf, "pdf"), F.when(sitemap, "sitemap"))


def link_waves(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth) reachable in at most max_depth steps: a frontier a wave, each an anti-join on what is known."""
    known = start.select("url", F.lit(0).alias("depth"))
    frontier = known
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges.select(F.col("src").alias("url"), "dst"), "url").select(F.col("dst").alias("url")).distinct()
        frontier = step.join(known, "url", "left_anti").withColumn("depth", F.lit(depth))
        known = known.unionByName(frontier)
    return known
