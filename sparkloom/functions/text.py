"""Text functions as columns. All but full NFKC stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx

# Accented letters and their bases, one to one, so that offsets survive.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñÝýÿ"
PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNnYyy"


def fold(c: Column) -> Column:
    """Lower case without accents; same length as the text."""
    return F.lower(F.translate(c, ACCENTED, PLAIN))


def spaced(folded: Column) -> Column:
    """Padded words and signs parted by single spaces: a phrase in the same form is word-bounded where it is contained."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(folded, r"([^\p{L}\p{N}_\s])", " $1 "), r"\s+", " ")), F.lit(" "))


def spaced_phrase(phrase: str) -> str:
    import re

    return " " + " ".join(re.sub(r"([^\w\s])", r" \1 ", phrase).split()) + " "


def terms_in(spaced_text: Column, terms: list[str]) -> Column:
    """Terms present, word-bounded, in list order."""
    table = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(spaced_phrase(t)).alias("p")) for t in terms))
    return F.transform(F.filter(table, lambda s: spaced_text.contains(s["p"])), lambda s: s["t"])


def once(value: Column, use) -> Column:
    """use(value) with the value computed once a row: a lambda variable stands for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _phrases(terms: list[str]) -> Column:
    return F.array(*(F.lit(spaced_phrase(x)) for x in terms))


def count_terms(spaced_text: Column, terms: list[str]) -> Column:
    """How many different terms are present."""
    return once(spaced_text, lambda s: F.size(F.filter(_phrases(terms), lambda p: s.contains(p))))


def any_term(spaced_text: Column, terms: list[str]) -> Column:
    return once(spaced_text, lambda s: F.exists(_phrases(terms), lambda p: s.contains(p)))


def has_substring(folded: Column, parts: list[str]) -> Column:
    return once(folded, lambda s: F.exists(F.array(*map(F.lit, parts)), lambda p: s.contains(p)))


def count_substrings(folded: Column, parts: list[str]) -> Column:
    return once(folded, lambda s: F.size(F.filter(F.array(*map(F.lit, parts)), lambda p: s.contains(p))))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def nfkc(c: Column) -> Column:
    """Compatibility composition; the one function with no JVM form."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return compose(c)


def normalize_text(c: Column, compose: bool = True) -> Column:
    """NFKC, control characters dropped but newline and tab, spaces collapsed, at most one blank line."""
    c = nfkc(c) if compose else c
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_course_text(c: Column) -> Column:
    """Entities, addresses and page numbers out, spaces collapsed."""
    for pattern in (r"&[a-zA-Z]+;|&#\d+;", r"https?://\S+", r"\S+@\S+\.\S+", r"(?i)p[áa]gina\s+\d+\s+de\s+\d+", r"(?i)page\s+\d+\s+of\s+\d+"):
        c = F.regexp_replace(c, pattern, " ")
    return collapse(c)


#: A code between signs or ends that aren't letters, digits or underscores.
COURSE_CODE = r"(?i)(?:^|[^\p{L}\p{N}_])([A-Z]{2,5}[-\s]?\d{3,5}[A-Z]?)(?:[^\p{L}\p{N}_]|$)"


def course_code(c: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(c, COURSE_CODE, 1), F.lit("")))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(fold(c), r"[^a-z0-9_\s-]", "")), r"[\s_-]+", "_")


def truncate_words(c: Column, n: int) -> Column:
    """At most n characters, cut at the last space, marked by an ellipsis."""
    cut = F.substring(c, 1, n)
    at = F.regexp_replace(cut, r"(?s) [^ ]*$", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.when(F.length(at) > 0, at).otherwise(cut), F.lit("…")))


def title_key(c: Column) -> Column:
    """Folded title without a leading course code."""
    return collapse(F.regexp_replace(collapse(fold(c)), r"^[a-z]{1,4}[- ]?\d{2,4}[a-z]?\b[\s.:–—-]*", ""))


def country_code(c: Column) -> Column:
    """Code of a country's name, accent and case aside; codes pass."""
    folded = collapse(F.regexp_replace(fold(c), r"[^a-z0-9]+", " "))
    table = F.create_map(*(F.lit(x) for kv in lx.COUNTRIES.items() for x in kv))
    return F.coalesce(table[folded], F.when(F.upper(folded).isin(*sorted(set(lx.COUNTRIES.values()))), F.upper(folded)))


def language_rules(c: Column) -> Column:
    """Marker-count language of a course text: es, pt, en or unknown."""
    m = lx.LANGUAGE_MARKERS

    def decide(x: Column) -> Column:
        es, pt, en, tech = x["es"], x["pt"], x["en"], x["technical"]
        top = F.greatest(es, pt, en)
        ties = (es == top).cast("int") + (pt == top).cast("int") + (en == top).cast("int")
        return (
            F.when(((en >= 2) | (tech >= 2)) & (es == 0) & (pt == 0), "en")
            .when(top == 0, "unknown")
            .when((es == pt) & (x["pt_only"] > 0), "pt")
            .when((es == pt) & (x["es_only"] > 0), "es")
            .when((es == pt) & (tech >= 2), "es")
            .when(ties > 1, "unknown")
            .when(es == top, "es")
            .when(pt == top, "pt")
            .otherwise("en")
        )

    counts = once(fold(c), lambda f: F.struct(*(F.size(F.filter(F.array(*map(F.lit, parts)), lambda p: f.contains(p))).alias(k) for k, parts in m.items())))
    return F.when(c.isNull() | (c == ""), "unknown").otherwise(once(counts, decide))


def source_type_rules(url: Column, text: Column, is_pdf: Column) -> Column:
    def decide(f: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, parts in reversed(lx.SOURCE_TYPES):
            out = F.when(F.exists(F.array(*map(F.lit, parts)), lambda p: f.contains(p)), name).otherwise(out)
        return out

    text = fold(F.concat(F.coalesce(url, F.lit("")), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 1500)))
    return F.coalesce(once(text, decide), F.when(is_pdf, "pdf").otherwise("html_page"))


def academic_level(c: Column) -> Column:
    def decide(s: Column) -> Column:
        under, post = (F.exists(_phrases(x), lambda p: s.contains(p)) for x in (lx.UNDERGRAD, lx.POSTGRAD))
        return F.when(under & ~post, "undergraduate").when(post & ~under, "graduate").otherwise("")

    return F.when(c.isNull(), "").otherwise(once(spaced(fold(c)), decide))


def is_course_page(url: Column, text: Column) -> Column:
    """Course-page heuristic: the address, or one strong or two weak signals in the first 2000 characters."""
    s = spaced(fold(F.substring(text, 1, 2000)))
    return F.lower(url).rlike(lx.COURSE_URL) | (count_terms(s, lx.STRONG) >= 1) | (count_terms(s, lx.WEAK) >= 2)
