"""Addresses as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = r"^(utm_.*|_gl|gclid|fbclid|_ga|mc_.*|tmpl|print)(=.*)?$"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^@/?#]*@)?([^:/?#]+)", 1))


def registered_domain(h: Column) -> Column:
    """Three labels under a second-level academic or commercial domain, else two."""
    parts = F.split(F.lower(h), r"\.")
    keep = F.when(F.lower(h).rlike(r"\.(edu|com|org|net|gob|gov|mil|ac)\.[a-z]{2}$"), 3).otherwise(2)
    return F.when(F.size(parts) <= 2, F.lower(h)).otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - keep + 1, F.lit(1)), keep), "."))


def in_scope(url: Column, domain: Column) -> Column:
    h = host(url)
    return (h == domain) | F.endswith(h, F.concat(F.lit("."), domain))


def looks_like_pdf(url: Column) -> Column:
    u = F.regexp_replace(F.lower(url), "#.*$", "")
    return F.regexp_extract(u, r"^[a-z]+://[^/]+([^?]*)", 1).rlike(r"\.pdf$") | u.rlike(r"\.pdf(\?|$)")


def without_tracking(url: Column) -> Column:
    """The address without tracking parameters, fragment and, but for the root, a trailing slash."""
    u = F.regexp_replace(url, "#.*$", "")
    base, query = F.regexp_replace(u, r"\?.*$", ""), F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)), "&")
    base = F.when(base.rlike(r"^[a-zA-Z]+://[^/]+$"), F.concat(base, F.lit("/"))).when(base.rlike(r"^[a-zA-Z]+://[^/]+/.+/$"), F.regexp_replace(base, "/+$", "")).otherwise(base)
    return F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def url_hash(url: Column) -> Column:
    return F.left(F.md5(url), F.lit(12))


def join_url(base: Column, raw: Column) -> Column:
    """Relative resolution, which no built-in does; only http and https pass."""

    @F.pandas_udf("string")
    def joined(bases: pd.Series, raws: pd.Series) -> pd.Series:
        from urllib.parse import urljoin, urlsplit

        def one(b, r):
            if not r:
                return None
            try:
                u = urlsplit(urljoin(b or "", r.strip()))
            except ValueError:
                return None
            return u._replace(scheme=u.scheme.lower(), netloc=u.netloc.lower(), fragment="").geturl() if u.scheme in ("http", "https") and u.netloc else None

        return pd.Series([one(b, r) for b, r in zip(bases, raws)], dtype=object)

    return joined(base, raw)


def external_document(url: Column) -> Column:
    """Download address of a shared file or sheet, '' if it is none."""
    drive = F.regexp_extract(url, r"drive\.google\.com/(?:file/d/|open\?id=|uc\?(?:.*&)?id=)([\w-]+)", 1)
    sheet = F.regexp_extract(url, r"docs\.google\.com/spreadsheets/d/([\w-]+)", 1)
    shared = url.rlike(r"(?i)://[^/]*(sharepoint\.com|onedrive\.live\.com|1drv\.ms)/")
    return (
        F.when(drive != "", F.concat(F.lit("https://drive.google.com/uc?export=download&id="), drive))
        .when(sheet != "", F.format_string("https://docs.google.com/spreadsheets/d/%s/export?format=xlsx", sheet))
        .when(shared, F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("download=1")))
        .otherwise("")
    )
