"""Stored payloads of feeds and social sites as records; fetching is left to whoever stores them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "source_type string, source_name string, raw_text string, url string, title string, record_date string"


def rss_records(payloads: DataFrame, name_col: str, xml_col: str) -> DataFrame:
    """A record an item of RSS or entry of Atom. Null and malformed payloads have none."""

    def items(name, xml):
        from xml.etree import ElementTree

        try:
            root = ElementTree.fromstring(xml or "")
        except ElementTree.ParseError:
            return []
        local = lambda e: e.tag.rsplit("}", 1)[-1].lower()
        out = []
        for e in root.iter():
            if local(e) in ("item", "entry"):
                parts = {local(x): x for x in e}
                text = lambda *ns: next((" ".join("".join(parts[n].itertext()).split()) for n in ns if n in parts), "")
                link = text("link") or (parts["link"].get("href", "") if "link" in parts else "")
                out.append(("rss", name, " ".join(x for x in (text("title"), text("description", "summary", "content")) if x), link, text("title"), text("pubdate", "published", "updated")))
        return out

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for n, x in zip(pdf[name_col], pdf[xml_col]) for r in items(n, x)], columns=[c.split()[0] for c in RECORD.split(", ")])

    return payloads.select(name_col, xml_col).mapInPandas(run, RECORD)


def reddit_records(payloads: DataFrame, name_col: str, json_col: str) -> DataFrame:
    """A record a post of a listing, all in the JVM."""
    listing = F.from_json(json_col, "data struct<children:array<struct<data:struct<title:string,selftext:string,permalink:string,created_utc:double>>>>")
    posts = payloads.select(F.col(name_col).alias("source_name"), F.explode(listing["data"]["children"]["data"]).alias("p"))
    date = F.date_format(F.timestamp_seconds("p.created_utc"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return posts.select(F.lit("reddit").alias("source_type"), "source_name", F.trim(F.concat_ws(" ", "p.title", "p.selftext")).alias("raw_text"), F.concat(F.lit("https://www.reddit.com"), "p.permalink").alias("url"), F.col("p.title").alias("title"), date.alias("record_date"))


def twitter_records(payloads: DataFrame, name_col: str, json_col: str) -> DataFrame:
    """A record a message of a search result, all in the JVM."""
    found = F.from_json(json_col, "data array<struct<id:string,text:string,created_at:string>>")
    posts = payloads.select(F.col(name_col).alias("source_name"), F.explode(found["data"]).alias("p"))
    return posts.select(F.lit("twitter").alias("source_type"), "source_name", F.col("p.text").alias("raw_text"), F.concat(F.lit("https://twitter.com/i/web/status/"), "p.id").alias("url"), F.lit("").alias("title"), F.col("p.created_at").alias("record_date"))


def valid_records(records: DataFrame, least: int = 10) -> DataFrame:
    """Records whose trimmed text has at least `least` characters."""
    return records.where(F.length(F.trim("raw_text")) >= least)
