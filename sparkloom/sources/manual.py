"""Evidence entered by hand, and settings: level aliases, order of the report, merging into a dataset, lists in YAML or JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..operators.dedupe import confidence_rank, merge_existing


def academic_level(c: Column) -> Column:
    """undergraduate, graduate or unknown by the aliases; anything else raises an error that names the value."""
    plain = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    aliases = F.create_map(*(F.lit(x) for kv in lx.LEVEL_ALIASES.items() for x in kv))
    known = F.coalesce(aliases[plain], plain)
    return F.when(known.isin("undergraduate", "graduate", "unknown"), known).otherwise(F.raise_error(F.concat(F.lit("invalid academic level: "), F.coalesce(c, F.lit("null")))).cast("string"))


def report_order(rows: DataFrame) -> DataFrame:
    """Core rows first, then by confidence, high first, and category."""
    place = F.array_position(F.array(*map(F.lit, lx.CLASS_ORDER)), F.col("classification"))
    return rows.orderBy(F.when(place > 0, place).otherwise(len(lx.CLASS_ORDER) + 1), confidence_rank(F.col("confidence")).desc(), "semantic_category")


def append(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The dataset with the rows of the same keys replaced unless they are worse."""
    ranked = lambda df: df.withColumn("_rank", confidence_rank(F.col("confidence")))
    return merge_existing(ranked(old), ranked(new), keys, "_rank", seq).drop("_rank")


def read_list(spark: SparkSession, path: str, key: str = "universities") -> DataFrame:
    """A list of institutions by its suffix: CSV; JSON or YAML that is a list, or a mapping with the list under `key`. Small files of settings,
    read whole by Spark's own file systems. ValueError on another suffix or form."""
    from .loaders import institutions_from, read_csv

    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return institutions_from(read_csv(spark, path))
    if suffix not in ("yaml", "yml", "json"):
        raise ValueError(f"no reader for .{suffix}")
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if suffix in ("yaml", "yml"):
        import yaml  # optional

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    data = data.get(key) if isinstance(data, dict) else data
    if not isinstance(data, list) or not all(isinstance(x, dict) for x in data):
        raise ValueError(f"neither a list nor a mapping with '{key}'")
    names = list(dict.fromkeys(k for x in data for k in x))
    flat = [tuple("|".join(map(str, v)) if isinstance(v := x.get(k), Iterable) and not isinstance(v, str) else None if v is None else str(v) for k in names) for x in data]
    return institutions_from(spark.createDataFrame(flat, ", ".join(f"`{n}` string" for n in names or ["name"])))


def settings(given: dict, aliases: dict[str, str], overrides: dict | None = None) -> dict:
    """Settings under their canonical keys: an alias counts where the key is missing, an override where it isn't None."""
    out = {k: v for k, v in given.items() if k not in aliases}
    for alias, key in aliases.items():
        if alias in given:
            out.setdefault(key, given[alias])
    return out | {k: v for k, v in (overrides or {}).items() if v is not None}
