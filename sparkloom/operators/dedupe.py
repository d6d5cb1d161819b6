"""Keep-best and keep-first. Ties go by an explicit sequence column, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def keep_best(df: DataFrame, keys: list[str], rank: str, seq: str, latest: bool = False) -> DataFrame:
    """The row of the highest rank a key, of ties the earliest (or latest). An aggregate with a partial step: the rows of a hot
    key are combined before the shuffle, unlike in a window. Null keys form a key; a null rank loses."""
    order = F.struct(F.coalesce(F.col(rank).cast("double"), F.lit(float("-inf"))), F.col(seq) if latest else -F.col(seq))
    row = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_row")
    out = df.groupBy(*keys).agg(row)
    return out.select(*keys, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The earliest row a key."""
    return keep_best(df.withColumn("_one", F.lit(0)), keys, "_one", seq).drop("_one")


def merge_existing(old: DataFrame, new: DataFrame, keys: list[str], rank: str, seq: str) -> DataFrame:
    """Union in which a later row replaces one of the same or a lower rank."""
    both = old.unionByName(new, allowMissingColumns=True)
    return keep_best(both, keys, rank, seq, latest=True)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows a key; Catalyst limits each partition's groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
