"""Streams: first-seen rows, and the best row a key kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import merge_existing


def first_seen(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Each key once; state is dropped behind the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, key: str, width: str, delay: str) -> DataFrame:
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), key).agg(F.count("*").alias("n"))


def keep_best_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str], rank: str, seq: str):
    """A query that merges each batch into a versioned table at path, on any file system Spark knows; re-running a batch gives the same
    version. The last version before the batch counts, whatever its number; versions older than that are removed."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        named = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}/_SUCCESS"))
        before = sorted(n for x in named if x[:1] == "v" and x[1:].isdigit() and (n := int(x[1:])) < number and done(n))
        old = spark.read.parquet(f"{path}/v{before[-1]}") if before else batch.limit(0)
        merge_existing(old, batch, keys, rank, seq).write.mode("overwrite").parquet(f"{path}/v{number}")
        for n in before[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
