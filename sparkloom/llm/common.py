"""What the operators of this subpackage share: folding, hashing, materialisation, LSH tuning."""

from __future__ import annotations

import math
import re
import tempfile
import unicodedata
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKS = re.compile("[̀-ͯ]+")
WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    """Lower case without accents; canonical decomposition, combining marks dropped."""
    text = text.lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text))


def words(text: str | None) -> list[str]:
    """Folded words; punctuation and spacing only separate."""
    return WORD.findall(fold(text)) if text else []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; one of our own only where it is unset (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or ""
    where = named or tempfile.mkdtemp(prefix="sparkloom-ckpt-")
    spark.sparkContext.setCheckpointDir(where)
    return jsc.getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared checkpoint folder: compressed, and it survives the loss of an executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def collision(similarity: float, bands: int, rows: int) -> float:
    """Chance that two sets of that Jaccard similarity share a band: 1 - (1 - s^r)^b."""
    return 1 - (1 - similarity**rows) ** bands


def tune_bands(similarity: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows) within max_hashes that reach the recall at the similarity with the steepest collision curve,
    that is the most rows a band; the fewest bands for those rows. ValueError if none does."""
    for rows in range(max_hashes, 0, -1):
        p = similarity**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p)) if p > 1e-12 else max_hashes + 1
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError(f"no banding of {max_hashes} hashes reaches recall {recall} at similarity {similarity}")


_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, vectorised."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    """n odd multipliers, fixed by rule."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class WordHashes(dict):
    """word -> 64-bit hash, kept while a worker lives; emptied at a bound so that it can't grow with the data."""

    BOUND = 400_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hash_sample(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """The `size` rows of the least hash of those columns, the same on every run. A threshold that about twice as many pass is applied
    before the sort, so that no task or driver gathers more than that however many partitions there are."""
    n = df.count()
    hashed = df.withColumn("h", F.xxhash64(*columns))
    if n > 2 * size + 1000:
        hashed = hashed.where(F.col("h") < int(-(2**63) + 2**64 * (2 * size + 1000) / n))
    return hashed.orderBy("h", *columns).limit(size)
