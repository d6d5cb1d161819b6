"""Near-duplicate texts with small edits: banded candidates, sequential Bayesian verification, exact check of the survivors.

Two texts are near-duplicates if they share at least `threshold` of the words of the longer one (as multisets).

1. Words get occurrence numbers, so multisets are sets. A row of WIDTH counters over all texts (a fixed size, whatever the
   data) says how rare a word is.
2. Texts with the same bag of words are one class; a representative stands for it from here on.
3. Weighted MinHash (a word's weight is the logarithm of its rarity) is cut into bands. Bands and rows come from the collision
   curve at the Jaccard similarity that the threshold guarantees, t / (2 - t), for the recall wanted.
4. Representatives that share a band are compared by signatures, an odd sketch of their words, one batch of 64 cells after the
   other: after each, a pair goes if the posterior chance that its words differ no more than they may is below `miss`.
5. Survivors are verified on their words: nothing that is not a near-duplicate comes out.

A band's key that many texts hold is split into blocks, and every pair of blocks is joined on its own (`_blocks`): no pair is lost and
no task gets the whole of it. Likewise large classes in `all_pairs`.

Defined results: null and wordless texts belong to no group; equal texts share all words; ties can't arise.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, materialize, mix64, seeds, tune_bands, words

WIDTH = 1 << 16
#: Rows of one key beyond which it is split into blocks of about as many.
HOT = 8192
#: Recall of the bands at the least similarity that a near-duplicate can have, and chance that a pruned pair was one.
RECALL, MISS, HASHES = 0.95, 1e-4, 110
#: Elements of a padded block of texts in the workers.
_PADDED = 1 << 17

_hashes = WordHashes()


def _hash_words(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


def _padded(lists: list[list[str]]):
    """(positions in the list, sizes, hashes of the words in a matrix padded with the greatest value), shorter texts first."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * sizes[order[end]] <= _PADDED:
            end += 1
        own = order[at:end]
        n = sizes[own]
        held = np.arange(n[-1])[None, :] < n[:, None]
        h = np.full(held.shape, np.uint64(0xFFFFFFFFFFFFFFFF))
        h[held] = _hash_words([w for k in own.tolist() for w in lists[k]])
        yield own, n, h
        at = end


def _sketch(df: DataFrame, text_col: str) -> np.ndarray:
    """Occurrences of the words of each cell; summed by the cluster, only WIDTH numbers reach the driver."""

    def run(batches):
        cells = np.zeros(WIDTH, np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                tokens = [w for t in pdf[text_col].iloc[at : at + 1000] for w in words(t)]
                cells += np.bincount((_hash_words(tokens) % np.uint64(WIDTH)).astype(np.int64), minlength=WIDTH)
        at = np.nonzero(cells)[0]
        yield pd.DataFrame({"cell": at, "n": cells[at]})

    rows = df.select(text_col).where(F.col(text_col).isNotNull()).mapInPandas(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(WIDTH, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def _occurrences(h: np.ndarray) -> np.ndarray:
    """The words of each row, sorted, with their occurrence numbers in the row mixed in."""
    h.sort(axis=1)
    place = np.arange(h.shape[1])[None, :]
    first = np.ones(h.shape, bool)
    first[:, 1:] = h[:, 1:] != h[:, :-1]
    n = place - np.maximum.accumulate(np.where(first, place, 0), axis=1)
    with np.errstate(over="ignore"):
        return mix64(h + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _band_keys(token: np.ndarray, weight: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys (texts x bands): in each row of a band the word of the least exponential draw, whose rate is its weight. Padding has weight 0."""
    with np.errstate(over="ignore", divide="ignore"):
        low = (token >> np.uint64(32)).astype(np.uint32)
        scale = (-1.0 / weight).astype(np.float32)
        out = np.zeros((len(token), bands), np.uint64)
        salt = seeds(2 * bands * rows, start=7)
        for k in range(bands * rows):
            u = (low ^ np.uint32(salt[2 * k] >> np.uint64(32))) * np.uint32(salt[2 * k + 1] & np.uint64(0xFFFFFFFF))
            draw = np.log(((u >> np.uint32(8)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)) * scale
            least = draw.min(axis=1).view(np.uint32).astype(np.uint64)
            out[:, k // rows] = mix64(out[:, k // rows] * np.uint64(31) + least + np.uint64(1))
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _signatures(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(id, bag, size, keys, x, y): hash of the multiset of words, keys of the bands, x and y the odd sketch of the words, 64 cells each."""
    counts = _sketch(df, text_col)
    rarity = np.log(max(1, counts.sum()) / np.maximum(1, counts)) / 8 + 0.02
    shared = df.sparkSession.sparkContext.broadcast(rarity.astype(np.float32))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        weights = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                kept = [(i, w) for i, t in zip(part[id_col], part[text_col]) if (w := words(t))]
                if not kept:
                    continue
                lists = [w for _, w in kept]
                n = len(kept)
                bag, x, y, keys = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, bands), np.int32)
                size = np.zeros(n, np.int32)
                for own, sizes, h in _padded(lists):
                    token = _occurrences(h)
                    held = np.arange(h.shape[1])[None, :] < sizes[:, None]  # padding sorts last
                    weight = np.where(held, weights[(h % np.uint64(WIDTH)).astype(np.int64)], np.float32(1e-30))
                    keys[own] = _band_keys(token, weight, bands, rows)
                    token = np.where(held, token, np.uint64(0))
                    with np.errstate(over="ignore"):
                        bag[own] = mix64(mix64(token) * held).sum(axis=1, dtype=np.uint64)
                    bit = (np.uint64(1) << (token >> np.uint64(58))) * held
                    side = (token >> np.uint64(57)) & np.uint64(1) == 1
                    x[own], y[own] = (np.bitwise_xor.reduce(np.where(side == s, bit, np.uint64(0)), axis=1) for s in (False, True))
                    size[own] = sizes
                yield pd.DataFrame({id_col: pd.Series([i for i, _ in kept], dtype=pdf[id_col].dtype), "bag": bag.view(np.int64), "size": size, "keys": list(keys), "x": x.view(np.int64), "y": y.view(np.int64)})

    return df.select(id_col, text_col).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).mapInPandas(run, f"`{id_col}` {kind}, bag bigint, size int, keys array<int>, x bigint, y bigint")


@lru_cache(maxsize=4)
def posterior_bounds(miss: float, most: int = 512) -> tuple[list[int], list[int]]:
    """For words that may differ in up to D places, D = 0 ... most - 1: the greatest count of differing cells, of 64 and of 128, at which
    a pair is kept. The posterior of the number d of words that differ, evenly likely beforehand up to 4 D + 64, follows from the chance
    that d words leave m of c cells odd; a pair whose chance of d <= D is below `miss` goes. More than D odd cells can't come from D words."""
    reach = 4 * most + 64
    out = []
    for share in (0.5, 1.0):  # of 128 cells, those of the first batch, then all; the words of other cells leave these as they are
        cells = int(128 * share)
        odd = np.zeros((reach + 1, cells + 1))
        odd[0, 0] = 1.0
        m = np.arange(cells + 1)
        for d in range(1, reach + 1):
            before = odd[d - 1]
            hit = np.zeros(cells + 1)
            hit[1:] += before[:-1] * (cells - m[:-1]) / cells
            hit[:-1] += before[1:] * m[1:] / cells
            odd[d] = share * hit + (1 - share) * before
        bound = []
        for most_differ in range(most):
            seen = odd[: 4 * most_differ + 65]
            chance = seen[: most_differ + 1].sum(axis=0) / np.maximum(seen.sum(axis=0), 1e-300)
            kept = np.nonzero(chance >= miss)[0]
            bound.append(int(min(most_differ, kept.max() if len(kept) else 0)))
        out.append(bound)
    return out[0], out[1]


def _alike(threshold: float, miss: float) -> Column:
    """Whether two signatures, sides a and b, stay candidates: sizes, then the batches of the sketch in turn."""
    needed = F.ceil(threshold * F.greatest("sizea", "sizeb") - 1e-9).cast("int")
    differ = (F.col("sizea") + F.col("sizeb") - 2 * needed).cast("int")
    one, two = posterior_bounds(miss)
    limit = lambda bounds, cells: F.coalesce(F.get(F.lit(bounds), differ), F.lit(cells))
    first = F.bit_count(F.col("xa").bitwiseXOR(F.col("xb")))
    both = first + F.bit_count(F.col("ya").bitwiseXOR(F.col("yb")))
    return (F.least("sizea", "sizeb") >= needed) & (first <= limit(one, 64)) & (both <= limit(two, 128))


def _blocks(df: DataFrame, value: str, split: Column, side: str) -> DataFrame:
    """Rows keyed by pairs of blocks: one of side a in block i goes to (i, j) for every j, one of side b in block j to (i, j) for every i.
    A key with split = 1 stays one group."""
    own, other = ("_i", "_j") if side == "a" else ("_j", "_i")
    return df.withColumn(own, F.pmod(F.xxhash64(value), split)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), split - 1)))


def share_of_longer(a: str, b: str) -> float:
    """Words that both have, as multisets, against the longer one's."""
    x, y = _bag(a), _bag(b)
    return sum((x[0] & y[0]).values()) / max(x[1], y[1], 1)


@lru_cache(maxsize=512)
def _bag(text: str):
    from collections import Counter

    w = words(text)
    return Counter(w), len(w)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, recall: float = RECALL, miss: float = MISS, hashes: int = HASHES, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, rep) of every text with words; links (a, b, share), a < b, between representatives."""
    bands, rows = tune_bands(threshold / (2 - threshold), recall, hashes)
    base = materialize(_signatures(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", bands, rows))
    classes = base.groupBy("bag", "size").agg(F.min("id").alias("rep"))
    members_of = materialize(base.select("id", "bag", "size").join(classes, ["bag", "size"]).select(F.col("id").alias(id_col), "rep"))
    # The plan is that of large inputs at every size: sides that grow with the data are merged, never broadcast.
    others = members_of.where(F.col(id_col) != F.col("rep")).select(F.col(id_col).alias("id"))
    reps = materialize(base.join(others.hint("merge"), "id", "left_anti").select("id", "size", "keys", "x", "y"))
    keyed = reps.select(F.posexplode("keys").alias("band", "k"), "id", "size", "x", "y")
    keyed = keyed.select(F.shiftleft(F.col("band").cast("bigint"), 32).bitwiseOR(F.col("k").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"), "id", "size", "x", "y")
    # Keys are counted in WIDTH cells, which bounds what is broadcast; all keys of a cell that is far too full are split.
    cell = F.pmod(F.xxhash64("key"), F.lit(WIDTH))
    full = keyed.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).toPandas()
    limit = max(hot, int(4 * full["n"].mean())) if len(full) else hot
    full = full[full["n"] > limit]

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        # Every column is renamed: with none in common, both sides of a join with itself share one exchange.
        a, b = (side.select(*(F.col(c).alias(c + s) for c in (*on, "id", "size", "x", "y"))) for side, s in ((left, "a"), (right, "b")))
        both = a.join(b, [F.col(c + "a") == F.col(c + "b") for c in on])
        return both.where((F.col("ida") < F.col("idb")) & _alike(threshold, miss)).select(F.col("ida").alias("a"), F.col("idb").alias("b"))

    if len(full):
        heavy = F.broadcast(df.sparkSession.createDataFrame([(int(c), int(math.ceil(n / limit))) for c, n in zip(full["cell"], full["n"])], "cell bigint, split bigint"))
        keyed = keyed.withColumn("cell", cell)
        light = keyed.join(heavy, "cell", "left_anti")
        split = keyed.join(heavy, "cell")
        pairs = met(light, light, ["key"]).unionByName(met(*(_blocks(split, "id", F.col("split"), s) for s in "ab"), ["key", "_i", "_j"]))
    else:
        pairs = met(keyed, keyed, ["key"])
    pairs = pairs.distinct()
    pairs = materialize(pairs)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().hint("merge"), "id", "left_semi")

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([share_of_longer(a, b) for a, b in zip(x, y)], dtype=float)

    links = pairs.hint("merge").join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").hint("merge").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    links = links.select("a", "b", share("x", "y").alias("share")).where(F.col("share") >= threshold)
    return members_of, links


def all_pairs(members: DataFrame, links: DataFrame, id_col: str, hot: int = HOT) -> DataFrame:
    """(a, b), a < b, of the rows themselves: links of representatives spread over their classes, and classes within, large ones by blocks."""
    m = members.select(F.col(id_col).alias("i"), "rep")
    across = links.select("a", "b").join(m.select(F.col("rep").alias("a"), F.col("i").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("i").alias("y")), "b").select("x", "y")
    several = m.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep", F.ceil(F.col("n") / hot).alias("split"))
    own = m.join(several, "rep")
    x, y = (_blocks(own, "i", F.col("split"), s).select("rep", "_i", "_j", F.col("i").alias(v)) for s, v in (("a", "x"), ("b", "y")))
    within = x.join(y, ["rep", "_i", "_j"]).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def groups(members: DataFrame, links: DataFrame, id_col: str, rounds: int = 30) -> DataFrame:
    """(id, group_id, n_links): connected components of the links over all rows, by label propagation with pointer jumping on
    representatives; the label is the least id. Each round is cut by a table, and nothing but a count comes to the driver."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialize(members.select(F.col("rep").alias("v")).distinct().withColumn("label", F.col("v")))
    for _ in range(rounds):
        near = edges.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("other"))
        step = labels.join(near.withColumnRenamed("a", "v"), "v", "left").select("v", "label", F.least("label", F.coalesce("other", "label")).alias("new"))
        jumped = materialize(step.join(labels.select(F.col("v").alias("new"), F.col("label").alias("far")), "new").select("v", F.col("label").alias("old"), F.least("new", "far").alias("label")))
        if jumped.where("label <> old").isEmpty():
            break
        labels = jumped.select("v", "label")
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    degree = edges.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("n_links"))
    return members.withColumnRenamed("rep", "v").join(labels, "v").join(degree, "v", "left").select(id_col, F.col("label").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
