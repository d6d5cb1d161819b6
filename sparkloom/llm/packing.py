"""Filling containers of fixed capacity: best fit, then swap-based local search, in blocks of bounded size.

Sizes are tokens of a public tokenizer. Items are spread by hash into blocks of at most about BLOCK items (no key, so no
hot group); each block is packed on its own, so that no task grows with the data.

Defined results: an item longer than the capacity is split into pieces of the capacity, numbered from 0; a null or
empty text has 0 tokens and goes into a container like any other; repeated texts are separate items; rows with a null id are left out.
"""

from __future__ import annotations

import base64
import bisect
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 20_000
#: Passes of the local search, and how far one look reaches. They bound effort, not the input: whatever they leave stays packed as it was.
PASSES, REACH = 12, 24
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the public byte-level vocabulary splits texts before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a tiktoken vocabulary file, loaded once a worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens), whole texts; null counts 0."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(vocabulary).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return df.select(id_col, count(F.col(text_col)).alias("n_tokens"))


class Bins:
    """Bins of a capacity: items are (index, size)."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.order: list[tuple[int, int]] = []  # (free space, bin), sorted

    def put(self, item: int, size: int) -> bool:
        """Into the bin that it leaves fullest; False if none but a new one would do."""
        at = bisect.bisect_left(self.order, (size, -1))
        if at == len(self.order):
            return False
        free, b = self.order.pop(at)
        self.items[b].append(item)
        self.fill[b] += size
        bisect.insort(self.order, (free - size, b))
        return True

    def open(self, item: int, size: int) -> None:
        self.items.append([item])
        self.fill.append(size)
        bisect.insort(self.order, (self.capacity - size, len(self.items) - 1))


def best_fit(sizes: list[int], capacity: int) -> Bins:
    bins = Bins(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if not bins.put(i, sizes[i]):
            bins.open(i, sizes[i])
    return bins


def pack(sizes: list[int], capacity: int, passes: int = PASSES, reach: int = REACH) -> list[int]:
    """The bin of each item. Best fit in falling order; then local search (`_pass`) until a pass changes nothing, the bound is reached, or
    `passes` are over. Each change raises the sum of squared fills, so the search ends; bins that become empty are gone."""
    bins = best_fit(sizes, capacity)
    least = math.ceil(sum(sizes) / capacity)
    for _ in range(passes):
        if sum(1 for x in bins.items if x) <= least or not _pass(bins, sizes, reach):
            break
    where = [0] * len(sizes)
    for number, items in enumerate(x for x in bins.items if x):
        for i in items:
            where[i] = number
    return where


def _pass(bins: Bins, sizes: list[int], reach: int) -> int:
    """Every underfull bin, the fullest first, takes what fills it best: an item of another bin (a move), one for one of its own, two of
    another for one of its own, or one for two of its own, as long as that raises the sum of squared fills. `reach`: places of the sorted
    sizes, and emptiest bins, that one look tries. Returns how many changes were made."""
    cap, fill, items = bins.capacity, bins.fill, bins.items
    order = sorted((b for b in range(len(fill)) if items[b] and fill[b] < cap), key=lambda b: (-fill[b], b))
    at = {i: b for b in order for i in items[b]}
    ranked = sorted(at, key=lambda i: (sizes[i], i))
    ladder = [sizes[i] for i in ranked]
    emptiest = order[::-1][:reach]
    changes = 0

    def fitting(low: int, high: int, b: int) -> int | None:
        """The largest item of a size in (low, high] in another bin whose loss raises the sum of squares."""
        k = bisect.bisect_right(ladder, high) - 1
        for k in range(k, max(-1, k - reach), -1):
            if ladder[k] <= low:
                return None
            i = ranked[k]
            if at[i] != b and fill[b] + ladder[k] - low > fill[at[i]]:
                return i
        return None

    for b in order:
        while items[b] and fill[b] < cap:
            free, best = cap - fill[b], (0, [], [])  # gain, items that come, items that go
            if (i := fitting(0, free, b)) is not None:
                best = (sizes[i], [i], [])
            own = sorted(items[b], key=lambda i: sizes[i])
            for n, x in enumerate(own):
                if best[0] == free:
                    break
                for gone in ([x], *([x, z] for z in own[n + 1 : n + 1 + reach])):
                    out = sum(sizes[g] for g in gone)
                    if (i := fitting(out, out + free, b)) is not None and sizes[i] - out > best[0]:
                        best = (sizes[i] - out, [i], gone)
            if best[0] < free and len(own) <= reach:
                for c in emptiest:
                    if c == b or not items[c] or fill[c] > fill[b]:
                        continue
                    two = sorted(items[c], key=lambda i: sizes[i])[:reach]
                    for n, y in enumerate(two):
                        if best[0] < sizes[y] <= free:
                            best = (sizes[y], [y], [])
                        for z in two[n + 1 :]:
                            both = sizes[y] + sizes[z]
                            k = bisect.bisect_left(own, both - free, key=lambda i: sizes[i])
                            if k < len(own) and best[0] < both - sizes[own[k]] <= free:
                                best = (both - sizes[own[k]], [y, z], [own[k]])
            gain, come, gone = best
            if not gain:
                break
            c = at[come[0]]
            for i in come:
                items[c].remove(i), items[b].append(i)
                at[i] = b
            for i in gone:
                items[b].remove(i), items[c].append(i)
                at[i] = c
            fill[b], fill[c] = fill[b] + gain, fill[c] - gain
            changes += 1
    return changes


def pack_table(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(id, piece_no, container_id, n_tokens): every row's pieces, once each."""
    from .common import materialize

    sized = materialize(token_counts(df.where(F.col(id_col).isNotNull()), id_col, text_col, vocabulary))
    blocks = max(1, math.ceil(sized.count() / block))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        ids, pieces, sizes, at = [], [], [], None
        for pdf in batches:
            for i, n, where in zip(pdf[id_col], pdf["n_tokens"], pdf["block"]):
                at = where
                for p in range(max(1, -(-n // capacity))):
                    ids.append(i), pieces.append(p), sizes.append(min(capacity, n - p * capacity))
        if ids:
            bins = pack(sizes, capacity)
            yield pd.DataFrame({id_col: ids, "piece_no": pieces, "container_id": [f"{at}-{b}" for b in bins], "n_tokens": sizes})

    # One block a group: applyInPandas over the block number, which no data can skew.
    def block_of(pdf: pd.DataFrame) -> pd.DataFrame:
        return next(run([pdf]))

    spread = sized.withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(blocks)))
    return spread.groupBy("block").applyInPandas(block_of, f"`{id_col}` {kind}, piece_no int, container_id string, n_tokens int")
