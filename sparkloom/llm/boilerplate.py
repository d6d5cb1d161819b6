"""Main body of web pages against their furniture: boosted trees over the nodes of a page, decoded as a tree.

A page is a tree: HTML is parsed into element nodes; plain text has blocks (parted by blank lines) of lines. The leaves
are lines. Features of a leaf: its own words and signs, attribute tokens (tag, class, id and role of its elements), density,
depth, place, and those of its siblings, its block and its page. Inner nodes (elements, blocks, the page)
have features of their own: density of the subtree, scores of its leaves and of the sibling nodes, place, depth, size,
attribute tokens.

No labels are needed: sources of type 'pdf' have no furniture, so their lines, and lines that repeat the page's title,
are body; the lines of other pages are unlabelled. Trees fitted to tell the two apart give body lines about even odds
and furniture next to none (learning from positives and unlabelled); a second fit, with the first one's clear answers
as labels, adds place, neighbours and attributes (which tell sources without furniture apart, so the first fit leaves them out); a third fit says of inner nodes whether any body lies under them. All read at most
SAMPLE pages of either sort chosen by hash (a parameter).

Decoding is hierarchical (`decode`): a leaf or node is kept only under kept ancestors. The worth of a node is its own
log-odds and the worth of its children worth keeping; nodes of no worth go with all they hold, so that no descendant
contradicts an ancestor, and a block can overrule a stray line.

Defined results: null and blank texts have no lines and an empty body; pages may be all body or all furniture.
"""

from __future__ import annotations

import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, hash_sample
from .gbt import BoostedTrees

SAMPLE = 1200
VOCABULARY = 320
_TOKEN = re.compile(r"[a-z]{2,}|\d+|[|>©•·@…¿?¡!«»“”:;,.()/–—-]")
_HTML = re.compile(r"(?i)<(?:html|body|div|p|ul|table|article|section)\b[^>]*>")
_SKIP = {"script", "style", "noscript", "template"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr"}


class _Dom(HTMLParser):
    """Leaves of an HTML page, and its element nodes as (parent, depth, tokens of tag and attributes); node 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, int]] = []
        self.nodes: list[tuple[int, int, list[str]]] = [(0, 0, [])]
        self.leaves: list[tuple[str, int, list[str], int, int]] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        named = [f"@{t}" for k, v in attrs if k in ("class", "id", "role") and v for t in re.findall(r"[a-z]+", v.lower())]
        self.nodes.append((self.path[-1][1] if self.path else 0, len(self.path) + 1, [f"<{tag}", *named]))
        self.path.append((tag, len(self.nodes) - 1))

    def handle_endtag(self, tag):
        for k in range(len(self.path) - 1, -1, -1):
            if self.path[k][0] == tag:
                del self.path[k:]
                break

    def handle_data(self, data):
        if data.strip() and not any(t in _SKIP for t, _ in self.path):
            tokens = [x for _, k in self.path[-4:] for x in self.nodes[k][2]]
            parent = self.path[-1][1] if self.path else 0
            self.leaves.append((" ".join(data.split()), len(self.path), tokens, self.nodes[parent][0], parent))


def tree(text: str) -> tuple[list[tuple], list[tuple[int, int, list[str]]]]:
    """Leaves (number from 1, text, depth, attribute tokens, block, parent node): each non-blank line, or text node of HTML; and the
    inner nodes (parent, depth, tokens), each behind its parent."""
    if text.count("<") > 4 and _HTML.search(text):
        dom = _Dom()
        dom.feed(text)
        return [(n, *x) for n, x in enumerate(dom.leaves, 1)], dom.nodes
    out, block = [], 1
    for n, line in enumerate(text.split("\n"), 1):
        if line.strip():
            out.append((n, line, 1, [], block, block))
        else:
            block += 1
    return out, [(0, 0, []), *[(0, 1, [])] * block]


def leaves(text: str) -> list[tuple]:
    return tree(text)[0]


def _terms(line: str) -> set[str]:
    """Words, signs, the first and the last of them, and pairs at the beginning."""
    t = _TOKEN.findall(fold(line))
    t = ["#" if x[0].isdigit() else x for x in t]
    return {*t, f"^{t[0]}", f"{t[-1]}$", *(f"{a}_{b}" for a, b in zip(t[:4], t[1:4]))} if t else set()


N_HASHED = 20


def _attributes(tokens: list[list[str]]) -> np.ndarray:
    """Attribute tokens of each row, hashed into N_HASHED columns."""
    out = np.zeros((len(tokens), N_HASHED), np.uint8)
    at = [(k, zlib.crc32(t.encode()) % N_HASHED) for k, own in enumerate(tokens) for t in own]
    if at:
        out[tuple(np.array(at).T)] = 1
    return out


N_LINE, N_DENSE = 5, 10
_CAPITAL = re.compile(r"(?<!\S)[A-ZÀ-ÖØ-Þ]")
_SIGN = re.compile(r"[^\w ]|_")


def _line_bins(line: str) -> tuple[int, ...]:
    """Bins of a line alone: length, word count, shares of capitals, digits and signs."""
    n, words = len(line), len(line.split())
    return (
        min(15, n.bit_length() * 2 - (n < 3 << max(0, n.bit_length() - 2))),
        min(15, words),
        min(15, 15 * len(_CAPITAL.findall(line)) // max(1, words)),
        min(15, 60 * sum(map(line.count, "0123456789")) // n),
        min(15, 60 * len(_SIGN.findall(line)) // n),
    )


def _place_bins(nodes, title: str) -> np.ndarray:
    """Bins of each leaf in its page: title likeness, depth, block's size and mean length, block density."""
    out = np.zeros((len(nodes), N_DENSE - N_LINE), np.uint8)
    blocks: dict[int, list[int]] = {}
    for x in nodes:
        b = blocks.setdefault(x[4], [0, 0, 0])
        n = len(x[1])
        b[0], b[1], b[2] = b[0] + 1, b[1] + n, b[2] + (n > 80)
    of = {b: (min(15, n), min(15, (size // n).bit_length()), min(15, 15 * dense // n)) for b, (n, size, dense) in blocks.items()}
    for k, x in enumerate(nodes):
        like = title and abs(len(x[1]) - len(title)) < 16 and fold(x[1]).strip(" .«»*-") == title
        out[k] = (1 if like else 0, min(15, x[2]), *of[x[4]])
    return out


N_INNER = 12


def _inner(page_leaves: list[list[tuple]], page_nodes: list[list[tuple]], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Inner nodes of many pages together: features, parents, depths, the parent node of each leaf, and the (leaf, ancestor) pairs."""
    parents, depths, leaf_parent, leaf_at, above, tokens, place, part = [], [], [], [], [], [], [], []
    at, first = 0, 0
    for own, nodes in zip(page_leaves, page_nodes):
        parents += [p + at for p, _, _ in nodes]
        depths += [d for _, d, _ in nodes]
        tokens += [t for _, _, t in nodes]
        for k, x in enumerate(own):
            n = x[5]
            leaf_parent.append(n + at)
            place.append(k), part.append(15 * k // len(own))
            while True:
                leaf_at.append(first + k), above.append(n + at)
                if n == 0:
                    break
                n = nodes[n][0]
        at, first = at + len(nodes), first + len(own)
    parents, depths, leaf_parent = np.array(parents, np.int64), np.array(depths, np.int64), np.array(leaf_parent, np.int64)
    leaf_at, above = np.array(leaf_at, np.int64), np.array(above, np.int64)
    size = np.array([len(x[1]) for own in page_leaves for x in own], float)
    n = np.bincount(above, minlength=at)
    one = np.maximum(1, n)
    mean = np.bincount(above, odds[leaf_at], at) / one
    high, low, start = np.full(at, -99.0), np.full(at, 99.0), np.full(at, 10**9)
    np.maximum.at(high, above, odds[leaf_at]), np.minimum.at(low, above, odds[leaf_at]), np.minimum.at(start, above, leaf_at)
    held = n > 0
    start = np.where(held, start, 0)
    place, part = np.array(place or [0]), np.array(part or [0])
    before, after = np.full(at, -99.0), np.full(at, -99.0)
    order = np.lexsort((np.arange(at), parents, ~held))
    same = (parents[order][1:] == parents[order][:-1]) & (depths[order][1:] > 0) & (depths[order][:-1] > 0) & held[order][1:] & held[order][:-1]
    before[order[1:][same]], after[order[:-1][same]] = mean[order[:-1][same]], mean[order[1:][same]]
    bins = lambda v: np.clip((v + 6) * 1.25, 0, 15).astype(np.uint8)
    log = lambda v: np.minimum(15, 2 * np.log2(v + 1)).astype(np.uint8)
    cols = [np.minimum(15, depths), log(n), bins(mean), bins(high), bins(low), log(np.bincount(above, size[leaf_at], at) / one), 15 * np.bincount(above, size[leaf_at] > 80, at) // one]
    cols += [np.minimum(15, place[start]), part[start], bins(before), bins(after), np.minimum(15, np.bincount(parents, minlength=at))]
    x = np.concatenate([np.stack(cols, axis=1).astype(np.uint8), _attributes(tokens)], axis=1)
    return x, parents, depths, leaf_parent, (leaf_at, above)


class BodyModel:
    """Vocabulary and the three fits."""

    #: Lines whose own score a worker keeps.
    KEPT = 100_000

    def __init__(self, pages: list[tuple[str, str, str]]) -> None:
        """pages: (text, title, source_type)."""
        self._kept: dict[str, tuple] = {}
        parsed = [(*tree(text), title, kind) for text, title, kind in sorted(pages)]
        parsed = [p for p in parsed if p[0]]
        rows: list[tuple[set[str], int]] = []
        dense, page_of = [], []
        for p, (nodes, _, title, kind) in enumerate(parsed):
            place = _place_bins(nodes, _title(title))
            dense.append(np.concatenate([np.array([_line_bins(x[1]) for x in nodes], np.uint8), place], axis=1))
            rows += [(_terms(x[1]), 1 if kind == "pdf" or like else 0) for x, like in zip(nodes, place[:, 0].tolist())]
            page_of += [p] * len(nodes)
        y = np.array([r[1] for r in rows], float)
        self.vocabulary: dict[str, int] = {}
        counts: dict[str, list[int]] = {}
        for terms, label in rows:
            for t in terms:
                counts.setdefault(t, [0, 0])[label] += 1
        n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())

        def worth(c: list[int]) -> float:
            a, b = (c[1] + 1) / n1, (c[0] + 1) / n0
            return abs(np.log(a / b)) * (a + b) if sum(c) >= 4 else 0.0

        for t in sorted(counts, key=lambda t: (-worth(counts[t]), t))[:VOCABULARY]:
            self.vocabulary[t] = len(self.vocabulary)
        self.usable = 0 < y.sum() < len(y)
        if not self.usable:
            return
        x = np.concatenate([np.concatenate(dense), self._bag([r[0] for r in rows])], axis=1)
        balance = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
        # Place tells pages of one kind from those of another, not body from furniture: blocks and depth are left out of the first fit.
        # Lines of one template share their features: each different row is fitted once, with the weight of all.
        own = np.concatenate([self._own(x), y[:, None].astype(np.uint8)], axis=1)
        _, one, inverse = np.unique(np.ascontiguousarray(own).view(np.dtype((np.void, own.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.first = BoostedTrees(60, 5).fit(own[one, :-1], y[one], np.bincount(inverse, balance))
        s = self.first.logit(self._own(x))
        clear = (y == 1) | (s < -2.2) | (s > -0.9)
        labels = np.where((y == 1) | (s > -0.9), 1.0, 0.0)
        z = self._context(x, s, np.array(page_of), _attributes([x[3] for p in parsed for x in p[0]]))
        self.second = BoostedTrees(30, 4).fit(z[clear], labels[clear])
        odds = self.second.logit(z)
        inner, _, _, _, (leaf_at, above) = _inner([p[0] for p in parsed], [p[1] for p in parsed], odds)
        body = np.bincount(above, np.where(clear, labels, odds > 0)[leaf_at], len(inner)) > 0
        held = np.bincount(above, minlength=len(inner)) > 0
        self.third = BoostedTrees(20, 3).fit(inner[held], body[held].astype(float))

    @staticmethod
    def _own(x: np.ndarray) -> np.ndarray:
        own = x.copy()
        own[:, N_LINE:N_DENSE] = 0
        return own

    def _bag(self, terms: list[set[str]]) -> np.ndarray:
        bag = np.zeros((len(terms), max(1, len(self.vocabulary))), np.uint8)
        v = self.vocabulary
        rows, cols = [], []
        for k, t in enumerate(terms):
            for w in t & v.keys():
                rows.append(k), cols.append(v[w])
        bag[rows, cols] = 1
        return bag

    @staticmethod
    def _context(x: np.ndarray, s: np.ndarray, page: np.ndarray, attributes: np.ndarray) -> np.ndarray:
        """Bins of the own score, the dense features, the siblings' scores and the place in the page; attributes."""
        own = np.clip((s + 6) * 1.25, 0, 15).astype(np.uint8)
        before, after = np.roll(own, 1), np.roll(own, -1)
        edge = np.roll(page, 1) != page
        last = np.roll(page, -1) != page
        before[edge], after[last] = 15, 15
        _, start, size = np.unique(page, return_index=True, return_counts=True)
        place = np.arange(len(page)) - np.repeat(start, size)
        part = (15 * place // np.maximum(1, np.repeat(size, size))).astype(np.uint8)
        return np.concatenate([own[:, None], before[:, None], after[:, None], np.minimum(place, 15).astype(np.uint8)[:, None], part[:, None], x[:, :N_DENSE], attributes], axis=1)

    def _scores(self, nodes: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Own bins and score of each leaf; those of lines met before are kept, up to KEPT."""
        kept = self._kept
        lines = [x[1] for x in nodes]
        new = set(lines).difference(kept)
        if new:
            if len(kept) + len(new) > self.KEPT:
                kept.clear()
                new = set(lines)
            new = sorted(new)
            bins = np.array([_line_bins(x) for x in new], np.uint8)
            x = np.concatenate([bins, np.zeros((len(new), N_DENSE - N_LINE), np.uint8), self._bag([_terms(x) for x in new])], axis=1)
            kept.update(zip(new, zip(bins.tolist(), self.first.logit(x).tolist())))
        got = [kept[x] for x in lines]
        return np.array([g[0] for g in got], np.uint8), np.array([g[1] for g in got])

    def classify(self, pages: list[tuple[str, str | None]]) -> list[list[tuple[int, str, bool, float]]]:
        """For each page (number, text, is body, log-odds) of its leaves."""
        trees = [tree(t) if t else ([], [(0, 0, [])]) for t, _ in pages]
        if not self.usable:
            return [[(x[0], x[1], True, 0.0) for x in nodes] for nodes, _ in trees]
        flat = [x for nodes, _ in trees for x in nodes]
        if not flat:
            return [[] for _ in pages]
        line, s = self._scores(flat)
        place = np.concatenate([_place_bins(nodes, _title(title)) for (nodes, _), (_, title) in zip(trees, pages) if nodes])
        page = np.repeat(np.arange(len(trees)), [len(nodes) for nodes, _ in trees])
        odds = self.second.logit(self._context(np.concatenate([line, place], axis=1), s, page, _attributes([x[3] for x in flat])))
        inner, parents, depths, leaf_parent, _ = _inner([t[0] for t in trees], [t[1] for t in trees], odds)
        kept = decode(parents, depths, self.third.logit(inner), leaf_parent, odds).tolist()
        out, at = [], 0
        values = odds.tolist()
        for nodes, _ in trees:
            out.append([(x[0], x[1], kept[k], values[k]) for k, x in enumerate(nodes, at)])
            at += len(nodes)
        return out


def _title(title: str | None) -> str:
    return fold(title).strip(" .«»*-") if title else ""


def decode(parents: np.ndarray, depths: np.ndarray, odds: np.ndarray, leaf_parent: np.ndarray, leaf_odds: np.ndarray) -> np.ndarray:
    """Which leaves to keep: the set of nodes and leaves of greatest total log-odds in which all have kept ancestors. Bottom up, a node's
    worth is its odds and the positive worths below it; top down, nodes of positive worth under kept ones are kept. The root's depth is 0."""
    worth = odds.astype(float).copy()
    np.add.at(worth, leaf_parent, np.maximum(0, leaf_odds))
    deepest = int(depths.max()) if len(depths) else 0
    levels = [np.nonzero(depths == d)[0] for d in range(deepest + 1)]
    for level in levels[:0:-1]:
        np.add.at(worth, parents[level], np.maximum(0, worth[level]))
    kept = worth > 0
    for level in levels[1:]:
        kept[level] &= kept[parents[level]]
    return kept[leaf_parent] & (leaf_odds > 0)


def train(df: DataFrame, text_col: str, title_col: str, type_col: str, sample: int = SAMPLE) -> BodyModel:
    """From at most `sample` pages of type pdf and `sample` others, the first by hash: the same on every run."""
    rows = df.select(F.col(text_col).alias("t"), F.coalesce(F.col(title_col), F.lit("")).alias("n"), F.col(type_col).alias("k")).where(F.length(F.trim("t")) > 0)
    kinds = (F.col("k") == "pdf", F.coalesce(F.col("k") != "pdf", F.lit(True)))
    return BodyModel([(r["t"], r["n"], r["k"] or "") for k in kinds for r in hash_sample(rows.where(k), ["t", "n"], sample).collect()])


def label_lines(df: DataFrame, id_col: str, text_col: str, title_col: str, type_col: str, model: BodyModel) -> DataFrame:
    """(id, line_no, is_body, log_odds) of each non-blank line; all lines of type pdf are body."""
    from .langid import held

    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        m = held(shared)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                out = []
                for i, t, lines in zip(part[id_col], part[type_col], m.classify(list(zip(part[text_col], part[title_col])))):
                    out += [(i, n, keep or t == "pdf", o) for n, _, keep, o in lines]
                cols = list(zip(*out)) if out else [[]] * 4
                yield pd.DataFrame({id_col: pd.Series(cols[0], dtype=pdf[id_col].dtype), "line_no": pd.Series(cols[1], dtype="int64"), "is_body": pd.Series(cols[2], dtype=bool), "log_odds": pd.Series(cols[3], dtype=float)})

    return df.select(id_col, text_col, title_col, type_col).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).mapInPandas(run, f"`{id_col}` {kind}, line_no bigint, is_body boolean, log_odds double")


def body_column(df: DataFrame, text_col: str, title_col: str, type_col: str, model: BodyModel, out_col: str = "body") -> DataFrame:
    """The rows with the body's lines alone; null stays null."""
    from .langid import held

    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def body(texts: pd.Series, titles: pd.Series, types: pd.Series) -> pd.Series:
        pages = held(shared).classify(list(zip(texts, titles)))
        return pd.Series([None if t is None else t if k == "pdf" else "\n".join(x for _, x, keep, _ in lines if keep) for t, k, lines in zip(texts, types, pages)], dtype=object)

    return df.withColumn(out_col, body(F.col(text_col), F.col(title_col), F.col(type_col)))
