"""Evaluation texts that leak into a corpus: a generalised suffix automaton of the normalised test items.

The automaton is built over words on the driver (the evaluation set is bounded: MAX_ITEM_WORDS, else items go in
blocks of that size, one automaton a block) and each corpus text is streamed through it once, tracking the longest match.

Defined results: null or empty texts match nothing; items shorter than min_words can't leak; repeated items are all reported.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, fold, words

MAX_ITEM_WORDS = 200_000


class SuffixAutomaton:
    """Over words of several items; items of a state: all that contain its strings."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], min_words: int) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        marks: dict[int, set[int]] = {}
        for item, tokens in items:
            last = 0
            for w in tokens:
                last = self._extend(last, w)
            state = 0
            for w in tokens:  # a second walk marks the prefixes' states
                state = self.next[state][w]
                marks.setdefault(state, set()).add(item)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if s in marks and self.link[s] > 0:
                marks.setdefault(self.link[s], set()).update(marks[s])
        self.min_words = min_words
        self.items = {s: tuple(sorted(v)) for s, v in marks.items() if self.length[s] >= min_words}

    def _extend(self, last: int, w: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: str, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def leaks(self, tokens: list[str]) -> dict[int, tuple[int, int]]:
        """item -> (longest run of words found, words of the text covered by its runs)."""
        nxt, link, length, least = self.next, self.link, self.length, self.min_words
        state = run = 0
        found: dict[int, list[int]] = {}
        root = nxt[0]
        for at, w in enumerate(tokens):
            step = nxt[state].get(w)
            if step is None:
                if w not in root:
                    state = run = 0
                    continue
                while state and w not in nxt[state]:
                    state = link[state]
                run = min(run, length[state])
                step = nxt[state][w]
            state = step
            run += 1
            if run >= least:
                s, size = state, run
                while s > 0 and size >= least:
                    for item in self.items.get(s, ()):
                        x = found.get(item)
                        if x is None:
                            found[item] = [size, at, size]  # longest, end of the last run, words covered
                        else:
                            x[0] = max(x[0], size)
                            x[2] += min(size, at - x[1])
                            x[1] = at
                    s = link[s]
                    size = length[s] if s > 0 else 0
        return {i: (x[0], x[2]) for i, x in found.items()}

    def covered(self, tokens: list[str]) -> list[bool]:
        """Whether each word of the text lies in a run of at least min_words that an item has."""
        nxt, link, length, least = self.next, self.link, self.length, self.min_words
        state = run = done = 0
        out = [False] * len(tokens)
        for at, w in enumerate(tokens):
            while state and w not in nxt[state]:
                state = link[state]
                run = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                run += 1
                if run >= least:
                    for k in range(max(done, at - run + 1), at + 1):
                        out[k] = True
                    done = at + 1
        return out


def _blocks(items: DataFrame, item_id: str, item_text: str, min_words: int) -> list[list[tuple[int, list[str]]]]:
    """Words of the items that can leak, in blocks of at most MAX_ITEM_WORDS."""
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    count = 0
    for r in items.select(item_id, item_text).where(F.col(item_id).isNotNull()).toLocalIterator():
        tokens = words(r[1])
        if len(tokens) < min_words:
            continue
        if count + len(tokens) > MAX_ITEM_WORDS and blocks[-1]:
            blocks.append([])
            count = 0
        count += len(tokens)
        blocks[-1].append((r[0], tokens))
    return blocks


def find_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 8) -> DataFrame:
    """(id, item_id, longest_words, covered_words) for each text and item that share at least min_words consecutive words."""
    spark = docs.sparkSession
    blocks = _blocks(items, item_id, item_text, min_words)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_id}` bigint, longest_words int, covered_words int"
    source = docs.select(id_col, text_col).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast((block, min_words))

        def run(batches, shared=shared):
            automaton = _automaton(shared)
            for pdf in batches:
                found = [(i, item, *x) for i, t in zip(pdf[id_col], pdf[text_col]) for item, x in automaton.leaks(words(t)).items()]
                a = list(zip(*found)) if found else [[], [], [], []]
                yield pd.DataFrame({id_col: pd.Series(a[0], dtype=pdf[id_col].dtype), item_id: pd.Series(a[1], dtype="int64"), "longest_words": pd.Series(a[2], dtype="int32"), "covered_words": pd.Series(a[3], dtype="int32")})

        part = source.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


_built: dict[int, SuffixAutomaton] = {}


def _automaton(shared) -> SuffixAutomaton:
    if shared.id not in _built if hasattr(shared, "id") else True:
        _built.clear()
        a = SuffixAutomaton(*shared.value)
        if not hasattr(shared, "id"):
            return a
        _built[shared.id] = a
    return _built[shared.id]


def remove_leaks(docs: DataFrame, id_col: str, leaks: DataFrame, min_words: int = 8, max_covered: int = 0) -> DataFrame:
    """The texts without those whose leaked runs reach min_words and cover more than max_covered words."""
    bad = leaks.where((F.col("longest_words") >= min_words) & (F.col("covered_words") > max_covered)).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti")


def _places(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Folded words of a text with where each starts and ends in the text itself."""
    folded = fold(text)
    found = list(WORD.finditer(folded))
    if len(folded) == len(text) and text.isascii():
        return [m.group() for m in found], [m.span() for m in found]
    origin = [k for k, c in enumerate(text) for _ in fold(c)] + [len(text)]  # marks that folding drops go with the letter before
    return [m.group() for m in found], [(origin[m.start()], origin[m.end()]) for m in found]


def leaked_spans(text: str, automata: list[SuffixAutomaton]) -> tuple[list[tuple[int, int]], float]:
    """(start and end of each run to be cut, share of the words they cover). What is left has no run either, also across a cut."""
    tokens, places = _places(text)
    kept, gone = list(range(len(tokens))), [False] * len(tokens)
    while kept:
        flags = [any(x) for x in zip(*(a.covered([tokens[k] for k in kept]) for a in automata))]
        if not any(flags):
            break
        for k, bad in zip(kept, flags):
            gone[k] = gone[k] or bad
        kept = [k for k in kept if not gone[k]]
    spans: list[tuple[int, int]] = []
    for k, bad in enumerate(gone):
        if bad:
            if k and gone[k - 1]:
                spans[-1] = (spans[-1][0], places[k][1])
            else:
                spans.append(places[k])
    return spans, sum(gone) / max(1, len(gone))


def cut_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 8, max_share: float = 0.5) -> DataFrame:
    """(id, clean_text, spans, share): the texts without their leaked runs of at least min_words; spans (start, end) of these in the
    text, share of its words. A text of which more than max_share is leaked is dropped whole; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast((_blocks(items, item_id, item_text, min_words), min_words))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        automata = [SuffixAutomaton(block, shared.value[1]) for block in shared.value[0]]
        for pdf in batches:
            out = []
            for i, text in zip(pdf[id_col], pdf[text_col]):
                spans, part = leaked_spans(text, automata) if text else ([], 0.0)
                if part <= max_share:
                    clean, at = text, 0
                    if spans:
                        clean = ""
                        for start, end in spans:
                            clean, at = clean + text[at:start], end
                        clean += text[at:]
                    out.append((i, clean, [{"start": a, "end": b} for a, b in spans], part))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pd.DataFrame({id_col: pd.Series(cols[0], dtype=pdf[id_col].dtype), "clean_text": pd.Series(cols[1], dtype=object), "spans": pd.Series(cols[2], dtype=object), "share": pd.Series(cols[3], dtype=float)})

    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, clean_text string, spans array<struct<start:int,end:int>>, share double")
