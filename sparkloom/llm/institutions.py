"""Names of institutions typed by people: variant spellings, and records of other tables that mean the same institution.

A name is parsed into the kind of institution (words of four languages, their abbreviations and misspellings), the words
left over (its proper name) and possible acronyms. All words of the proper names of the reference list are put into MinHash
bands over padded q-grams, with bands tuned from the collision curve; a query's words meet the reference words of their
buckets and are verified by Monge-Elkan similarity over all words of the record, weighted by their rarity in the list, with
Damerau-Levenshtein inside. A record whose name is made of common words alone (a country, 'Norte') is indexed by these and
found by the same kind and words only. Records of the list that name one institution, and all spellings, form stars around
the record with the lowest id; names that each have a word the other lacks aren't one.

The reference list goes to the workers in blocks of at most BLOCK records (usually one), so its size is bounded; the
other table is never shuffled by name, so a spelling that holds a third of all rows makes no hot task.

Defined results: null, blank and uninformative names match nothing by name; equal scores go to the lowest id.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, hash_sample, materialize, mix64, seeds, tune_bands
from .gbt import Logistic

BLOCK = 50_000
#: Bound of the rows on which the match classifier is fitted.
SAMPLE = 4000

# Words for the kind of an institution, by letter.
KINDS = {
    "U": "universidad universidade university univ uni universite u",
    "I": "instituto institute inst i",
    "N": "nacional national nal nac",
    "C": "catolica catholic cat cato",
    "P": "pontificia pontifical pont",
    "T": "tecnologica tecnologico technological technology tecnol tecno tec tech",
    "L": "politecnica polytechnic politec polit poli polo",
    "A": "autonoma autonomous aut auto",
    "F": "federal fed",
    "E": "estadual estatal state est",
}
# Kinds as acronyms begin with them.
CODES = {"U": "u", "CU": "uc", "CPU": "puc", "NU": "un", "TU": "ut", "LU": "up", "AU": "ua", "FU": "uf", "EU": "ue", "FI": "if", "IT": "it"}
# Words around a name that say nothing of the institution.
NOISE = set(
    "de del da do dos das of la el los las o a e the y and en em at facultad faculdade faculty ciencias sciences science dpto departamento department "
    "fisica physics esc escuela escola school posgrado graduate campus norte sede central main".split()
)
#: Those of them that never tell two names apart.
FUNCTION = set("de del da do dos das of la el los las o a e the y and en em at".split())
#: Least share of a record's words, by rarity, that a name must have.
LEAST = 0.7
# Names and codes of countries.
COUNTRIES = {
    "AR": "argentina", "BO": "bolivia", "BR": "brasil brazil", "CL": "chile", "CO": "colombia", "CR": "costa rica|costarica", "EC": "ecuador",
    "MX": "mexico", "PA": "panama", "PE": "peru", "UY": "uruguay",
}
_COUNTRY = {n: c for c, names in COUNTRIES.items() for n in (names.split("|") if "|" in names else names.split())} | {c.lower(): c for c in COUNTRIES}
_KIND = {w: k for k, ws in KINDS.items() for w in ws.split()}
_BY_CODE = {v: frozenset(k) for k, v in CODES.items()}
_LONG = [w for w in _KIND if len(w) >= 4]
_LETTERS = {w: set(w) for w in _LONG}
_SHORT = "nal nac cat cato tec aut fed est poli inst univ".split()
_DOTTED = re.compile(r"\b(?:[a-z]{1,2}\.){2,}(?:[a-z]\b)?")
_TOKEN = re.compile(r"[^\W\d_]+")


def country_code(value: str | None) -> str | None:
    """Code of a country written by name or code; None if it is neither."""
    return _COUNTRY.get(" ".join(_TOKEN.findall(fold(value)))) if value else None


def distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein (adjacent transpositions), or most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


@lru_cache(maxsize=200_000)
def kind_of(token: str) -> str | None:
    """Letter of the kind a word stands for, misspelt or not."""
    if (k := _KIND.get(token)) or len(token) < 3:
        return k
    if len(token) <= 4:  # an abbreviation with one wrong letter
        near = {_KIND[w] for w in _SHORT if w != token and distance(token, w, 1) <= 1 and (len(w) == len(token) or len(w) == 4)}
        return near.pop() if len(near) == 1 else None
    best, letters = None, set(token)
    for w in _LONG:
        most = 1 if len(w) < 8 else 2
        # An edit changes at most two of the letters in use.
        if len(w) > 4 and abs(len(w) - len(token)) <= most and len(letters ^ _LETTERS[w]) <= 2 * most and (d := distance(token, w, most)) <= most and (best is None or d < best[0]):
            best = (d, _KIND[w])
    return best[1] if best else None


class Parsed:
    __slots__ = ("kinds", "words", "acronyms", "weak")

    def __init__(self, kinds: frozenset[str], words: list[str], acronyms: list[str], weak: frozenset[str] = frozenset()) -> None:
        self.kinds, self.words, self.acronyms, self.weak = kinds, words, acronyms, weak


def parse(name: str | None) -> Parsed:
    """Kinds, words of the proper name, tokens that may be acronyms, and the weak words: common or short ones."""
    kinds, words, acronyms, weak = set(), [], [], set()
    text = _DOTTED.sub(lambda m: f" {m.group().replace('.', '')} ", fold(name or "")).replace("costa rica", " costarica ")
    tokens = _TOKEN.findall(text)
    for t in tokens:
        if t in NOISE or t in _COUNTRY:
            if t not in FUNCTION and len(t) > 2:
                weak.add(t)
            continue
        if t in _BY_CODE and t != "u":
            kinds |= _BY_CODE[t]
        elif k := kind_of(t):
            kinds.add(k)
        elif len(t) >= 3:
            if len(t) >= 4:
                words.append(t)
            else:
                weak.add(t)
            if len(t) <= 12:
                acronyms.append(t)
    return Parsed(frozenset(kinds), words, acronyms, frozenset(weak))


def grams(word: str, q: int = 2) -> list[str]:
    """Padded q-grams."""
    w = "#" * (q - 1) + word + "#" * (q - 1)
    return [w[i : i + q] for i in range(len(w) - q + 1)]


class Index:
    """A block of the reference list: (id, name, country, city)."""

    def __init__(self, rows: list[tuple[int, str, str | None, str | None]], similarity: float = 0.5, recall: float = 0.97, hashes: int = 96) -> None:
        self.bands, self.rows = tune_bands(similarity, recall, hashes)
        self.seeds = seeds(self.bands * self.rows)
        self.ref: list[tuple[int, frozenset[str], str | None, str | None, str]] = []  # id, kinds, country, folded city, place
        self.acronym: dict[str, set[int]] = {}
        self.alien: set[str] = set()
        self.own: dict[int, set[str]] = {}
        self.words_of: list[tuple[str, ...]] = []
        self.weak_of: list[frozenset[str]] = []
        self.weak_places: dict[str, list[int]] = {}
        self._cities: dict[str, set[int]] = {}
        places: dict[str, list[int]] = {}
        for i, name, country, city in sorted(rows):
            p = parse(name)
            inside = re.search(r"\(([^)]*)\)", name or "")
            acronym = fold(inside.group(1)) if inside and _TOKEN.fullmatch(fold(inside.group(1))) else None
            words = list(dict.fromkeys(w for w in p.words if w != acronym))
            code = CODES.get("".join(sorted(p.kinds)), "?")
            beside = [a for a in words if a.startswith(code) and len(a) > len(code) + 1 and any(w != a and w.startswith(a[len(code) :]) for w in words)]
            words = [w for w in words if w not in beside]
            weak = p.weak - {acronym}
            if not words and not weak and acronym is None and not p.kinds:
                continue  # nothing but signs: such a name names nothing
            place = max(words, key=len) if words else max(sorted(weak), key=len, default=acronym or "")
            n = len(self.ref)
            self.ref.append((i, p.kinds, country_code(country), fold(city) if city else None, place))
            self.words_of.append(tuple(words))
            self.weak_of.append(weak)
            for w in words:
                places.setdefault(w, []).append(n)
            if not words:
                for w in weak:
                    self.weak_places.setdefault(w, []).append(n)
            self.own[n] = {a for a in (acronym, *beside) if a}
        self.places = places
        # Rarity of each word in the list.
        self.rarity = {w: float(np.log(1 + len(self.ref) / len(ns))) for w, ns in places.items()}
        self.words: list[str] = []
        self.grams_of: list[frozenset[str]] = []
        self.bucket: dict[tuple[int, int], list[int]] = {}
        self.foreign: set[int] = set()
        self._kept: dict[str, list[tuple[int, float]]] = {}
        self._add(list(places))
        # Stars: records of one kind (or its short form), country and (but for a misspelling) place; the centre is the lowest id.
        self.centre = list(range(len(self.ref)))
        self._acronyms()
        self.warm(set(self.words))
        for n, (_, kinds, country, _, place) in enumerate(self.ref):
            near = [(m, s) for m, s in self.alike(self.words_of[n]).items() if self.one_way(n, m) >= 0.77 and not self.conflict(n, m)]
            if not self.words_of[n]:
                near = [(m, 1.0) for m in self.weak_places.get(place, ()) if self.weak_of[m] == self.weak_of[n]]
            if not kinds and self.words_of[n]:  # a record that is an acronym alone
                near += [(m, 1.0) for m in self.by_acronym(place)]
            for m, s in near:
                c = self.centre[m]
                alike = self.ref[m][1] == kinds or relation(kinds, self.ref[m][1]) >= 0.8 or not kinds or relation(self.ref[m][1], kinds) >= 0.8
                if c != n and m != n and alike and s >= 0.77 and (country is None or self.ref[m][2] in (None, country)):
                    low, high = min(c, self.centre[n]), max(c, self.centre[n])
                    self.centre = [low if x == high else x for x in self.centre]
        for n, c in enumerate(self.centre):
            # The star's kind is that of its fullest name.
            if c != n and len(self.ref[n][1]) > len(self.ref[c][1]):
                i, _, country, city, place = self.ref[c]
                self.ref[c] = (i, self.ref[n][1], country, city, self.ref[n][4] if not self.ref[c][1] else place)
            self.own[c] = self.own[c] | self.own[n]
            if c != n and not self.ref[n][1]:
                self.own[c] = self.own[c] | {self.ref[n][4]}
        self._acronyms()

    def alike(self, words: tuple[str, ...] | list[str]) -> dict[int, float]:
        """Monge-Elkan similarity of the records that share a word with these: each of the record's words against its best one, by rarity."""
        met: dict[int, dict[str, float]] = {}
        for w in words:
            near = self.near(w)
            alien = max((s for k, s in near if k in self.foreign), default=0.0)
            for k, s in near:
                if s < 1 and s <= alien:  # an unlisted place is as near
                    continue
                own = self.words[k]
                for n in self.places[own]:
                    best = met.setdefault(n, {})
                    if s > best.get(own, 0.0):
                        best[own] = s
        return {n: self._mean(n, best) for n, best in met.items()}

    def _mean(self, n: int, best: dict[str, float]) -> float:
        own = self.words_of[n]
        if len(own) == 1:
            return best[own[0]]
        return sum(self.rarity[w] * best.get(w, 0.0) for w in own) / sum(self.rarity[w] for w in own)

    def one_way(self, n: int, m: int) -> float:
        """Monge-Elkan similarity the other way round: record n's words against those of m."""
        return self.alike(self.words_of[m]).get(n, 0.0)

    def conflict(self, n: int, m: int) -> bool:
        """Whether either name has a weak word that the other lacks, words of schools and subjects aside; countries count by code."""
        a, b = ({_COUNTRY.get(w, w) for w in self.weak_of[x] if w not in NOISE or w in ("norte", "central")} for x in (n, m))
        return bool(a - b and b - a)

    def _add(self, words: list[str]) -> None:
        first = len(self.words)
        self.words += words
        self.grams_of += [frozenset(grams(w)) for w in words]
        if words:
            for k, row in enumerate(self._keys(words), first):
                for b, key in enumerate(row.tolist()):
                    self.bucket.setdefault((b, key), []).append(k)
        self._kept = {}

    def settle(self, stats: list[tuple[str, str, int, int]]) -> None:
        """What all names together tell (see `name_statistics`): words that many spellings have and that only resemble a listed
        place are places of their own, unlisted; acronyms beside full names belong to those, listed or not."""
        own = sorted({k for what, k, _, _ in stats if what == "w" and k not in self.places})
        self.places |= {w: [] for w in own}
        self.foreign |= set(range(len(self.words), len(self.words) + len(own)))
        self._add(own)
        best: dict[str, tuple[int, int]] = {}
        for what, a, n, k in sorted(stats):
            if what == "a" and k > best.get(a, (0, 0))[0]:
                best[a] = (k, n)
        alien = {a for what, a, _, k in stats if what == "x" and k > best.get(a, (0, 0))[0]}
        self.learn([(a, n) for a, (_, n) in best.items() if a not in alien])
        for a in alien:
            self.derived.pop(a, None)
        self.alien = alien

    def _acronyms(self) -> None:
        """Acronyms that are known; and of records without one, the beginnings of their places behind the code of their kind."""
        self.acronym, self.derived = {}, {}
        for n, (_, kinds, _, _, place) in enumerate(self.ref):
            if self.centre[n] != n:
                continue
            for a in self.own[n]:
                self.acronym.setdefault(a, set()).add(n)
            code = CODES.get("".join(sorted(kinds)))
            if code and not self.own[n]:
                for k in range(2, min(8, len(place)) + 1):
                    if code + place[:k] not in self.alien:
                        self.derived.setdefault(code + place[:k], set()).add(n)

    def learn(self, seen: list[tuple[str, int]]) -> None:
        """Acronyms met beside full names: (acronym, record)."""
        for a, n in seen:
            self.own[self.centre[n]] = self.own[self.centre[n]] | {a}
        self._acronyms()

    def _keys(self, words: list[str]) -> np.ndarray:
        """Band keys of each word."""
        flat = [g for w in words for g in grams(w)]
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        h = np.array([_gram_hash(g) for g in flat], np.uint64)
        starts = np.cumsum(sizes) - sizes
        out = np.zeros((len(words), self.bands), np.uint64)
        with np.errstate(over="ignore"):
            for b in range(self.bands):
                for r in range(self.rows):
                    out[:, b] = mix64(out[:, b] * np.uint64(31) + np.minimum.reduceat(mix64(h * self.seeds[b * self.rows + r]), starts))
        return out

    def warm(self, words: set[str]) -> None:
        """Similar reference words of all these at once."""
        if len(self._kept) > 300_000:
            self._kept.clear()
        new = [w for w in words if w not in self._kept]
        if not new:
            return
        bucket, bands = self.bucket, range(self.bands)
        for w, row in zip(new, self._keys(new)):
            met: dict[int, int] = {}
            for b, key in zip(bands, row.tolist()):
                for k in bucket.get((b, key), ()):
                    met[k] = met.get(k, 0) + 1
            whole = [k for k, n in met.items() if n == bands.stop and self.words[k] == w]
            out = []
            own = set(grams(w))
            for k in whole or met:
                other = self.words[k]
                size = max(len(w), len(other))
                most = 0 if k in whole else 1 if size < 9 else 2
                # An edit spoils at most three padded bigrams (a transposition).
                if abs(len(w) - len(other)) <= most and len(own.intersection(self.grams_of[k])) >= len(own) - 3 * most:
                    d = distance(w, other, most)
                    if d <= most:
                        out.append((k, 1 - d / size))
            self._kept[w] = sorted(out, key=lambda x: (-x[1], x[0]))

    def near(self, word: str) -> list[tuple[int, float]]:
        if word not in self._kept:
            self.warm({word})
        return self._kept[word]

    def candidates(self, p: Parsed) -> list[tuple[int, float, float, bool, float]]:
        """(record, similarity of the proper name, relation of the kinds, met by an acronym, share of the name that the record explains);
        centres only. By Monge-Elkan over all words of the record; names of weak words alone must have them all, and the kind."""
        best: dict[int, tuple[float, float, bool, float]] = {}
        size = max(1, len(p.words) + len(p.weak))
        for m, s in self.alike(p.words).items():
            if s < LEAST:
                continue
            c = self.centre[m]
            r = relation(p.kinds, self.ref[m][1])
            held = (len(self.words_of[m]) + len(self.weak_of[m] & p.weak) - 0.5 * len(self.weak_of[m] - p.weak)) / size
            if c not in best or (r > 0, s, held, r) > (best[c][1] > 0, best[c][0], best[c][3], best[c][1]):
                best[c] = (s, r, False, held)
        if not p.words:
            for m in {m for w in p.weak for m in self.weak_places.get(w, ())}:
                if self.weak_of[m] <= p.weak and p.kinds == self.ref[m][1]:
                    best[self.centre[m]] = (1.0, 1.0, False, len(self.weak_of[m]) / size)
        for a in p.acronyms:
            for n in self.by_acronym(a):
                r = relation(p.kinds, self.ref[n][1])
                s = max(best.get(n, (0.0,))[0], 0.95)
                best[n] = (s, r if p.kinds and r else 0.9, True, 1.0)
        return [(n, *x) for n, x in best.items()]

    def beside(self, p: Parsed, records: set[int]) -> list[tuple[int, float, float, bool, float]]:
        """Candidates as above among records that the city or the web address names, for a name that no band brought: words may be
        misspelt in up to a third of their letters, but none that is an unlisted place of its own."""
        if not p.words or any(k in self.foreign and s == 1 for w in p.words for k, s in self.near(w)):
            return []
        out = []
        for n in sorted(records):
            own = self.words_of[n]
            best = {}
            for w in own:
                most = max(1, len(w) // 3)
                best[w] = max(0.0, *(1 - d / max(len(w), len(x)) if (d := distance(x, w, most)) <= most else 0.0 for x in p.words))
            if own and (s := self._mean(n, best)) >= 0.66:
                out.append((n, s, relation(p.kinds, self.ref[n][1]), False, len(own) / (len(p.words) + len(p.weak))))
        return out

    def in_city(self, city: str) -> set[int]:
        """Centres whose record, or a record of their star, has that city."""
        if not self._cities:
            for n, c in enumerate(self.centre):
                if self.ref[n][3]:
                    self._cities.setdefault(self.ref[n][3], set()).add(c)
        return self._cities.get(city, set())

    def by_acronym(self, a: str) -> set[int]:
        """Records an acronym can mean: those that have it; else the one whose kind and place begin with it, if only one does."""
        if a in self.acronym:
            return self.acronym[a]
        found = self.derived.get(a, set())
        return found if len(found) == 1 and len(a) >= 4 else set()

    def best(self, name: str | None) -> tuple[int, float] | None:
        """(record, score) a name alone speaks for."""
        p = parse(name)
        out = None
        for n, s, r, _, held in sorted(self.candidates(p)):
            if r > 0:
                key = (r >= 0.9, round(s, 6), held, r)
                if out is None or key > out[0]:
                    out = (key, n, s * (0.5 + r / 2))
        return (out[1], out[2]) if out else None


def relation(asked: frozenset[str], has: frozenset[str]) -> float:
    """Of the kinds a name gives to a record's: 1 the same, less if it leaves some out, 0 if it has one the record lacks."""
    if asked == has:
        return 1.0
    if not asked:
        return 0.5
    if asked < has and asked not in (frozenset("U"), frozenset("CU")):  # a plain university isn't the short form of another
        return 0.8
    return 0.0


@lru_cache(maxsize=100_000)
def _gram_hash(g: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(g)


def reference_blocks(ref: DataFrame, id_col: str, name_col: str, country_col: str, city_col: str, block: int = BLOCK) -> list[list[tuple]]:
    """The list in blocks of at most `block` records; one holds any list up to that size."""
    rows = ref.select(id_col, name_col, country_col, city_col).where(F.col(id_col).isNotNull() & F.col(name_col).isNotNull()).orderBy(id_col)
    blocks: list[list[tuple]] = [[]]
    for r in rows.toLocalIterator():
        if len(blocks[-1]) == block:
            blocks.append([])
        blocks[-1].append((r[0], r[1], r[2], r[3]))
    return blocks


def _index(shared):
    from .langid import held

    return held(shared)


def acronyms_beside_names(index: Index, names: list[str | None]) -> list[tuple[str, int]]:
    """(acronym, record) where a name holds both a full proper name and an acronym of its kind and place."""
    out = []
    parsed = [parse(x) for x in names]
    index.warm({w for p in parsed for w in p.words})
    for p in parsed:
        if len(p.acronyms) < 2 or not p.words:
            continue
        for n, s, r, _, _ in index.candidates(p):
            if s > 0.85 and r == 1.0:
                code = CODES.get("".join(sorted(index.ref[n][1])), "?")
                out += [(a, n) for a in p.acronyms if a.startswith(code) and len(a) > len(code) + 1 and index.ref[n][4].startswith(a[len(code) :])]
    return out


def name_statistics(names: DataFrame, index: Index, least: int = 3, share: float = 0.1) -> list[tuple[str, str, int, int]]:
    """Over all different names: ('w', word, near, spellings) of words that resemble a listed place and that at least three spellings
    have, and a tenth as many as have the place itself; rarer ones are misspellings and never reach the driver; ('a', acronym, record, spellings)
    of acronyms beside a full listed name, ('x', acronym, -1, spellings) of those beside an unlisted one that a listed one could have.
    Each is bounded by the reference list and its neighbourhood, not by the data."""
    from collections import Counter

    shared = names.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = _index(shared)
        for pdf in batches:
            counts: Counter = Counter()
            parsed = [parse(x) for x in pdf["spelling"]]
            ix.warm({w for p in parsed for w in p.words})
            for name, p in zip(pdf["spelling"], parsed):
                for w in set(p.words):
                    if near := ix.near(w):
                        counts["e" if w in ix.places else "w", w, near[0][0]] += 1
                if len(p.acronyms) > 1:
                    known = acronyms_beside_names(ix, [name])
                    for a, n in known:
                        counts["a", a, n] += 1
                    code = CODES.get("".join(sorted(p.kinds)))
                    if not known and code:
                        for a in p.acronyms:
                            if a in ix.derived and a.startswith(code) and any(len(w) > len(a) and w.startswith(a[len(code) :]) and not ix.near(w) for w in p.words):
                                counts["x", a, -1] += 1
            rows = [(*k, n) for k, n in counts.items()]
            yield pd.DataFrame(rows, columns=["what", "k", "ref", "n"]).astype({"what": object, "k": object, "ref": "int64", "n": "int64"})

    found = materialize(names.mapInPandas(run, "what string, k string, ref bigint, n bigint").groupBy("what", "k", "ref").agg(F.sum("n").alias("n")))
    listed = found.where("what = 'e'").select("ref", F.col("n").alias("held"))
    words = found.where((F.col("what") == "w") & (F.col("n") >= least)).join(listed, "ref", "left").where(F.col("n") >= share * F.coalesce("held", F.lit(0))).select("what", "k", "ref", "n")
    return [(r["what"], r["k"], r["ref"], r["n"]) for r in found.where("what in ('a', 'x')").unionByName(words).collect()]


def link_spellings(names: DataFrame, name_col: str, ref: DataFrame, id_col: str, ref_name: str, country_col: str, city_col: str) -> DataFrame:
    """(id, spelling, similarity): each different spelling of `names`, and of the list, with the lowest record of its institution."""
    spark = names.sparkSession
    blocks = reference_blocks(ref, id_col, ref_name, country_col, city_col)
    distinct = names.select(F.col(name_col).alias("spelling")).unionByName(ref.select(F.col(ref_name).alias("spelling"))).where(F.trim("spelling") != "").distinct()
    distinct = materialize(distinct)
    parts = []
    for rows in blocks:
        index = Index(rows)
        index.learn(acronyms_beside_names(index, [r[1] for r in rows]))
        index.settle(name_statistics(distinct, index))
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            ix = _index(shared)
            for pdf in batches:
                parsed = [parse(x) for x in pdf["spelling"]]
                ix.warm({w for p in parsed for w in p.words})
                found = [(ix.ref[b[0]][0], x, b[1]) for x in pdf["spelling"] if (b := ix.best(x))]
                cols = list(zip(*found)) if found else [[]] * 3
                yield pd.DataFrame({id_col: pd.Series(cols[0], dtype="int64"), "spelling": pd.Series(cols[1], dtype=object), "similarity": pd.Series(cols[2], dtype=float)})

        parts.append(distinct.mapInPandas(run, f"`{id_col}` bigint, spelling string, similarity double"))
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("spelling").agg(F.min_by(id_col, F.struct(-F.col("similarity"), F.col(id_col))).alias(id_col), F.max("similarity").alias("similarity")).select(id_col, "spelling", "similarity")


_HOST = re.compile(r"(?i)^\s*(?:[a-z]+://)?([^/\s?#]+)")
_INSTITUTIONAL = re.compile(r"([^.]+)\.(?:edu|ac|gob|gov)\.([a-z]{2})(?:\.|$)")


def host_of(url: str | None) -> tuple[str, str] | None:
    """(name under the academic domain, country code) of an institutional address."""
    m = _HOST.match(url or "")
    m = _INSTITUTIONAL.search(fold(m.group(1))) if m else None
    return (m.group(1), m.group(2).upper()) if m else None


def host_statistics(records: DataFrame, index: Index) -> list[tuple[str, int]]:
    """(name under the academic domain, record) of each institutional host that most rows with a full name give to that record, over
    all rows: a host whose rows name chiefly other institutions, listed elsewhere or nowhere, is none of the list. Counted and chosen
    by the cluster; a pair reaches the driver for each host that a listed institution could have."""
    shared = records.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        from collections import Counter

        ix = _index(shared)
        for pdf in batches:
            counts: Counter = Counter()
            rows = [(name, h) for name, urls in zip(pdf["institution"], pdf["urls"]) if (h := next((h for h in map(host_of, [] if urls is None else urls) if h), None))]
            parsed = {name: parse(name) for name, _ in rows}
            ix.warm({w for p in parsed.values() for w in p.words})
            meant = {name: ix.best(name) for name in parsed}
            for name, (label, country) in rows:
                b = meant[name]
                if b and b[1] > 0.95 and ix.ref[b[0]][2] == country:
                    n = b[0]
                    counts[label, country, n if label.startswith(CODES.get("".join(sorted(ix.ref[n][1])), "?")) else -1] += 1
                elif parsed[name].words and (not b or b[1] > 0.95):
                    counts[label, country, -1] += 1
            got = [(*k, n) for k, n in counts.items()]
            yield pd.DataFrame(got, columns=["label", "country", "ref", "n"]).astype({"label": object, "country": object, "ref": "int64", "n": "int64"})

    found = records.select("institution", "urls").mapInPandas(run, "label string, country string, ref bigint, n bigint").groupBy("label", "country", "ref").agg(F.sum("n").alias("n"))
    best = found.groupBy("label", "country").agg(F.max_by("ref", F.struct("n", -F.col("ref"))).alias("ref")).where("ref >= 0")
    return sorted((r["label"], r["ref"]) for r in best.select("label", "ref").distinct().collect())


N_FEATURES = 8


def features(index: Index, n: int, s: float, r: float, acronym: bool, countries: set[str], city: str | None) -> list[float]:
    """Similarity of the proper name and whether it is exact, relation of the kinds, acronym, country and city for or against."""
    _, _, country, ref_city, place = index.ref[n]
    agree = 0.0 if not countries or country is None else 1.0 if country in countries else -1.0
    same = 0.0 if not city or not ref_city else 1.0 if distance(city, ref_city, 2) <= 2 or distance(city, place, 2) <= 2 else -1.0
    return [s, float(s == 1.0), float(r == 1.0), float(0 < r < 1), float(r == 0), float(acronym), agree, same]


class Matcher:
    """An index, which has learnt names and hosts (`name_statistics`, `host_statistics`), with the classifier; a row is (name, country, code, city, urls)."""

    def __init__(self, index: Index, sample: list[tuple]) -> None:
        self.index = index
        index.warm({w for r in sample for w in parse(r[0]).words})
        x, y = [], []
        for name, country, code, city, urls in sample:
            host = next((h for h in map(host_of, urls) if h), None)
            if not host:
                continue
            meant = index.by_acronym(host[0])
            countries = self.countries(country, code)
            for n, s, r, a, _ in index.candidates(parse(name)):
                # Weak label: the address, which isn't among the features, says whether it is this record. A host abroad labels nothing.
                right = n in meant and index.ref[n][2] == host[1]
                if right or not meant or index.ref[n][2] != host[1]:
                    x.append(features(index, n, s, r, a, countries or {host[1]}, fold(city) if city else None))
                    y.append(float(right))
        x.append([1, 1, 1, 0, 0, 0, 1, 1]), y.append(1.0)
        x.append([0.7, 0, 0, 0, 1, 0, -1, -1]), y.append(0.0)
        self.model = Logistic().fit(np.array(x, float), np.array(y))

    @staticmethod
    def countries(country: str | None, code: str | None) -> set[str]:
        return {c for c in (country_code(country), country_code(code)) if c}

    def match(self, rows: list[tuple]) -> list[tuple[int, float] | None]:
        """(id, confidence) of each row, or None."""
        ix = self.index
        parsed = {r[0]: parse(r[0]) for r in rows}
        ix.warm({w for p in parsed.values() for w in p.words} | {w for r in rows if r[3] for w in _TOKEN.findall(fold(r[3])) if len(w) >= 4 and not parsed[r[0]].words})
        kept = {name: ix.candidates(p) for name, p in parsed.items()}
        at, x, who = [], [], []
        out: list[tuple[int, float] | None] = [None] * len(rows)
        for k, (name, country, code, city, urls) in enumerate(rows):
            p = parsed[name]
            countries = self.countries(country, code)
            hosts = [h for h in map(host_of, urls) if h]
            folded = fold(city) if city else None
            found = kept[name]
            if not p.words and not p.acronyms and not found:
                if p.kinds - {"U", "I"} and folded:  # a kind without a proper name: the city may be it
                    city_words = [w for w in _TOKEN.findall(folded) if len(w) >= 4]
                    found = [c for c in ix.candidates(Parsed(p.kinds, city_words, [])) if c[2] == 1.0]
                if not found:  # nothing named: the address decides
                    for label, cc in hosts:
                        same = [n for n in ix.by_acronym(label) if ix.ref[n][2] == cc and (p.kinds <= {"U", "I"} or relation(p.kinds, ix.ref[n][1]) > 0)]
                        if len(same) == 1:
                            out[k] = (ix.ref[same[0]][0], 0.9)
                            break
                    continue
            if not countries and hosts:
                countries = {h[1] for h in hosts[:1]}
            if p.words and not found:  # blocked by its other attributes
                found = ix.beside(p, (ix.in_city(folded) if folded else set()).union(*(ix.by_acronym(label) for label, _ in hosts)))
            for n, s, r, a, held in found:
                f = features(ix, n, s, r, a, countries, folded)
                if r == 0 or f[6] < 0:  # an exact check: another kind, or another country, is another institution
                    continue
                if not a and 0 < r < 0.9 and hosts and any(ix.centre[m] != n and ix.ref[m][2] == h[1] and ix.ref[m][4] == ix.ref[n][4] for h in hosts for m in ix.by_acronym(h[0])):
                    continue  # a short name, and the address is that of another institution of the same place
                at.append(k), x.append(f), who.append((n, held))
        if x:
            prob = self.model.probability(np.array(x, float))
            rank: dict[int, tuple] = {}
            for k, f, (n, held), q in zip(at, x, who, prob):
                key = (f[2], held, q, -n)
                if q >= 0.5 and (k not in rank or key > rank[k][0]):
                    rank[k] = (key, n, float(q))
            for k, (_, n, q) in rank.items():
                out[k] = (ix.ref[n][0], q)
        return out


def match_records(records: DataFrame, ref: DataFrame, id_col: str, ref_name: str, country_col: str, city_col: str, sample_from: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, rec_table, rec_id, confidence): the institution of each record (rec_table, rec_id, institution, country, country_code, city, urls).
    Acronyms and hosts are learnt from all records; sample_from: records of the same columns, of which at most `sample`, chosen by hash, fit the classifier."""
    spark = records.sparkSession
    rows = hash_sample(sample_from.where(F.col("institution").isNotNull()), ["rec_id", "institution"], sample).collect()
    names = materialize(records.select(F.col("institution").alias("spelling")).where(F.trim("spelling") != "").distinct())
    fitted = [(r["institution"], r["country"], r["country_code"], r["city"], list(r["urls"] or [])) for r in rows]
    parts = []
    for block in reference_blocks(ref, id_col, ref_name, country_col, city_col):
        index = Index(block)
        index.learn(acronyms_beside_names(index, [r[1] for r in block]))
        index.settle(name_statistics(names, index))
        index.learn(host_statistics(records, index))
        shared = spark.sparkContext.broadcast(Matcher(index, fitted))

        def run(batches, shared=shared):
            m = _index(shared)
            for pdf in batches:
                found = m.match([(a, b, c, d, [] if u is None else list(u)) for a, b, c, d, u in zip(pdf["institution"], pdf["country"], pdf["country_code"], pdf["city"], pdf["urls"])])
                hit = [k for k, f in enumerate(found) if f]
                yield pd.DataFrame({id_col: pd.Series([found[k][0] for k in hit], dtype="int64"), "rec_table": pd.Series([pdf["rec_table"].iloc[k] for k in hit], dtype=object), "rec_id": pd.Series([pdf["rec_id"].iloc[k] for k in hit], dtype="int64"), "confidence": pd.Series([found[k][1] for k in hit], dtype=float)})

        parts.append(records.where(F.col("rec_id").isNotNull()).mapInPandas(run, f"`{id_col}` bigint, rec_table string, rec_id bigint, confidence double"))
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("rec_table", "rec_id").agg(F.max_by(id_col, F.struct("confidence", -F.col(id_col))).alias(id_col), F.max("confidence").alias("confidence")).select(id_col, "rec_table", "rec_id", "confidence")
