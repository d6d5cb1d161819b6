"""Language of texts and of their stretches: interpolated Kneser-Ney character models, one a language.

A model holds, for each order, its n-grams as sorted arrays of exact 40-bit codes beside their discounted probabilities,
and for each context its back-off mass; a lookup is a binary search. Words are scored with a space at either end, so a
context never reaches beyond a word and a word's score can be kept: a text's cross-entropy is the sum over its words
divided by its length. The lowest wins; it is refused ('und') where it, or its lead, is beyond what held-out texts show.

Training reads at most SAMPLE texts a language, chosen by hash, of a labelled table (the bound is a parameter).

Defined results: null, blank or letterless texts are 'und' with confidence 0; ties go to the first language in order.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

LANGUAGES = ["es", "pt", "en", "fr"]
SAMPLE = 300
ORDER = 5
#: Nats of lead beyond which even a text of high cross-entropy (spoilt characters) isn't refused.
SURE = 100.0
_LETTERS = bytes(b if chr(b).isalpha() and chr(b).islower() else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Runs of small Latin-1 letters of the text in lower case; the alphabet of these languages lies in it but for the ligature œ.
    Letters of other scripts separate."""
    return text.lower().encode("latin-1", "replace").translate(_LETTERS).split() if text else []


# Other notations of the labels.
NOTATIONS = {
    "es": "es spa esp español espanol spanish castellano",
    "pt": "pt por português portugues portuguese",
    "en": "en eng english inglés ingles",
    "fr": "fr fra fre français francais french",
}


def label(column):
    """A stored label in any notation as es, pt, en, fr; null where it is missing, unknown or no label of these."""
    c = F.regexp_replace(F.lower(F.trim(column)), "[-_].*$", "")
    out = F.lit(None).cast("string")
    for lang, names in NOTATIONS.items():
        out = F.when(c.isin(*names.split()), F.lit(lang)).otherwise(out)
    return out


def _codes(words_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all words with a space at either end, and their places in the word."""
    if not words_:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    chars = np.frombuffer(b" " + b"  ".join(words_) + b" ", dtype=np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words_), np.int64, len(words_)) + 2
    starts = np.cumsum(lengths) - lengths
    return chars, np.arange(len(chars)) - np.repeat(starts, lengths)


def _grams(chars: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each place deep enough in its word, and those places."""
    at = np.nonzero(places >= n - 1)[0]
    code = np.zeros(len(at), np.uint64)
    for k in range(n - 1, -1, -1):
        code = (code << np.uint64(8)) | chars[at - k]
    return code, at


class KneserNey:
    """One language."""

    def __init__(self, words_: list[bytes], order: int = ORDER) -> None:
        self.order = order
        chars, places = _codes(words_)
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        grams = [_grams(chars, places, n)[0] for n in range(1, order + 1)]
        self.vocabulary = max(2, len(np.unique(chars)) + 1)
        for n in range(1, order + 1):
            unique, counts = np.unique(grams[n - 1], return_counts=True)
            if n < order:  # continuation counts: in how many different contexts a gram continues; word starts keep their counts
                longer = np.unique(grams[n])
                tail, continued = np.unique(longer & np.uint64((1 << (8 * n)) - 1), return_counts=True)
                full = np.zeros(len(unique), np.int64)
                full[np.searchsorted(unique, tail)] = continued
                first = (unique >> np.uint64(8 * (n - 1))) == np.uint64(32)
                counts = np.where(first & (n > 1), counts, np.maximum(full, 1))
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            context = unique >> np.uint64(8)
            heads, start = np.unique(context, return_index=True)
            totals = np.add.reduceat(counts, start).astype(float) if len(start) else np.zeros(0)
            kinds = np.diff(np.append(start, len(unique)))
            which = np.searchsorted(heads, context)
            self.tables.append((unique, (np.maximum(counts - discount, 0) / totals[which]).astype(np.float64), heads, discount * kinds / np.maximum(totals, 1)))

    def logprob(self, words_: list[bytes]) -> np.ndarray:
        """Sum of log probabilities of each word's characters, its end included."""
        chars, places = _codes(words_)
        if not len(chars):
            return np.zeros(0)
        p = np.full(len(chars), 1.0 / self.vocabulary)
        for n in range(1, self.order + 1):
            unique, prob, heads, mass = self.tables[n - 1]
            code, at = _grams(chars, places, n)
            own = np.zeros(len(at))
            i = np.minimum(np.searchsorted(unique, code), len(unique) - 1)
            hit = unique[i] == code
            own[hit] = prob[i[hit]]
            context = code >> np.uint64(8)
            j = np.minimum(np.searchsorted(heads, context), len(heads) - 1)
            back = np.where(heads[j] == context, mass[j], 1.0)
            p[at] = own + back * p[at]
        lp = np.log(p)
        lp[places == 0] = 0.0  # the space before a word is given
        return np.add.reduceat(lp, np.nonzero(places == 0)[0])


class Identifier:
    """All languages, with the calibration of refusal and confidence."""

    #: Words whose scores a worker keeps; beyond it the store is emptied, so that it can't grow with the data.
    BOUND = 400_000
    CHUNK = 4096

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER) -> None:
        self.languages = [x for x in LANGUAGES if samples.get(x)]
        split = {x: [tokens(t) for t in samples[x]] for x in self.languages}
        self.models = {x: KneserNey([w for d in split[x][len(split[x]) // 5 :] for w in d], order) for x in self.languages}
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((0, len(self.languages)))
        # Held-out fifth: how large a cross-entropy and how small a lead right answers have.
        entropy, slope = [0.0], [0.0]
        for k, x in enumerate(self.languages):
            pieces = [d[i : i + 25] for d in split[x][: max(1, len(split[x]) // 5)] for i in range(0, len(d), 25)]
            scores, sizes = self.scores(pieces)
            ok = sizes > 0
            entropy += list(-scores[ok].max(axis=1) / sizes[ok])
            if len(self.languages) > 1:
                slope += list((scores[ok, k] - np.delete(scores[ok], k, axis=1).max(axis=1)) / sizes[ok])
        self.ceiling = float(np.quantile(entropy, 0.999) * 1.25) or 9.0
        #: Characters of one word aren't independent, so leads are tempered to make odds of them.
        self.temper = max(1.0, 1.0 / max(float(np.quantile(slope, 0.05)), 1e-3))
        self.index, self.table = {}, np.zeros((0, len(self.languages)))

    def scores(self, token_lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities in each language, and characters, of each list of words."""
        flat = [w for t in token_lists for w in t]
        counts = np.fromiter(map(len, token_lists), np.int64, len(token_lists))
        out, sizes = np.zeros((len(token_lists), len(self.languages))), np.zeros(len(token_lists), np.int64)
        if not flat:
            return out, sizes
        index = self.index
        new = list(set(flat).difference(index))
        if new:
            if len(index) + len(new) > self.BOUND:
                index.clear()
                self.table = self.table[:0]
                new = list(set(flat))
            rows = [np.stack([m.logprob(new[i : i + 50_000]) for m in self.models.values()], axis=1) for i in range(0, len(new), 50_000)]
            index.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, *rows])
        ids = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        lengths = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
        full = np.nonzero(counts)[0]
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(self.table[ids], starts, axis=0)
        sizes[full] = np.add.reduceat(lengths, starts)
        return out, sizes

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, confidences, and leads in nats over the next language."""
        if len(texts) > self.CHUNK:  # the words of a chunk are held at once, not those of a whole batch
            parts = [self.identify(texts[i : i + self.CHUNK]) for i in range(0, len(texts), self.CHUNK)]
            return [x for p in parts for x in p[0]], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        if not len(texts) or not self.languages:  # nothing to say, or nothing learnt
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        scores, sizes = self.scores([tokens(t) for t in texts])
        best = scores.max(axis=1)
        which = scores.argmax(axis=1)
        lead = best - np.sort(scores, axis=1)[:, -2] if len(self.languages) > 1 else sizes.astype(float)
        confidence = 1 / np.exp(np.maximum(-50.0, (scores - best[:, None]) / self.temper)).sum(axis=1)
        good = (sizes > 0) & ((-best <= self.ceiling * sizes) | (lead > SURE))
        langs = [self.languages[k] if g else "und" for k, g in zip(which, good)]
        return langs, np.where(sizes > 0, confidence, 0.0), np.where(sizes > 0, lead, 0.0)


def train(df: DataFrame, text_col: str, label_col: str, sample: int = SAMPLE) -> Identifier:
    """From at most `sample` labelled texts a language, the first by hash of the text: the same on every run."""
    rows = df.select(F.col(text_col).alias("t"), label(F.col(label_col)).alias("l")).where(F.col("l").isNotNull() & (F.length(F.trim("t")) > 200))
    parts = [hash_sample(rows.where(F.col("l") == x), ["t"], sample) for x in LANGUAGES]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    samples: dict[str, list[str]] = {x: [] for x in LANGUAGES}
    for r in sorted(union.select("l", "t", "h").collect(), key=lambda r: (r["l"], r["h"])):
        samples[r["l"]].append(r["t"])
    return Identifier(samples)


_held: dict[int, Identifier] = {}


def held(shared) -> Identifier:
    """The broadcast model, unpickled once a worker."""
    key = id(shared) if not hasattr(shared, "_path") else hash(shared._path)
    if key not in _held:
        _held.clear()
        _held[key] = shared.value
    return _held[key]


def identify_column(df: DataFrame, text_col: str, model: Identifier, out_col: str = "lang_found") -> DataFrame:
    """The rows with a struct (lang, confidence, lead) of the whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, confidence double, lead double")
    def found(texts: pd.Series) -> pd.DataFrame:
        langs, confidence, lead = held(shared).identify(list(texts))
        return pd.DataFrame({"lang": pd.Series(langs, dtype=object), "confidence": confidence, "lead": lead})

    return df.withColumn(out_col, found(F.col(text_col)))


_PROSE = re.compile(r"[.?!…»”]\W*$")


def stretches(lines: list[str], langs: list[str], leads, least_lead: float = 12.0, switch_lead: float = 30.0) -> tuple[str, list[str]]:
    """(the page's language, one a line). The page's is that of most lines that aren't running text (headings, rows, menus: a
    second language comes in as running text), then that of most running text; a line is of another only if its lead says so clearly."""
    frame: dict[str, float] = {}
    prose: dict[str, float] = {}
    for x, lang, lead in zip(lines, langs, leads):
        if lang != "und" and lead >= least_lead:
            votes = prose if len(x) > 60 and _PROSE.search(x) else frame
            votes[lang] = votes.get(lang, 0.0) + (len(x) if votes is prose else lead)
    votes = frame or prose
    page = max(votes, key=lambda k: (votes[k], prose.get(k, 0.0))) if votes else "und"
    return page, [lang if lang != "und" and lead >= switch_lead else page for lang, lead in zip(langs, leads)]


def line_languages(df: DataFrame, id_col: str, text_col: str, model: Identifier, foreign_only: bool = False, pages: bool = False) -> DataFrame:
    """(id, line_no, page_lang, lang, confidence) of each non-blank line (counted from 1), or of those in another language than the page's.
    `pages` adds each page itself as line 0, null and blank ones as 'und'. A page's confidence is that of its lines of its language, over
    the characters of all identified lines; a line that tells nothing has its page's, one too weak for another language what that leaves."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        m = held(shared)
        for pdf in batches:
            texts = [[(n, x) for n, x in enumerate((t or "").split("\n"), 1) if x.strip()] for t in pdf[text_col]]
            langs, confidence, lead = m.identify([x for p in texts for _, x in p])
            out, at = [], 0
            for i, numbered in zip(pdf[id_col], texts):
                end = at + len(numbered)
                page, own = stretches([x for _, x in numbered], langs[at:end], lead[at:end])
                told = [(len(x), lang, conf) for (_, x), lang, conf in zip(numbered, langs[at:end], confidence[at:end]) if lang != "und"]
                sure = sum(size * conf for size, lang, conf in told if lang == page) / max(1, sum(size for size, _, _ in told))
                if pages:
                    out.append((i, 0, page, page, sure))
                for (n, _), lang, first, conf in zip(numbered, own, langs[at:end], confidence[at:end]):
                    if not foreign_only or lang != page:
                        out.append((i, n, page, lang, conf if lang == first else sure if first == "und" else 1 - conf))
                at = end
            cols = list(zip(*out)) if out else [[]] * 5
            yield pd.DataFrame({id_col: pd.Series(cols[0], dtype=pdf[id_col].dtype), "line_no": pd.Series(cols[1], dtype="int64"), "page_lang": pd.Series(cols[2], dtype=object), "lang": pd.Series(cols[3], dtype=object), "confidence": pd.Series(cols[4], dtype=float)})

    rows = df.select(id_col, text_col).where(F.col(id_col).isNotNull())
    return (rows if pages else rows.where(F.col(text_col).isNotNull())).mapInPandas(run, f"`{id_col}` {kind}, line_no bigint, page_lang string, lang string, confidence double")
