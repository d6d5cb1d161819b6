"""Garbled text from a wrong character encoding: characters back to legacy bytes, a byte-structure automaton, spans decoded.

A run of characters beyond ASCII is mapped to the bytes of a legacy code page; the automaton walks the bytes and finds
the maximal well-formed UTF-8 spans; only those are decoded, and again until nothing changes (text spoilt twice). Single
bytes read with another single-byte page show by their place in a word (a Cyrillic letter inside a Latin word, a capital
after small letters, a box-drawing or fraction sign within a word); they go back through the page that explains most.
Replacement marks and question marks inside words tell of lost characters: found, but not restorable.

Defined results: null and empty texts are clean and stay as they are; correct rare characters stay.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code pages through which UTF-8 or one another may have been read.
PAGES = ["cp1252", "mac_roman", "cp437", "cp850", "cp1251"]


def _page(name: str) -> dict[str, int]:
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            pass
    if name == "cp1252":  # read as Latin-1, its C1 bytes stay control characters
        for b in range(128, 256):
            table.setdefault(chr(b), b)
    return table


TABLES = {p: _page(p) for p in PAGES}
RUN = re.compile("[\x80-\U0010ffff]{2,}")
_L = "a-zß-öø-ÿœšž"
ASKED = re.compile(rf"(?<=[{_L}A-ZÀ-Þ])\?(?=[{_L}])")
C1 = re.compile("[\x80-\x9f]")
#: Characters of correct texts in these languages. Whatever has no other, no Ã or Â before a further one, no capital with
#: an accent after a small letter and no question mark between letters is clean; Java's regex reads this pattern alike.
_USUAL = "áéíóúýñãõçâêîôûàèìòùäëïöüÿœæÁÉÍÓÚÝÑÃÕÇÂÊÎÔÛÀÈÌÒÙÄËÏÖÜŒÆ«»“”‘’—–…¿¡·ºª°•©€\xa0"
_CAPITALS = "ÀÁÈÉÌÍÒÓÙÚÝÔÛÎÂÊÄËÏÖÜÕÃÅÆÐ"
QUICK = rf"[^\x00-\x7f{_USUAL}]|[ÃÂ][^\x00-\x7f]|[a-z][{_CAPITALS}]|[a-zA-ZÀ-ÿ]\?[a-zß-ÿ]|[a-z][·ºª°•©€æäëïöü‘“][a-zß-ÿ]|\xa0[a-z]"
_QUICK = re.compile(QUICK)
_RARE = re.compile(rf"[^\x00-\x7f{_USUAL}]")
#: A character of another single-byte page inside or at the edge of a Latin word. Word characters are taken from Latin alone.
_CYR = "Ѐ-ӿ"
_ODD = "ßØΆ-ώ¾¶§±½¯¨¹þÞÐð·¼³²˙≤≥∞¢¤£‚‡ˆƒÆæ†‰¥¦©®¬„Š"
_BOX = "─-▟⌐⌠⌡"
SINGLE = re.compile(
    rf"[A-Za-z][{_CYR}]|[{_CYR}][A-Za-z]|(?:^| )[{_CYR}](?= [A-Za-z])"  # Cyrillic
    rf"|[a-z][{_CAPITALS}](?=[{_L} ,.;:]|$)"  # a capital after small letters
    rf"|[A-Za-z][{_ODD}](?=[a-z])|[A-Z][{_ODD}](?=[A-Z])|(?<![\w{_ODD}])[¾½¼¶þ¢£‚¤](?=[a-z])"  # signs within words
    rf"|[A-Za-z][{_BOX}](?=[A-Za-z. ,])|[{_BOX}](?=[A-Za-z])|(?<=[a-z])[þÞ](?=[a-zÀ-ÿ])"
    rf"|[a-z][¢£¤‚¾ß](?=[ ,.;:])|[a-z]\xa0[a-z]+(?= [a-z]*[¢£¤‚])"
)
#: Three-byte punctuation of which the control character in the middle was dropped.
DROPPED = {"â¦": "…", "â¢": "•"}
_DROPPED = re.compile("â[¦¢]")


def _lost(text: str) -> bool:
    """A replacement mark, or a question mark that stands for a letter: between letters of a word, not in an address."""
    if "\ufffd" in text:
        return True
    if "?" not in text:
        return False
    for m in ASKED.finditer(text):
        s = max(text.rfind(" ", 0, m.start()), text.rfind("\n", 0, m.start())) + 1
        e = re.compile(r"[ \n]|$").search(text, m.end()).start()
        if not any(c in text[s:e] for c in "/=&@"):
            return True
    return False


def _automaton(data: bytes) -> list[tuple[int, int]]:
    """Maximal spans of well-formed multibyte UTF-8 characters: states are the continuation bytes due and the bounds of the next."""
    spans, at, start, n = [], 0, -1, len(data)
    while at < n:
        b = data[at]
        if 0xC2 <= b <= 0xDF:
            due, low, high = 1, 0x80, 0xBF
        elif 0xE0 <= b <= 0xEF:
            due, low, high = 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        elif 0xF0 <= b <= 0xF4:
            due, low, high = 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        else:
            due = 0
        end = at + 1
        while due and end < n and low <= data[end] <= high:
            due, low, high, end = due - 1, 0x80, 0xBF, end + 1
        if due or b < 0xC2 or b > 0xF4:
            if start >= 0:
                spans.append((start, at))
                start = -1
            at += 1
            continue
        start = at if start < 0 else start
        at = end
    if start >= 0:
        spans.append((start, n))
    return spans


def _plausible(decoded: str) -> bool:
    """Characters that texts in Latin letters hold; of Greek, Cyrillic and Latin beyond the usual only what can't be chance."""
    cyrillic = 0
    for c in decoded:
        o = ord(c)
        if 0x410 <= o <= 0x44F:
            cyrillic += 1
        elif not (0xA0 <= o <= 0xFF and c not in "\xadÅåÆæØøÐðÞþ×÷" or 0x2010 <= o <= 0x203A or c in "\xadŒœŠšŽžŁłŸƒˆ˜Å€™→←↑↓√∞≈≠≤≥−∂∑∏∫◊" or 0x391 <= o <= 0x3C9 or 0x2500 <= o <= 0x257F):
            return False
    # A capital Ã cut off before an ellipsis isn't a spoilt Å; in text spoilt twice something follows it.
    return (cyrillic == 0 or cyrillic >= 2) and not decoded.endswith("Å")


@lru_cache(maxsize=100_000)
def _run(run: str) -> str:
    """The run with its well-formed spans decoded, by the page that decodes most of it; itself if none does."""
    best, gain = run, 0
    for page in PAGES:
        table, out, won, at = TABLES[page], [], 0, 0
        while at < len(run):
            if run[at] not in table:
                out.append(run[at])
                at += 1
                continue
            end = at
            while end < len(run) and run[end] in table:
                end += 1
            data, last = bytes(table[c] for c in run[at:end]), 0
            for s, e in _automaton(data):
                text = data[s:e].decode("utf-8")
                if _plausible(text) or _plausible(_run(text) if len(text) > 1 else text):
                    out += [run[at + last : at + s], text]
                    won += e - s - len(text)
                    last = e
            out.append(run[at + last : end])
            at = end
        if won > gain:
            best, gain = "".join(out), won
    return best


#: (page the characters are bytes of, page the bytes were meant in).
CROSSINGS = [("cp1251", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman")]


def _singles(text: str) -> str:
    """Another single-byte page for the characters beyond ASCII: the one after which least looks wrong."""
    best, least = text, len(SINGLE.findall(text)) + len(_RARE.findall(text))
    for page, meant in CROSSINGS:
        table = TABLES[page]
        if page == "cp1251":
            table = {c: b for c, b in table.items() if unicodedata.name(c, "").startswith("CYRILLIC")}
        out = "".join(bytes([table[c]]).decode(meant, "replace") if c in table else c for c in text)
        wrong = len(SINGLE.findall(out)) + len(_RARE.findall(out))
        if wrong < least:
            best, least = out, wrong
    return best


def repair(text: str | None) -> tuple[bool, str | None, bool]:
    """(has a spoilt character, text as far as it can be restored, wholly restored)."""
    if not text or not _QUICK.search(text):
        return False, text, True
    out = text
    for _ in range(3):
        once = RUN.sub(lambda m: _run(m.group()), out)
        if once == out:
            break
        out = once
    out = _DROPPED.sub(lambda m: DROPPED[m.group()], out)
    spoilt = out != text
    if SINGLE.search(out):
        spoilt, out = True, "\n".join(_singles(x) if SINGLE.search(x) else x for x in out.split("\n"))  # lines are spoilt one by one
    if C1.search(out):
        spoilt, out = True, C1.sub(lambda m: m.group().encode("latin-1").decode("cp1252", "replace"), out)
    lost = _lost(out)
    return spoilt or lost, out, not lost


def repair_column(df: DataFrame, text_col: str, out_col: str = "restored") -> DataFrame:
    """The rows with a struct: spoilt, text, complete. Clean texts come back unchanged, null as null."""

    @F.pandas_udf("spoilt boolean, text string, complete boolean")
    def fix(texts: pd.Series) -> pd.DataFrame:
        rows = [repair(t) for t in texts]
        return pd.DataFrame(rows, columns=["spoilt", "text", "complete"]) if rows else pd.DataFrame({"spoilt": pd.Series(dtype=bool), "text": pd.Series(dtype=object), "complete": pd.Series(dtype=bool)})

    return df.withColumn(out_col, fix(F.col(text_col)))


def spoilt_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The ids of the rows whose text has a spoilt character; only ids leave the Python workers."""

    @F.pandas_udf("boolean")
    def spoilt(texts: pd.Series) -> pd.Series:
        return pd.Series([repair(t)[0] for t in texts], dtype=bool)

    # What the quick pattern finds clean never reaches Python.
    return df.where(F.col(text_col).rlike(QUICK)).where(spoilt(F.col(text_col))).select(id_col)
