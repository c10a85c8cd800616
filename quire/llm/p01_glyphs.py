"""Visually identical text with different characters (problem 1).

The text column is taken from Arrow as one UTF-8 buffer, decoded by numpy into an array of
code points, and rewritten as a whole: table gathers with expansion offsets replace wide forms,
ligatures, odd spaces and invisible characters (but joiners within words of scripts that need them, and
those of emoji); combining marks are ordered and composed by pair look-ups, Korean letters by their numbers; look-alike letters are replaced in words that mix scripts. No string function is
called per row.

Defined cases: null stays null; empty text stays empty; text of any length is treated whole;
repeated rows are treated alike; an empty table gives an empty result; other columns are kept
untouched, but those that bear the name of a new column are replaced by it.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table

TOP = 0x110000
MARK, LATIN, CYRILLIC, GREEK, OTHER = 1, 2, 4, 8, 16

# Letters that look like Latin ones, after Unicode's table of confusables.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l", "г": "r", "ь": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ү": "Y", "Ӏ": "I", "ї": "ï", "Ї": "Ï", "ё": "ë", "Ё": "Ë",
    "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "χ": "x", "υ": "u", "τ": "t", "η": "n", "ω": "w", "γ": "y", "ϲ": "c",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X",
}
# Characters that are not seen at all.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
# Spaces that look like the ordinary one, hyphens that look like the ordinary one.
SPACES = [0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
HYPHENS = [0x2010, 0x2011, 0xFE63, 0xFF0D]


class Tables:
    """Look-up tables by code point, built from the interpreter's Unicode database."""

    def __init__(self) -> None:
        self.length = np.ones(TOP, np.uint8)
        self.start = np.full(TOP, -1, np.int64)  # place in the pool; -1: stays as it is
        pool: list[int] = []

        def expand(cp: int, to: str) -> None:
            self.length[cp] = len(to)
            self.start[cp] = len(pool)
            pool.extend(map(ord, to))

        pairs: list[tuple[int, int, int]] = []
        self.ccc = np.zeros(TOP, np.uint8)
        self.script = np.zeros(TOP, np.uint8)
        for cp in [*range(0x41, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]:
            ch = chr(cp)
            kind = unicodedata.category(ch)
            if kind[0] == "L":
                self.script[cp] = LATIN if cp < 0x250 or 0x1E00 <= cp < 0x1F00 else CYRILLIC if 0x400 <= cp < 0x530 else GREEK if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000 else OTHER
            elif kind[0] == "M":
                self.script[cp] = MARK
                self.ccc[cp] = unicodedata.combining(ch)
            full = unicodedata.normalize("NFD", ch)
            if full != ch:
                expand(cp, full)
                two = [int(x, 16) for x in unicodedata.decomposition(ch).split()]
                if len(two) == 2 and unicodedata.normalize("NFC", chr(two[0]) + chr(two[1])) == ch:
                    pairs.append((two[0], two[1], cp))
            if 0xFB50 <= cp <= 0xFDFF or 0xFE70 <= cp <= 0xFEFC:  # Arabic letters in the shape of their place
                if (plain := unicodedata.normalize("NFKD", ch)) != ch and all(unicodedata.category(x)[0] == "L" for x in plain):
                    expand(cp, plain)
            if 0xFF01 <= cp <= 0xFFDC or 0xFFE0 <= cp <= 0xFFEE or 0xFB00 <= cp <= 0xFB06:  # wide, narrow, ligatures
                if (plain := unicodedata.normalize("NFKD", ch)) != ch:
                    expand(cp, plain)
        for cp in SPACES:
            expand(cp, " ")
        for cp in HYPHENS:
            expand(cp, "-")
        self.length[INVISIBLE] = 0
        self.script[0x1D400:0x1D800] = 0  # symbols that stand for themselves
        self.pool = np.array(pool, np.uint32)
        pairs.sort()
        p = np.array(pairs, np.int64)
        self.pair, self.made = (p[:, 0] << 21) | p[:, 1], p[:, 2].astype(np.uint32)
        self.latin = np.zeros(TOP, np.uint32)
        self.cyrillic = np.zeros(TOP, np.uint32)
        for k, v in LOOKALIKES.items():
            self.latin[ord(k)] = ord(v)
            if self.script[ord(k)] == CYRILLIC and not self.cyrillic[ord(v)]:
                self.cyrillic[ord(v)] = ord(k)


@cache
def tables() -> Tables:
    return Tables()


def decode(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    more = (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    cp = lead & np.array([0x7F, 0x1F, 0x0F, 0x07], np.uint32)[more]
    for k in (1, 2, 3):
        has = more >= k
        cp[has] = (cp[has] << 6) | (data[at[has] + k] & 0x3F)
    return cp, at


def encode(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points, and the number of bytes of each."""
    n = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    end = np.cumsum(n)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(4):  # from the last byte
        has = n > k
        tail = (cp[has] >> (6 * k)) & 0x3F | 0x80
        out[end[has] - 1 - k] = tail
    first = end - n
    out[first] = np.where(n == 1, cp, (cp >> (6 * (n - 1)).astype(np.uint32)) | np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[n])
    return out, n


def compose(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order marks by class and join them with their letters, all at once, until nothing changes."""
    t = tables()
    ccc = t.ccc[cp]
    if (ccc[1:] < ccc[:-1])[ccc[1:] > 0].any():
        part = np.cumsum((ccc == 0) | np.r_[True, row[1:] != row[:-1]])
        order = np.lexsort((ccc, part))
        cp, ccc = cp[order], ccc[order]
    while len(cp) > 1:
        i = np.arange(len(cp))
        last = np.maximum.accumulate(np.where(ccc == 0, i, -1))
        base = np.r_[-1, last[:-1]]  # the letter before each
        ok = (base >= 0) & (row[np.maximum(base, 0)] == row)
        before = np.r_[0, ccc[:-1]]
        ok &= (base == i - 1) | ((before != 0) & (before < ccc))
        i = np.flatnonzero(ok & ((ccc > 0) | (t.script[cp] == MARK)))
        if not len(i):
            break
        key = (cp[base[i]].astype(np.int64) << 21) | cp[i]
        at = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
        hit = t.pair[at] == key
        i, at = i[hit], at[hit]
        if not len(i):
            break
        _, one = np.unique(base[i], return_index=True)  # the first mark of each letter
        i, at = i[one], at[one]
        cp = cp.copy()
        cp[base[i]] = t.made[at]
        keep = np.ones(len(cp), bool)
        keep[i] = False
        cp, row, ccc = cp[keep], row[keep], t.ccc[cp[keep]]
    return cp, row


def syllables(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Korean letters joined to syllables: first and vowel, then syllable and last."""
    if not ((cp >= 0x1161) & (cp <= 0x11C2)).any():
        return cp, row
    same = np.r_[row[1:] == row[:-1], False]
    after = np.r_[cp[1:], 0]
    pair = same & (cp >= 0x1100) & (cp <= 0x1112) & (after >= 0x1161) & (after <= 0x1175)
    i = np.flatnonzero(pair)
    cp = cp.copy()
    cp[i] = 0xAC00 + ((cp[i] - 0x1100) * 21 + (cp[i + 1] - 0x1161)) * 28
    keep = np.ones(len(cp), bool)
    keep[i + 1] = False
    cp, row = cp[keep], row[keep]
    same = np.r_[row[1:] == row[:-1], False]
    after = np.r_[cp[1:], 0]
    open_ = same & (cp >= 0xAC00) & (cp <= 0xD7A3) & ((cp - 0xAC00) % 28 == 0) & (after >= 0x11A8) & (after <= 0x11C2)
    i = np.flatnonzero(open_)
    cp[i] += cp[i + 1] - 0x11A7
    keep = np.ones(len(cp), bool)
    keep[i + 1] = False
    return cp[keep], row[keep]


def needed_joiners(cp: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Joiners between letters of scripts that shape them, and joiners and selectors behind emoji: both are seen."""
    joins, selects = (cp == 0x200C) | (cp == 0x200D), (cp == 0xFE0E) | (cp == 0xFE0F)
    if not (joins | selects).any():
        return np.zeros(len(cp), bool)
    before = np.r_[0, np.where(row[1:] == row[:-1], cp[:-1], 0)]
    after = np.r_[np.where(row[1:] == row[:-1], cp[1:], 0), 0]
    shaped = lambda x: ((x >= 0x0600) & (x < 0x0E00)) | ((x >= 0x1000) & (x < 0x10A0)) | ((x >= 0x1780) & (x < 0x18B0))
    emoji = lambda x: (x >= 0x1F000) | ((x >= 0x2190) & (x < 0x2C00)) | (x == 0xFE0F)
    return (joins & shaped(before) & shaped(after)) | ((cp == 0x200D) & emoji(before) & emoji(after)) | (selects & emoji(before))


def unmix(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, bool]:
    """Replace look-alikes in words that mix Latin letters with Cyrillic or Greek ones.

    A word becomes Latin where all its foreign letters have Latin doubles, else Cyrillic where
    all its Latin letters have Cyrillic doubles. A word wholly of doubles is one too, if its row
    has Latin letters and no foreign letter without a double but those that stand alone.
    """
    t = tables()
    kind = t.script[cp]
    foreign = (kind == CYRILLIC) | (kind == GREEK)
    if not foreign.any():
        return cp, False
    new = np.r_[True, (kind[1:] == 0) | (kind[:-1] == 0) | (row[1:] != row[:-1])]
    at = np.flatnonzero(new)
    word = np.cumsum(new) - 1
    double, back = t.latin[cp] > 0, t.cyrillic[cp] > 0
    some = lambda x: np.logical_or.reduceat(x, at)
    strange = some(foreign & ~double)
    latin, alien, cyrillic = some(kind == LATIN), some(foreign), some(kind == CYRILLIC)
    to_latin = latin & alien & ~strange
    to_cyrillic = latin & cyrillic & strange & ~some((kind == LATIN) & ~back) & ~some(kind == GREEK)
    rows = row[at]
    firm = np.zeros(int(row[-1]) + 1, bool)
    firm[rows[latin & ~alien]] = True  # the row has a plain Latin word
    other = np.zeros(int(row[-1]) + 1, bool)
    other[rows[cyrillic & strange & ~latin]] = True  # the row has a word that is surely Cyrillic
    to_latin |= cyrillic & ~latin & ~strange & ~some(kind == GREEK) & firm[rows] & ~other[rows]
    cp = np.where(to_latin[word] & foreign, t.latin[cp], cp)
    cp = np.where(to_cyrillic[word] & (kind == LATIN), t.cyrillic[cp], cp)
    return cp, bool(to_latin.any() | to_cyrillic.any())


def canonical_array(texts: pa.Array) -> pa.Array:
    """One consistent form of every text of an Arrow array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    big = texts.cast(pa.large_string())
    if n == 0 or big.null_count == n:
        return big.cast(pa.string())
    _, ends, bytes_ = big.buffers()
    offsets = np.frombuffer(ends, np.int64)[big.offset : big.offset + n + 1]
    data = np.frombuffer(bytes_ or b"", np.uint8)[offsets[0] : offsets[-1]]
    high = np.r_[0, np.cumsum(data >= 0x80)]
    wide = np.diff(high[offsets - offsets[0]]) > 0
    if not wide.any():
        return big.cast(pa.string())
    if not wide.all():  # ASCII text is in its one form already
        new = canonical_array(big.filter(pa.array(wide)))
        return pa.compute.replace_with_mask(big.cast(pa.string()), pa.array(wide), new)
    t = tables()
    cp, at = decode(data)
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(at, offsets - offsets[0])))
    size = t.length[cp].astype(np.int64)
    size[needed_joiners(cp, row)] = 1
    begin = np.cumsum(size) - size
    out, row = np.repeat(cp, size), np.repeat(row, size)
    inner = np.arange(len(out)) - np.repeat(begin, size)
    start = np.repeat(t.start[cp], size)
    out = np.where(start >= 0, t.pool[np.maximum(start, 0) + inner], out)
    out, row = compose(out, row)
    out, row = syllables(out, row)
    if len(out):
        out, changed = unmix(out, row)
        if changed:
            out, row = compose(out, row)
    new, sizes = encode(out)
    lengths = np.bincount(row, weights=sizes, minlength=n).astype(np.int64)
    made = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int64)), pa.py_buffer(new))
    if big.null_count:
        made = pa.compute.if_else(big.is_valid(), made, pa.scalar(None, pa.large_string()))
    return made.cast(pa.string())


@F.arrow_udf(T.StringType())
def canonical(texts: pa.Array) -> pa.Array:
    return canonical_array(texts)


def consistent(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<column>_consistent`` and ``<column>_changed`` for each text column."""
    return df.withColumns({f"{c}_consistent": canonical(F.col(c)) for c in columns}).withColumns({f"{c}_changed": F.coalesce(F.col(c) != F.col(f"{c}_consistent"), F.lit(False)) for c in columns})


FIELDS = ["title", "file_path"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = consistent(table(spark, sf_dir, "papers").select("id", *FIELDS), FIELDS)
    cases = F.array_compact(F.array(*(F.when(F.col(f"{c}_changed"), F.lit(c)) for c in FIELDS)))
    return rows.select("id", F.explode(cases).alias("field"))


def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = consistent(table(spark, sf_dir, "papers").select("id", *FIELDS), FIELDS)
    return rows.select("id", *(F.col(f"{c}_{k}") for c in FIELDS for k in ("consistent", "changed")))


QUERIES = {"p1_found": p1_found, "p1_consistent": p1_consistent}
