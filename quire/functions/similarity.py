"""Measures of likeness between 0 and 1."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def token_f1(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    k = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * k / (F.size(a) + F.size(b)))


def jaccard(a: Column, b: Column, empty: float = 1.0, one_empty: float = 0.0) -> Column:
    none_a, none_b = F.size(a) == 0, F.size(b) == 0
    return F.when(none_a & none_b, F.lit(empty)).when(none_a | none_b, F.lit(one_empty)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap_of_larger(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, F.lit(0.0)).otherwise(2 * a * b / (a + b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


@F.arrow_udf(T.ArrayType(T.LongType()))
def bigram_bits(text: pa.Array) -> pa.Array:
    """256 bits of a text in four longs; each pair of neighbouring bytes turns one over.

    An edit of an ASCII character takes away at most two pairs and brings at most two: texts ``k`` edits apart differ in at most 4 k bits.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    raw = text.fill_null("").cast(pa.large_binary())
    n, ends = len(raw), np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    body = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64) if n and ends[-1] > ends[0] else np.empty(0, np.uint64)
    row = np.repeat(np.arange(n), np.diff(ends))
    inside = row[1:] == row[:-1]
    bit = ((body[:-1] << np.uint64(8) | body[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64)
    odd = np.bincount((row[:-1] * 256 + bit)[inside], minlength=n * 256) & 1
    bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4, dtype=np.int32)), pa.array(bits))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one whole number."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str | None, b: str | None) -> float:
    if a is None or b is None:
        return 0.0
    return 1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b))


def partial(a: str | None, b: str | None) -> float:
    """Best likeness of the shorter text to any stretch of the longer one of its length."""
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    if short in long:
        return 1.0
    n = len(short)
    starts = {m.b - m.a for m in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks() if m.size}
    return max(indel(short, long[max(0, s) : max(0, s) + n]) for s in starts) if starts else 0.0


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())
    def g(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return g


indel_ratio = _pairwise(indel)
partial_ratio = _pairwise(partial)
block_ratio = _pairwise(lambda a, b: 0.0 if a is None or b is None else SequenceMatcher(None, a, b, autojunk=False).ratio())
