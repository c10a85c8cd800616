"""Evaluation texts leaking into training text (problem 8).

A document leaks an item if it holds ``least`` (13) consecutive words of it. Every window of
``least`` words of an item must then stand in the document whole, with all its shingles of
``SHINGLE`` words. The shingles of all items are counted over all documents (one scan); of each
window only the rarest shingle is looked up, the necessary prefix of its shingles in order of
rarity. Shingles of documents that no item looks up are dropped at the scan by a bitmap of fixed
size; the others are joined with the prefixes by equality, whatever the number of items. A document's shingle
carries the words around it, no more than a window can reach (bounds of position and length), and
a meeting counts if the run of equal words around the shingle has ``least`` words: an exact check
over windows of the item, without a further scan.

Defined cases: null and empty texts, and items with fewer than ``least`` words, match nothing;
texts are read whole; rows with the same text each match; the ids of equal pairs appear once; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table

WORD = r"[\p{L}\p{N}]+"
SHINGLE = 5
BITS = 24  # 2 ** BITS bits, 2 MB: the only thing that is broadcast


def words(c: str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def shingles(df: DataFrame, size: int) -> DataFrame:
    """``df`` with its array ``ws`` replaced by one row a shingle: its place ``at`` (from 0) and hash ``h``."""
    each = F.transform(F.sequence(F.lit(0), F.size("ws") - size), lambda i: F.xxhash64(*(F.get("ws", i + k) for k in range(size))))
    return df.where(F.size("ws") >= size).select("*", F.posexplode(each).alias("at", "h"))


def marked(df: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``h`` may be in ``hashes``: by one bit of a bitmap of fixed size."""
    bit = lambda: F.shiftrightunsigned("h", 64 - BITS)
    place, mask = F.shiftrightunsigned(bit(), 6), F.expr("shiftleft(1L, cast(h & 63 as int))")
    # The upper bits choose one of 2 ** (BITS - 6) longs, the lower six of the hash a bit of it.
    cells = hashes.select(F.shiftrightunsigned(bit(), 6).cast("int").alias("place"), mask.alias("mask")).groupBy("place").agg(F.bit_or("mask").alias("mask"))
    every = df.sparkSession.range(2 ** (BITS - 6)).select(F.col("id").cast("int").alias("place"))
    filled = every.join(cells.hint("merge"), "place", "left").select(F.struct("place", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")).alias("c"))
    dense = filled.agg(F.array_sort(F.collect_list("c"))["mask"].alias("bits"))
    bits = cut(dense).scalar()  # one value of fixed size
    return df.where(F.element_at(bits, (place + 1).cast("int")).bitwiseAND(mask) != 0)


def run_around(a: Column, i: Column, b: Column, j: Column, size: int) -> Column:
    """Equal words of ``a`` and ``b`` around those at i and j (from 1), where ``size`` words are equal."""
    back = F.least(i, j) - 1
    on = F.least(F.size(a) - i, F.size(b) - j) - size + 1
    differs = lambda k: F.get(a, i - 1 + k) != F.get(b, j - 1 + k)
    before = F.aggregate(F.sequence(F.lit(0), back), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, k: F.when((k > 0) & s["on"] & ~differs(-k), F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("on"))).when(k == 0, s).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("on"))))["n"]
    after = F.aggregate(F.sequence(F.lit(0), on), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, k: F.when((k > 0) & s["on"] & ~differs(k + size - 1), F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("on"))).when(k == 0, s).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("on"))))["n"]
    return before + size + after


def leaks(documents: DataFrame, items: DataFrame, least: int = 13) -> DataFrame:
    """Pairs (doc_id, item_id); ``documents`` has doc_id and text, ``items`` item_id and text."""
    size, reach = min(SHINGLE, least), least - min(SHINGLE, least)
    own = cut(items.where("item_id is not null and text is not null").select("item_id", words("text").alias("ws")).where(F.size("ws") >= least))
    of_items = cut(shingles(own, size).select("item_id", "at", "h"))
    docs = documents.where("text is not null").select("doc_id", words("text").alias("ws"))
    # How often each shingle of an item stands in the documents: one scan, added up before the shuffle.
    known = of_items.select("h").distinct()
    found = marked(shingles(docs, size).select("h"), known).groupBy("h").agg(F.count("*").alias("n"))
    counts = cut(known.join(found.hint("merge"), "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n")))
    # Of every window of an item, the rarest shingle; windows with one that no document has match nothing.
    places = of_items.join(counts.hint("merge"), "h").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "n", "h"))).alias("s"))
    windows = F.transform(F.sequence(F.lit(1), F.size("s") - reach), lambda i: F.array_min(F.transform(F.slice("s", i, reach + 1), lambda x: F.struct(x["n"].alias("n"), x["h"].alias("h"), x["at"].alias("at")))))
    prefixes = places.select("item_id", F.explode(F.array_distinct(windows)).alias("p")).where("p.n > 0").select("item_id", F.col("p.h").alias("h"), F.col("p.at").alias("q"))
    around = lambda at: F.transform(F.sequence(F.greatest(at - reach, F.lit(0)), F.least(at + size + reach, F.size("ws")) - 1), lambda i: F.get("ws", i))
    prefixes = cut(prefixes.join(own.hint("merge"), "item_id").select("item_id", "h", around(F.col("q")).alias("item"), (F.least("q", F.lit(reach)) + 1).alias("j")))
    hits = marked(shingles(docs, size), prefixes.select("h").distinct()).select("doc_id", "h", around(F.col("at")).alias("text"), (F.least("at", F.lit(reach)) + 1).alias("i"))
    met = hits.join(prefixes.hint("merge"), "h").where(F.slice("text", F.col("i"), size) == F.slice("item", F.col("j"), size))
    return met.where(run_around(F.col("text"), F.col("i"), F.col("item"), F.col("j"), size) >= least).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each item leaked into; items that leaked nowhere have 0."""
    found = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(found.hint("merge"), "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}

_PAIRS = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') ws from documents), i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') ws from benchmark),
dw as (select distinct doc_id, array_to_string(ws[k:k + 12], ' ') w from d, unnest(range(1, len(ws) - 11)) t(k)), iw as (select distinct item_id, array_to_string(ws[k:k + 12], ' ') w from i, unnest(range(1, len(ws) - 11)) t(k)),
found as (select distinct doc_id, item_id from dw join iw using (w))
"""
SQL = {"p8_found": _PAIRS + "select doc_id, item_id from found", "p8_items": _PAIRS + "select item_id, count(doc_id) as documents from benchmark left join found using (item_id) group by item_id"}
