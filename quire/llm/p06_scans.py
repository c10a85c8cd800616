"""Noise in text from scanned pages (problem 6).

Every text is split into lines. Running headers are the lines in capitals that stay when digits
are masked, page numbers the lines with nothing but a number. A line that ends in a hyphen is
joined to the next text line by SQL windows (headers, page numbers and blank lines between are
passed over); the corpus decides whether the hyphen belongs to the word. Words are grouped by the
skeleton of their glyphs, in which all confusable glyphs are one; a rare form is a misreading of
a form of its group that is much more frequent, if known confusions turn one into the other.

Defined cases: a null or empty text has no lines that need repair; texts are read whole; equal
rows count once; two different texts under one path are treated apart; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, table

# Glyphs that scanners confuse (read as, meant).
CONFUSIONS = [
    ("!", "i"), ("1", "l"), ("1", "i"), ("5", "s"), ("0", "o"), ("6", "b"), ("c", "e"), ("l", "t"), ("q", "g"), ("rn", "m"), ("cl", "d"),
    ("li", "h"), ("m", "in"), ("m", "ni"), ("m", "rn"), ("vv", "w"), ("ñ", "fi"), ("d", "cl"), ("h", "li"), ("8", "b"), ("9", "g"), ("ii", "u"), ("u", "ii"), ("fl", "ﬂ"), ("e", "c"), ("i", "l"), ("l", "i"), ("nn", "rm"),
]
SECTION = r"^\s*(\d+|[IVX]+)(\.\d+)*\.\s"
WORDS = r"[\p{L}0-9!]*\p{L}[\p{L}0-9!]*"
MATH = r"\$[^$]*\$|\\[A-Za-z]+|\$.*$"
HYPHEN = r"(\p{L}[\p{L}0-9!]*)[-‐¬­]$"
SHARE = 2000  # a header is in one of so many texts
TIMES = 8  # a frequent form is so many times as frequent as its misreading
BROADCAST_ROWS = 200_000


@lru_cache(maxsize=200_000)
def skeleton(word: str) -> str:
    """The word with every confusable glyph in one form; equal for a word and its misreadings."""
    w = word
    for a, b in (("ñ", "fi"), ("1", "i"), ("!", "i"), ("5", "s"), ("0", "o"), ("6", "b"), ("8", "b"), ("9", "g"), ("q", "g"), ("vv", "w"), ("t", "l"), ("l", "i"), ("c", "e")):
        w = w.replace(a, b)
    # all that follows sees t, l, i, 1, ! as i and c as e
    for a, b in (("rn", "m"), ("nn", "m"), ("in", "m"), ("ni", "m"), ("ei", "d"), ("ii", "h"), ("u", "h")):
        w = w.replace(a, b)
    return w


def explains(meant: str, read: str, most: int = 3) -> bool:
    """Whether at most ``most`` known confusions turn the one word into the other."""
    front = {(0, 0): 0}
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        k = front[i, j]
        if i == len(meant) and j == len(read):
            return True
        steps = [(i + 1, j + 1, k)] if i < len(meant) and j < len(read) and meant[i] == read[j] else []
        steps += [(i + len(m), j + len(r), k + 1) for r, m in CONFUSIONS if k < most and meant.startswith(m, i) and read.startswith(r, j)]
        for a, b, n in steps:
            if front.get((a, b), most + 1) > n:
                front[a, b] = n
                todo.append((a, b))
    return False


@F.pandas_udf(T.StringType())
def skeletons(words: pd.Series) -> pd.Series:
    return words.map(skeleton, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def explained(meant: pd.Series, read: pd.Series) -> pd.Series:
    return pd.Series([explains(m, r) for m, r in zip(meant, read, strict=True)], dtype=bool)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row a line, with its kind: header, page_number, blank, other (equations, tables) or text."""
    one = df.select(F.col(key).alias("file_path"), F.col(text).alias("text")).where("text is not null").distinct()
    one = one.select("file_path", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    t = F.rtrim(F.regexp_replace("line", r"\r$", ""))
    letters = F.length(F.regexp_replace("line", r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace("line", r"[^\p{Lu}]", ""))
    # With digits masked a running header is the same on every page: its capitals.
    capitals = (letters >= 3) & (upper >= 0.75 * letters) & ~F.col("line").rlike(SECTION) & ~F.col("line").rlike(r"[=\\$]")
    capitals = capitals | (F.col("line").rlike(r"^\s*[\p{Lu}0-9!][\p{Lu}0-9!' .–-]{3,}:\s") & (letters >= 6))
    number = F.col("line").rlike(r"^\s*([\[(]\s*[0-9OolIS]{1,5}\s*[\])]|[-–—]\s*[0-9OolIS]{1,5}\s*[-–—]|[0-9OolIS]{1,5}\.?|[Pp](a[gq]e|\.)\s*[0-9OolIS]{1,5}(\s+[o0]f\s+[0-9OolIS]{1,5})?)\s*$") & F.col("line").rlike(r"\d")
    kind = (
        F.when(F.trim("line") == "", "blank").when(number, "page_number").when(capitals, "header")
        .when(F.col("line").rlike(r"^\s*\S+\s*=|^\s{2,}\S.*=|^\s*\d+\s+[\d.]+\s+[\d.]+\s*$"), "other").otherwise("text")
    )
    one = one.select("file_path", "copy", (F.col("k") + 1).cast("long").alias("line_no"), t.alias("line"), kind.alias("kind"))
    # Lines whose last part has digits and, with these masked, stands in other places too, are headers.
    last = F.regexp_extract("line", r"([^,]*)$", 1)
    masked = F.regexp_replace(last, r"[\p{L}!]*\d[\p{L}\d!]*", "#")
    numbered = (F.col("kind") == "text") & F.col("line").rlike(r"^\s*[\p{Lu}\d].*\d") & masked.rlike("#\\W*$") & ~F.col("line").rlike(r"[$\\]|[.-]$")
    one = cut(one.withColumn("mask", F.when(numbered, skeletons(F.lower(F.trim(masked))))))
    # Again and again, and in a share of all texts: chance repetitions of a line of text stay below it at any size.
    texts = one.agg(F.count_if(F.col("line_no") == 1).alias("texts")).scalar()
    masks = one.where("mask is not null").groupBy("mask").agg(F.count("*").alias("n")).where((F.col("n") >= 3) & (F.col("n") * SHARE >= texts)).select("mask", F.lit(True).alias("again"))
    one = one.join(masks.hint("merge"), "mask", "left")
    return one.select("file_path", "copy", "line_no", "line", F.when(F.col("again"), "header").otherwise(F.col("kind")).alias("kind"))


def plain(c: str | Column) -> Column:
    """The words of a line in lower case, formulas left out."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), MATH, " "), F.lit(WORDS), 0)


def repaired(df: DataFrame, key: str = "file_path", text: str = "text_extract") -> dict[str, DataFrame]:
    """``lines``: each line with kind and hyphen state; ``words``: misread form and form meant; ``misread``: their lines."""
    every = lines(df, key, text)
    w = Window.partitionBy("file_path", "copy").orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("file_path", "copy").orderBy(F.col("line_no").desc())
    of_text = F.when(F.col("kind") == "text", F.struct("line_no", "line"))
    every = every.withColumn("next", F.last(of_text, ignorenulls=True).over(w)).withColumn("joined_before", F.lit(None).cast("string"))
    head = F.regexp_extract("line", HYPHEN, 1)
    tail = F.regexp_extract("next.line", r"^\s*([\p{Ll}0156!][\p{L}0-9!]+|\p{Ll})", 1)
    splits = (F.col("kind") == "text") & (head != "") & (tail != "") & ~F.col("line").rlike(r"\$[-‐]$")
    every = every.withColumn("head", F.when(splits, F.lower(head))).withColumn("tail", F.when(splits, F.lower(tail)))
    every = every.drop("joined_before").withColumn("came", F.last(F.when(F.col("kind") == "text", F.struct("tail")), ignorenulls=True).over(Window.partitionBy("file_path", "copy").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))["tail"])
    every = cut(every.select("file_path", "copy", "line_no", "line", "kind", "head", "tail", F.when(F.col("kind") == "text", F.col("came")).alias("came"), F.col("next.line_no").alias("next_no")))

    # Whole words: neither a beginning before a hyphen nor its end; and the pairs that hyphens join.
    found = plain("line")
    found = F.when(F.col("came").isNotNull(), F.slice(found, 2, F.greatest(F.size(found), F.lit(1)))).otherwise(found)
    found = F.when(F.col("head").isNotNull(), F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)
    whole = every.where("kind = 'text'").select("file_path", "copy", "line_no", F.explode(found).alias("w"))
    pairs = every.where("head is not null").select("file_path", "copy", "line_no", "next_no", "head", "tail", F.concat("head", "tail").alias("w"))
    counts = cut(whole.select("w").unionByName(pairs.select("w")).groupBy("w").agg(F.count("*").alias("n")).withColumn("skeleton", skeletons("w")))

    # Compounds that keep their hyphen, from where they stand within a line.
    inner = F.regexp_extract_all(F.regexp_replace(F.lower("line"), MATH, " "), F.lit(r"\p{L}+-\p{L}+"), 0)
    compounds = every.where("kind = 'text'").select(F.explode(inner).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    compounds = compounds.groupBy(skeletons(F.regexp_replace("c", "-", "")).alias("skeleton")).agg(F.sum("n").alias("as_compound"))
    joined = whole.groupBy("w").agg(F.count("*").alias("n")).groupBy(skeletons("w").alias("skeleton")).agg(F.sum("n").alias("as_word"))
    kept = pairs.withColumn("skeleton", skeletons("w")).join(compounds.hint("merge"), "skeleton", "left").join(joined.hint("merge"), "skeleton", "left")
    kept = kept.where("coalesce(as_compound, 0) > coalesce(as_word, 0)").select("file_path", "copy", "line_no").withColumn("compound", F.lit(True))
    every = cut(every.join(kept, ["file_path", "copy", "line_no"], "left"))

    # Misread forms: much rarer than a form of the same skeleton that known confusions explain.
    rare = counts.select(F.col("w").alias("read"), F.col("n").alias("read_n"), "skeleton").where("length(read) > 1")
    often = counts.where("n >= 3").select(F.col("w").alias("meant"), F.col("n").alias("meant_n"), "skeleton").where(~F.col("meant").rlike("[0-9!]"))
    near = rare.join(often.hint("merge"), "skeleton").where((F.col("meant_n") >= TIMES * F.col("read_n")) & (F.col("meant") != F.col("read")) & (F.abs(F.length("meant") - F.length("read")) <= 3))
    near = near.where(explained("meant", "read")).groupBy("read").agg(F.max_by("meant", F.struct("meant_n", "meant")).alias("meant"))
    # A digit or mark inside a word is wrong even where the form meant is not known.
    marked = counts.where(F.col("w").rlike(r"\p{L}[0156!]\p{L}|^[0156!]\p{L}{3}|\p{L}{3}[0156]$") & (F.length(F.regexp_replace("w", r"[^\p{L}]", "")) >= 4))
    marked = marked.select(F.col("w").alias("read"), F.translate("w", "0156!", "olsbi").alias("guess"))
    words = cut(marked.join(near, "read", "full").select("read", F.coalesce("meant", "guess").alias("meant")))
    small = F.broadcast(words) if words.count() <= BROADCAST_ROWS else words
    bad = whole.join(small, F.col("w") == F.col("read")).select("file_path", "copy", "line_no", "read", "meant")
    split = pairs.join(small, F.col("w") == F.col("read"))
    first = split.where(~F.expr("startswith(meant, head)")).select("file_path", "copy", "line_no", "read", "meant")
    second = split.where(F.expr("startswith(meant, head)")).select("file_path", "copy", F.col("next_no").alias("line_no"), "read", "meant")
    return {"lines": every, "words": words, "misread": bad.unionByName(first).unionByName(second)}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = repaired(table(spark, sf_dir, "pdf_cache").select("file_path", "text_extract"))
    every = r["lines"]
    kinds = every.where("kind in ('header', 'page_number')").select("file_path", "line_no", "kind")
    hyphens = every.where("head is not null and compound is null").select("file_path", "line_no", F.lit("hyphen").alias("kind"))
    misread = r["misread"].select("file_path", "line_no", F.lit("misread").alias("kind"))
    return kinds.unionByName(hyphens).unionByName(misread).distinct()


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text as continuous paragraphs."""
    r = repaired(table(spark, sf_dir, "pdf_cache").select("file_path", "text_extract"))
    key = ["file_path", "copy"]
    body = r["lines"].where("kind not in ('header', 'page_number')")
    w = Window.partitionBy(*key).orderBy("line_no")
    body = body.withColumn("paragraph", F.sum(F.when(F.col("kind") == "blank", 1).otherwise(0)).over(w)).where("kind <> 'blank'")
    fixes = r["misread"].groupBy(*key, "line_no").agg(F.collect_set(F.struct("read", "meant")).alias("fixes"))
    body = body.join(fixes, [*key, "line_no"], "left")
    fixed = F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<read:string,meant:string>>")), F.col("line"), lambda s, f: F.regexp_replace(s, F.concat(F.lit(r"(?i)(?<![\p{L}0-9!])\Q"), f["read"], F.lit(r"\E(?![\p{L}0-9!])")), f["meant"]))
    joins = F.col("head").isNotNull()
    text = F.when(joins & F.col("compound").isNull(), F.regexp_replace(fixed, r"[-‐¬­]$", "")).when(joins, fixed).otherwise(F.concat(fixed, F.lit(" ")))
    parts = body.select(*key, "paragraph", F.struct("line_no", F.regexp_replace(text, r"^\s+", "").alias("text")).alias("part"))
    whole = parts.groupBy(*key, "paragraph").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.min("part.line_no").alias("first_line"))
    return whole.select("file_path", "first_line", F.rtrim(F.array_join("parts.text", "")).alias("text"))


QUERIES = {"p6_found": p6_found, "p6_paragraphs": p6_paragraphs}
