"""Names of files and titles: canonical names under a byte limit, sentence case, segments outside formulas, intervals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import c, spaces, sub

SMALL = {"a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "via", "with", "versus"}
FORMULA = re.compile(r"\$[^$]*\$|\\\([^)]*\\\)|\\[A-Za-z]+(?:\{[^{}]*\})*")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def canonical_name(authors: Column, title: str | Column, limit: int = 251) -> Column:
    """"Family, I. and Family, I. - Title" in at most ``limit`` bytes: as many authors as fit, then et al."""
    clean = sub(sub(title, r"\s*:\s*", ", "), r'[<>"/\\|?*]', "")

    def name(k: Column) -> Column:
        who = F.concat_ws(", ", F.slice(authors, 1, k))
        return F.concat(F.when(k < F.size(authors), F.concat(who, F.lit(" et al."))).otherwise(who), F.lit(" - "), clean)

    options = F.transform(F.sequence(F.lit(1), F.greatest(F.size(authors), F.lit(1))), lambda k: F.struct(k.alias("k"), name(k).alias("name")))
    fits = F.filter(options, lambda o: F.octet_length(o["name"]) <= limit)
    return F.when(F.size(fits) > 0, F.array_max(fits)["name"]).otherwise(F.left(clean, F.lit(limit // 4)))


def spaced_name(x: str | Column) -> Column:
    """Even commas, the separator with single spaces, a double hyphen as a dash."""
    y = sub(sub(x, r"\s*,\s*", ", "), r"\s+-\s+", " - ")
    return spaces(sub(y, r"(?<=\S)--(?=\S)", "–"))


def _segments(text: str | None) -> list[tuple[str, int, int]]:
    if not text:
        return []
    out, at = [], 0
    for m in FORMULA.finditer(text):
        out += [(m2.lastgroup, m2.start(), m2.end()) for m2 in WORD_KINDS.finditer(text, at, m.start())]
        out.append(("math", m.start(), m.end()))
        at = m.end()
    return out + [(m2.lastgroup, m2.start(), m2.end()) for m2 in WORD_KINDS.finditer(text, at)]


WORD_KINDS = re.compile(r"(?P<word>[^\W\d_]+(?:[-'’][^\W\d_]+)*)|(?P<number>\d+(?:\.\d+)?)|(?P<space>\s+)|(?P<mark>[^\w\s]|_)")


@F.pandas_udf(SPAN)
def segments(x: pd.Series) -> pd.Series:
    """Formulas, words, numbers, spaces and marks with their places; they cover the text without overlap."""
    return pd.Series([[{"kind": k, "start": a, "stop": b} for k, a, b in _segments(t)] for t in x])


def sentence_case_of(title: str | None, keep: frozenset[str] = frozenset()) -> str | None:
    """Capitals only at the start, after a colon, in acronyms, in words with inner capitals and in kept words."""
    if title is None:
        return None
    shout = sum(ch.isupper() for ch in title) > 0.7 * max(1, sum(ch.isalpha() for ch in title))
    out, first = [], True
    for kind, a, b in _segments(title):
        w = title[a:b]
        if kind == "word":
            if w.lower() in keep or w in keep:
                pass
            elif not shout and (w[1:] != w[1:].lower() or (len(w) > 1 and w.isupper())):
                pass  # an acronym or a name with inner capitals
            else:
                w = w.lower()
                if first:
                    w = w[0].upper() + w[1:]
            first = False
        elif kind == "mark" and w in ":?!":
            first = True
        elif kind in ("math", "number"):
            first = False
        out.append(w)
    return "".join(out)


@F.pandas_udf(T.StringType())
def sentence_case(x: pd.Series) -> pd.Series:
    return x.map(sentence_case_of, na_action="ignore")


def merged_intervals(df: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """Intervals of each key that touch or overlap, made one."""
    w = Window.partitionBy(key).orderBy(start, stop)
    before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("new", F.when(before >= F.col(start), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return new.groupBy(key, "run").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("run")


def initials(given: Column) -> Column:
    """"Anne-Lise Maria" as "A.-L. M."."""
    return F.array_join(F.transform(F.split(F.trim(given), r"\s+"), lambda w: F.array_join(F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lit("."))), "-")), " ")


def accents(x: str | Column) -> Column:
    """Accent macros of typesetting as letters."""
    y = c(x)
    for macro, marks in (("\\\\'", ("aáeéiíoóuúyýcćnń")), ("\\\\`", "aàeèiìoòuù"), ('\\\\"', "aäeëiïoöuü"), ("\\\\~", "nñaãoõ"), ("\\\\c", "cçsş")):
        for k in range(0, len(marks), 2):
            y = F.regexp_replace(y, rf"{macro}\{{?{marks[k]}\}}?", marks[k + 1])
    return y
