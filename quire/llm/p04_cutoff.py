"""Text cut off by field limits (problem 4).

Lengths: per field and source a histogram of the lengths of different texts is made (copies count
once, so neither a short text in frequent use nor a table given twice makes a limit); lengths that hold many more values
than their surroundings are candidate limits; a log-normal length distribution, right-censored at
those limits, is fitted by maximum likelihood (EM); it gives the probability that a value of that
length was longer (the censoring posterior). Away from limits a value has its source's share of
cuts at any length (cut in mid-transfer).

Endings: the corpus tells, for every word, how often it ends a title or sentence and how often it
stands elsewhere. The posterior odds are multiplied by the likelihood ratio of the ending: a mark
of omission, an open formula or broken entity, a beginning of a known word, a word that rarely ends
a sentence. A cut value has odds above one.

Defined cases: null and blank values are never cut; texts of any length are read whole; repeated
rows are judged each by itself; sources that are null or blank form one source (null); an empty
table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, table
from .p01_glyphs import canonical

MARKER = r"\s*(\[\s*(\.\.\.|…)\s*\]|\(more\)|\[more\]|\.\.\.|…)\s*$"
BROKEN = r"(&#?[A-Za-z0-9]*|\\[A-Za-z]*|[(\[{,:;–/-])$"
STOPPED = r"[.!?][\"')\]]*$"
ENDS = "\t\n\x0b\f\r\u0085\u2028\u2029"  # before these a pattern's $ may match
MID_WORD = 0.65  # share of cuts that fall inside a word
SENTENCE, EDGE = re.compile(r"[.!?]\s+"), re.compile(r"[.,;:!?()\[\]\"']+(?=\s|$)|(?<=\s)[(\[\"']+")
FRAME_WORD = 1000  # a word is part of a frame if it is at least one of so many; thus there are at most so many
SAME_CUT = 0.01  # chance that another source cuts a text at the same place
NO_STOP = 0.03  # share of complete sentences that lack their stop


def source_name(c: str | Column) -> Column:
    """Trimmed, lower case, space and hyphen as underscore; null if nothing remains."""
    plain = F.regexp_replace(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), "[ -]", "_")
    return F.when(plain != "", plain)


def survival(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)])


def fit_limits(lengths: np.ndarray, counts: np.ndarray, least: int = 8, times: float = 2.5) -> tuple[list[tuple[int, float]], float, float]:
    """Candidate limits with their censoring posterior, and the fitted mean and deviation of log length."""
    keep = lengths > 0
    lengths, counts = lengths[keep], counts[keep].astype(float)
    total = counts.sum()
    if total < 20:
        return [], 0.0, 1.0
    dense = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    limits = []
    for n, c in dense.items():
        if c < least:
            continue
        around = [dense.get(n + d, 0.0) for d in range(-12, 13) if abs(d) > 1]
        usual = max(float(np.mean(sorted(around)[2:-3])), 0.5)
        if c > times * usual and c - usual > 4 * math.sqrt(usual):
            limits.append((n, c, usual))
    x = np.log(lengths)
    at = {n: i for i, n in enumerate(lengths.tolist())}
    post = {n: 1 - usual / c for n, c, usual in limits}
    mean = float(np.average(x, weights=counts))
    dev = max(float(np.sqrt(np.average((x - mean) ** 2, weights=counts))), 1e-3)
    for _ in range(25 if limits else 0):
        w = counts.copy()
        s1, s2, extra = 0.0, 0.0, 0.0
        for n, c, usual in limits:
            z = (math.log(n + 0.5) - mean) / dev
            tail = max(float(survival(z)[0]), 1e-9)
            mills = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
            m = c * post[n]
            w[at[n]] -= m
            e1 = mean + dev * mills
            e2 = mean**2 + 2 * mean * dev * mills + dev**2 * (1 + z * mills)
            s1, s2, extra = s1 + m * e1, s2 + m * e2, extra + m
        all_ = w.sum() + extra
        new = (float((w * x).sum()) + s1) / all_
        dev = math.sqrt(max((float((w * x * x).sum()) + s2) / all_ - new**2, 1e-6))
        mean = new
        for n, c, usual in limits:
            z = (math.log(n) - mean) / dev
            natural = total * math.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * dev * n)
            post[n] = min(max(1 - (0.5 * natural + 0.5 * usual) / c, 0.02), 0.995)  # local and fitted density alike
    return [(n, post[n]) for n, _, _ in limits], mean, dev


def _limits(pdf: pd.DataFrame) -> pd.DataFrame:
    found, mean, dev = fit_limits(pdf["n"].to_numpy(np.int64), pdf["rows"].to_numpy())
    first = pdf.iloc[0]
    return pd.DataFrame({"field": first["field"], "source": first["source"], "n": [n for n, _ in found], "posterior": [p for _, p in found], "log_mean": mean, "log_dev": dev}).astype({"n": "int64"})


def ends_with(c: Column, *ends: str) -> Column:
    return reduce(or_, (c.endswith(e) for e in ends))


def unmarked(c: Column) -> Column:
    """Without the mark of omission; texts that cannot end in one are not searched."""
    return F.when(ends_with(c, "...", "…", ")", "]", " ", *ENDS), F.regexp_replace(c, MARKER, "")).otherwise(c)


def is_stopped(c: Column) -> Column:
    return ends_with(c, ".", "!", "?") | (ends_with(c, '"', "'", ")", "]", *ENDS) & c.rlike(STOPPED))


def is_broken(c: Column) -> Column:
    times = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    opened = reduce(or_, (c.contains(a) & (times(a) > times(b)) for a, b in ("()", "[]")))
    return ends_with(c, *"([{,:;–/-") | ((c.contains("&") | c.contains("\\") | ends_with(c, *ENDS)) & c.rlike(BROKEN)) | (c.contains("$") & (times("$") % 2 == 1)) | opened


def line(c: Column) -> Column:
    """Words in lower case, one space between two."""
    low = F.lower(c)
    return F.when(reduce(or_, (low.contains(x) for x in ("  ", "\t", "\n", "\x0b", "\f", "\r"))), F.regexp_replace(low, r"\s+", " ")).otherwise(low)


def endings(df: DataFrame, fields: list[str], key: str = "id", source: str = "source") -> DataFrame:
    """One row a filled value: its text without the mark of omission, length and last word."""
    one = df.select(
        F.col(key).alias("id"),
        source_name(source).alias("source"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.trim(canonical(F.col(f))).alias("text"), F.length(unmarked(F.trim(F.col(f)))).cast("long").alias("raw_n")) for f in fields))).alias("v"),
    ).select("id", "source", "v.*")
    one = one.where("text <> ''").withColumn("bare", unmarked(F.col("text"))).withColumn("line", line(F.col("bare")))
    return one.select(
        "id", "source", "field", "bare",
        (F.col("bare") != F.col("text")).alias("marked"),
        F.length("bare").cast("long").alias("n"),
        "raw_n",
        is_stopped(F.col("bare")).alias("stopped"),
        is_broken(F.col("bare")).alias("broken"),
        F.xxhash64("line").alias("text"),
        plain_word(F.substring_index("line", " ", -1)).alias("last"),
    )


def frames(common: set[str]):
    """A function that gives the frame of a text's last unit: its frequent words, and a star for each other word."""

    @F.pandas_udf(T.StringType())
    def frame(texts: pd.Series, fields: pd.Series) -> pd.Series:
        out = []
        for text, field in zip(texts, fields, strict=True):
            unit = text if field == "title" else SENTENCE.split(text.rstrip(" .!?"))[-1]
            out.append(" ".join(w if w in common else "*" for w in EDGE.sub(" ", unit.lower()).split()))
        return pd.Series(out)

    return frame


def plain_word(c: Column) -> Column:
    return F.regexp_replace(c, r"^[(\[\"']+|[.,;:!?)\]\"']+$", "")


def cut_values(df: DataFrame, fields: list[str], key: str = "id", source: str = "source") -> DataFrame:
    """Every filled value of ``fields`` with ``source``, ``limit_posterior``, ``odds`` and ``is_cut``."""
    rows = cut(endings(df, fields, key, source))
    texts = rows.where(~F.col("stopped") | (F.col("field") == "title")).select("field", "source", "n", F.xxhash64("bare").alias("text")).distinct()
    histogram = texts.groupBy("field", "source", "n").agg(F.count("*").alias("rows"))
    limits = cut(histogram.groupBy("field", "source").applyInPandas(_limits, "field string, source string, n long, posterior double, log_mean double, log_dev double"))

    for n, name in (("n", "by_n"), ("raw_n", "by_raw")):  # the cut may have come before or after the odd characters
        at = limits.select(F.col("field").alias("f_"), F.col("source").alias("s_"), F.col("n").alias("n_"), F.col("posterior").alias(name))
        rows = rows.join(F.broadcast(at), F.col("s_").eqNullSafe(F.col("source")) & (F.col("field") == F.col("f_")) & (F.col(n) == F.col("n_")), "left").drop("f_", "s_", "n_")
    rows = rows.withColumn("posterior", F.greatest("by_n", "by_raw")).drop("by_n", "by_raw", "raw_n")

    # How each word is used: at an end, or elsewhere. Values at a limit don't count as ends.
    once = rows.withColumn("sure", F.col("posterior").isNull() & ~F.col("marked") & ~F.col("broken")).groupBy("field", "text").agg(F.first("bare").alias("bare"), F.max("sure").alias("sure"))
    used = once.select("field", F.split(line(F.col("bare")), " ").alias("ws"), "sure").select("field", F.posexplode("ws").alias("at", "w"), F.size("ws").alias("size"), "sure")
    final = F.col("at") == F.col("size") - 1
    used = used.groupBy("field", "w").agg(F.count("*").alias("all"), F.count_if(~final).alias("before"), F.count_if(final & F.col("sure") & (F.col("field") == "title")).alias("closing"))
    stop = F.col("w").rlike(STOPPED)
    words = used.groupBy("field", plain_word(F.col("w")).alias("w")).agg(F.sum(F.when(stop, F.col("all")).otherwise(F.col("closing"))).alias("ends"), F.sum(F.when(stop, F.lit(0)).otherwise(F.col("before"))).alias("inside")).where("ends + inside > 0")
    words = cut(words)
    total = words.groupBy("field").agg(F.sum("ends").alias("all_ends"), F.sum("inside").alias("all_inside"))
    known = words.groupBy("w").agg(F.sum(F.col("ends") + F.col("inside")).alias("seen")).where("seen > 1")
    # A last word that is not known but begins a known one was cut inside.
    lasts = rows.where(~F.col("stopped")).select(F.col("last").alias("w")).distinct()
    begun = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - 1, F.lit(1))), lambda k: F.substring("w", F.lit(1), k))).alias("w"), "seen").groupBy("w").agg(F.sum("seen").alias("begins"))
    lasts = lasts.join(begun, "w", "left").select(F.col("w").alias("last"), "begins")
    tokens = words.agg(F.sum(F.col("ends") + F.col("inside"))).first()[0] or 0
    common = {r["w"] for r in words.groupBy("w").agg(F.sum(F.col("ends") + F.col("inside")).alias("seen")).where(F.col("seen") * FRAME_WORD > tokens).collect()}
    rows = cut(rows.withColumn("frame", frames(common)("bare", "field")).drop("bare"))
    whole = F.when(F.col("field") == "title", F.col("posterior").isNull()).otherwise(F.col("stopped"))
    of_text = cut(rows.groupBy("field", "text").agg(F.max(whole).alias("whole"), F.first("frame").alias("frame"), F.count_distinct("source").alias("sources")))
    seen = of_text.where("whole").groupBy("field", "frame").agg(F.count("*").alias("frame_ends"))
    # A value cut between words leaves the beginning of a whole frame, as often as whole frames begin so.
    fs = F.split("frame", " ")
    begun_frames = seen.where(F.size(fs) > 1).select("field", "frame_ends", F.explode(F.transform(F.sequence(F.lit(1), F.size(fs) - 1), lambda i: F.array_join(F.slice(fs, 1, i), " "))).alias("frame"))
    begun_frames = begun_frames.groupBy("field", "frame").agg(F.sum("frame_ends").alias("frame_begins"))
    seen = cut(seen.join(begun_frames.hint("merge"), ["field", "frame"], "full").fillna(0, ["frame_ends", "frame_begins"]))
    all_frames = seen.groupBy("field").agg(F.sum("frame_ends").alias("all_frames"), F.sum("frame_begins").alias("all_begins"))
    rows = (
        rows.join(seen.hint("merge"), ["field", "frame"], "left").join(F.broadcast(all_frames), "field", "left").join(words.withColumnRenamed("w", "last").hint("merge"), ["field", "last"], "left")
        .join(F.broadcast(total), "field").join(lasts.hint("merge"), "last", "left").join(of_text.select("field", "text", "sources").hint("merge"), ["field", "text"])
        .fillna(0, ["ends", "inside", "begins", "frame_ends", "frame_begins"])
    )
    uses = F.col("ends") + F.col("inside")
    fragment = F.col("begins") > 100 * (uses + 1)  # a beginning, hardly ever seen as a word
    unseen = (uses <= 1) | fragment
    boundary = (1 - MID_WORD) * ((F.col("inside") + 0.2) / (F.col("all_inside") + 1)) / ((F.col("ends") + 0.2) / (F.col("all_ends") + 1))
    usual = F.col("all_begins") / F.greatest("all_frames", F.lit(1))
    by_frame = ((F.col("frame_begins") + 0.2 * usual) / (F.col("all_begins") + 1)) / ((F.col("frame_ends") + 0.2) / (F.col("all_frames") + 1))
    ratio = (
        F.when(F.col("marked") | F.col("broken"), F.lit(1e6))
        .when(unseen & (F.col("begins") > 0), F.lit(MID_WORD / 0.002))
        .when(unseen, F.lit(2.0))
        .when(F.col("last").contains("$"), F.lit(0.01))  # a formula that is closed
        .otherwise(F.least(boundary * F.least(by_frame, F.lit(20.0)), F.lit(1e4)))
    )
    ratio = F.when(F.col("stopped") & ~F.col("marked"), F.lit(1e-4)).when(F.col("field") != "title", ratio * ((1 - NO_STOP) / NO_STOP)).otherwise(ratio)
    # Share of values that a source cuts at any length, from the endings that leave no doubt.
    base = rows.groupBy("field", F.col("source").alias("s")).agg(((F.count_if((F.col("begins") > 0) & unseen & ~F.col("stopped") & F.col("posterior").isNull()) / MID_WORD + 0.2) / (F.count("*") + 100)).alias("base"))
    rows = rows.withColumn("ratio", ratio)
    rows = rows.join(F.broadcast(base), (rows["field"] == base["field"]) & F.col("s").eqNullSafe(F.col("source")), "left").drop(base["field"])
    prior = F.least(F.greatest(F.coalesce("posterior", F.lit(0.0)), F.coalesce("base", F.lit(1e-3)), F.lit(1e-4)), F.lit(0.999))
    # Sources that cut each for itself away from a limit hardly leave the same text.
    alike = F.when(F.col("posterior").isNull() & ~F.col("marked"), F.pow(F.lit(SAME_CUT), F.col("sources") - 1)).otherwise(1.0)
    odds = F.col("ratio") * alike * prior / (1 - prior)
    return rows.select("id", "field", "source", "n", F.coalesce("posterior", F.lit(0.0)).alias("limit_posterior"), odds.alias("odds"), (odds > 1).alias("is_cut"))


FIELDS = ["title", "abstract"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_values(table(spark, sf_dir, "papers").select("id", "source", *FIELDS), FIELDS).where("is_cut").select("id", "field")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts: values, cut values and their share."""
    v = cut_values(table(spark, sf_dir, "papers").select("id", "source", *FIELDS), FIELDS)
    return v.groupBy("source", "field").agg(F.count("*").alias("values"), F.count_if("is_cut").alias("cut_values"), F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("share"))


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates}
