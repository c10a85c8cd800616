"""Mixing sources to target weights (problem 9).

Sizes are tokens of a public tokenizer. Capped water-filling: with a total size T, a source asks
for its share of T; a source that would need more than ``max_repeats`` of itself is held there, and
what it lacks is shared among the others by their weights, again and again until nothing exceeds a
cap. A source used r times has all its documents floor(r) times and, once more, documents in seeded
order until the fraction is filled. That order is cut at a bucket of the hash, found from sums by
bucket, so a source of any size is neither sorted nor gathered.

Defined cases: documents without a source, of a source without a target, or with null or empty text
(no tokens) are not used; targets without documents are reported with nothing reached; texts are
read whole; rows with the same id count each; empty tables give empty results; other columns stay out.
"""

from __future__ import annotations

import base64
import os
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, table

TOKENIZER = os.environ.get("QUIRE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str):
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        e = encoding(path)
        return pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def water_fill(sources: dict[str, tuple[float, float, float]], total: float) -> dict[str, float]:
    """Tokens of each source from (share, tokens, cap on repeats), as near to the shares of ``total`` as caps allow."""
    out = {s: 0.0 for s in sources}
    open_ = {s for s, (p, t, m) in sources.items() if p > 0 and t * m > 0}
    left = total
    while open_:
        weight = sum(sources[s][0] for s in open_)
        full = {s for s in open_ if left * sources[s][0] / weight >= sources[s][1] * sources[s][2]}
        if not full:
            for s in open_:
                out[s] = left * sources[s][0] / weight
            break
        for s in full:
            out[s] = sources[s][1] * sources[s][2]
            left -= out[s]
        open_ -= full
    return out


def reachable(sources: dict[str, tuple[float, float, float]]) -> float:
    """The largest total at which every source that has documents still gets its share (shares of the others set aside)."""
    open_ = [(p, t * m) for p, t, m in sources.values() if p > 0 and t * m > 0]
    weight = sum(p for p, _ in open_)
    return min((room * weight / p for p, room in open_), default=0.0)


def plan(documents: DataFrame, targets: DataFrame, seed: int = 7, total: float | str | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(documents with ``tokens`` and ``repeats``, report by source). The default total is all tokens of the sources with targets; "reachable" is the largest that meets every target."""
    spark = documents.sparkSession
    goals = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    docs = documents.select("doc_id", "source", "text").join(F.broadcast(goals.select("source")), "source", "left_semi")
    docs = cut(docs.select("doc_id", "source", token_counter(tokenizer)("text").alias("tokens"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**40)).alias("u")).where("tokens > 0"))
    have = goals.join(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")), "source", "left").fillna(0, ["tokens"])
    rows = have.collect()  # one row a target: their table is a setting, not data
    known = {r["source"]: (float(r["target_share"]), float(r["tokens"]), float(r["max_repeats"])) for r in rows}
    asked = reachable(known) if total == "reachable" else total if total is not None else sum(t for _, t, _ in known.values())
    goal = water_fill(known, asked)
    chosen = spark.createDataFrame(
        [(s, float(p), int(m), int(t), g, float(int(g // t)) if t else 0.0, g - (g // t) * t if t else 0.0, bool(t and g >= t * m)) for s, (p, t, m) in known.items() for g in [goal[s]]],
        "source string, target_share double, max_repeats int, tokens long, planned double, whole double, rest double, capped boolean",
    )
    width = 2**40 // BUCKETS
    docs = docs.withColumn("bucket", F.floor(F.col("u") / width))
    sums = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n"))
    used = docs.join(F.broadcast(chosen.select("source", "whole", "rest")), "source").join(sums.select("source", "bucket", "before"), ["source", "bucket"])
    run = Window.partitionBy("source", "bucket").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("tokens").over(run) - F.col("tokens") / 2
    used = used.withColumn("repeats", (F.col("whole") + F.when(upto <= F.col("rest"), 1).otherwise(0)).cast("int"))
    used = cut(used.select("doc_id", "source", "tokens", "repeats"))
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    all_ = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = chosen.join(got, "source", "left").crossJoin(F.broadcast(all_)).select(  # one row
        "source", "target_share", "max_repeats", "tokens", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "capped",
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce(F.try_divide("mixed_tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"),
    )
    return used.where("repeats > 0"), report


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of the largest mixture that meets every target whose source has documents."""
    return plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total="reachable")[1]


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_reachable": p9_reachable}
