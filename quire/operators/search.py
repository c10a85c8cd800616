"""Full-text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def bm25(df: DataFrame, key: str, text: str, query: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best rows for the words of a query. Only rows with one of its words leave the scan's stage."""
    t = df.select(key, words(text).alias("w")).withColumn("size", F.size("w"))
    total = t.agg(F.count("*").alias("total"), F.avg("size").alias("mean"))
    terms = F.array(*map(F.lit, query))
    hits = t.where(F.arrays_overlap("w", terms)).select(key, "size", F.explode(F.filter("w", lambda x: F.array_contains(terms, x))).alias("term"))
    tf = hits.groupBy(key, "size", "term").agg(F.count("*").alias("tf"))
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    s = tf.join(F.broadcast(df_), "term").crossJoin(F.broadcast(total))  # a row a word; one row
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return s.groupBy(key).agg(F.round(F.sum(score), 4).alias("score")).orderBy(F.desc("score"), key).limit(k)
