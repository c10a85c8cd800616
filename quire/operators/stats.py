"""Statistics by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import cosine


def distribution(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, extremes, mean and interpolated percentiles; percentiles come from a histogram of values, combined before the shuffle."""
    p = lambda q: F.round(F.percentile(value, F.lit(q)), 3)
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 3).alias("mean"),
        p(0.5).alias("median"), p(0.05).alias("p5"), p(0.95).alias("p95"),
    )


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """The middle value of each group, the upper one of two; found in running counts of distinct values."""
    from pyspark.sql import Window

    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w))
    return run.where("upto > floor(all / 2)").groupBy(group).agg(F.min(value).alias("upper_median"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal bins between the extremes, the last one closed."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = df.crossJoin(F.broadcast(ends))  # one row
    k = F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / float(bins))), F.lit(bins - 1))
    return x.groupBy(k.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def exponential_average(df: DataFrame, group: str, order: list[str], value: str, weight: float) -> DataFrame:
    """The moving average after the last value, without gathering a group: each value has its final weight in closed form."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    r = df.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))
    share = F.when(F.col("rn") == 1, F.pow(F.lit(1 - weight), F.col("n") - 1)).otherwise(weight * F.pow(F.lit(1 - weight), F.col("n") - F.col("rn")))
    return r.groupBy(group).agg(F.round(F.sum(F.col(value) * share), 6).alias("ema"))


def cosine_to_mean(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    parts = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    return df.join(mean, group).select(key, F.round(cosine(F.col(vector), F.col("mean")), 5).alias("score"))
