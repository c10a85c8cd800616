"""Sinks: reports, JSON lines, flat tables, change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame, glue: str = "; ") -> DataFrame:
    """Every column as text: arrays joined, structs as JSON, null as empty."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), glue)
        elif isinstance(f.dataType, T.StructType | T.MapType):
            c = F.to_json(c)
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def write_report(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str, batch: str) -> None:
    """Append changes under their batch; a batch written again replaces itself, so a retry adds nothing."""
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)


def long_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*").where("value is not null")
