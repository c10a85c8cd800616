"""Duplicates and versions (A01-A04, A22, W06 of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with the same words: first id, size and wasted characters."""
    key = F.md5(F.lower(F.trim(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "))))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", key.alias("k"))
    g = d.groupBy("k").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"), F.sum("n_chars").alias("chars"), F.min_by("n_chars", "doc_id").alias("first_chars"))
    return g.where("copies > 1").select("keep_id", "copies", (F.col("chars") - F.col("first_chars")).alias("wasted_chars"))


QUERIES = {"exact_duplicates": exact_duplicates}
SQL = {
    "exact_duplicates": """
select min(doc_id) keep_id, count(*) copies, cast(sum(n_chars) - arg_min(n_chars, doc_id) as bigint) wasted_chars
from (select *, md5(lower(trim(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')))) k from documents) group by k having count(*) > 1"""
}
