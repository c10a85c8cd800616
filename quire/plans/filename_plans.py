"""Names of files, segments, intervals, and operators whose order decides (N13, X, W01, J14, ST06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filenames as fn
from ..functions import text as tx
from ..operators import greedy
from ..session import table
from .registry import Plans

plan = Plans()


@plan(None)
def n13_spaced_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").select("id", fn.spaced_name(tx.sub("file_path", "^.*/")).alias("form"))


@plan(None)
def x02_sentence_case(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select("id", "title", fn.sentence_case("title").alias("form"))
    return p.select("id", "form", (~F.col("title").eqNullSafe(F.col("form"))).alias("changed"))


@plan(None)
def x03_segments(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "papers").select("id", F.explode(fn.segments("title")).alias("x")).select("id", "x.kind")
    return t.groupBy("id", "kind").agg(F.count("*").alias("n"))


@plan("with o as (select *, max(stop) over (partition by user_id order by start, stop rows between unbounded preceding and 1 preceding) before from (select user_id, epoch_us(ts) start, epoch_us(ts) + 3600000000 stop from events)), r as (select *, sum(case when before >= start then 0 else 1 end) over (partition by user_id order by start, stop rows unbounded preceding) run from o) select user_id, min(start) as start, max(stop) as stop from r group by user_id, run")
def x05_merged_intervals(s: SparkSession, d: str) -> DataFrame:
    """Hours after each event, joined where they touch."""
    e = table(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    return fn.merged_intervals(e.withColumn("stop", F.col("start") + 3_600_000_000), "user_id", "start", "stop")


@plan(None)
def x10_canonical_names(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").where("title is not null").select("id", "title", F.coalesce(tx.author_list("authors"), F.array().cast("array<string>")).alias("a"))
    return p.select("id", fn.canonical_name(F.col("a"), "title", 120).alias("name"))


@plan(None)
def w01_lines(s: SparkSession, d: str) -> DataFrame:
    """Words laid out on pages (here the order lines as words) put back into lines."""
    w = table(s, d, "lineitem").select((F.col("l_orderkey") % 500).alias("page"), (F.col("l_orderkey") % 97).cast("double").alias("y"), F.col("l_linenumber").cast("double").alias("x"), F.col("l_returnflag").alias("text"), F.col("l_tax").cast("double").alias("size"))
    return greedy.lines_of_words(w, "page")


@plan(None)
def j14_first_wins(s: SparkSession, d: str) -> DataFrame:
    return greedy.first_wins(table(s, d, "papers").select("id", F.lower("title").alias("t")), "id", "t").select("id")


@plan("select file_path, count(*) as attempts, case when arg_max(event_kind, struct_pack(a := ts, b := event_id)) = 'created' then 'done' when count(*) >= 3 then 'failed' else 'waiting' end as state, case when arg_max(event_kind, struct_pack(a := ts, b := event_id)) <> 'created' and count(*) < 3 then cast(power(2, count(*)) as bigint) end as wait from file_events group by 1")
def st06_replayed_tasks(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "file_events").select("file_path", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_kind") == "created", "ok").otherwise("no").alias("outcome"))
    return greedy.replay(e, "file_path", "at", "outcome")


QUERIES, SQL = plan.queries, plan.sql
