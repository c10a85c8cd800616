"""Streams of file events, each with the batch SQL that must give the same (ST of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming import events
from .registry import Plans

plan = Plans()


@plan("""with e as (select distinct event_id, file_path, ts from file_events), g as (select *, case when ts - lag(ts) over w <= interval 2 hour then 0 else 1 end new from e window w as (partition by file_path order by ts, event_id)),
  s as (select *, sum(new) over (partition by file_path order by ts, event_id) k from g) select file_path, min(ts) as began, count(*) as events from s group by file_path, k""")
def st01_settled_files(s: SparkSession, d: str) -> DataFrame:
    """Bursts of one file's events, two hours of quiet apart."""
    e = table(s, d, "file_events").select("event_id", "file_path", "ts").distinct()
    return events.settled(e, quiet="2 hours 1 microsecond").select("file_path", F.col("began").cast("timestamp_ntz").alias("began"), "events")


@plan("select event_id, file_path, event_kind from (select distinct event_id, file_path, event_kind from file_events)")
def st03_unique_events(s: SparkSession, d: str) -> DataFrame:
    return events.unique_events(table(s, d, "file_events")).select("event_id", "file_path", "event_kind")


@plan("select date_trunc('day', ts)::timestamp as day, event_kind, count(*) as n, round(avg(file_size), 4) as mean_size from file_events group by 1, 2")
def st04_running_counts(s: SparkSession, d: str) -> DataFrame:
    r = events.running_counts(table(s, d, "file_events"))
    return r.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_kind", "n", F.round("mean_size", 4).alias("mean_size"))


@plan("select date_trunc('day', ts)::timestamp as day, count(*) as late from file_events where arrived_at - ts > interval 1 day group by 1")
def st05_late_events(s: SparkSession, d: str) -> DataFrame:
    late = F.unix_micros(F.col("arrived_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > 86_400_000_000
    return table(s, d, "file_events").where(late).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("late"))


@plan("select event_kind, count(*) as n from (select event_kind, file_size from file_events) where file_size is null group by 1")
def st06_failed_sizes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "file_events").where("file_size is null").groupBy("event_kind").agg(F.count("*").alias("n"))


QUERIES, SQL = plan.queries, plan.sql
