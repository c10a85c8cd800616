from pyspark.sql import functions as F

from quire.streaming import events


def key(rows):
    return sorted(map(str, rows))


def test_stream_equals_batch(spark, small, tmp_path):
    src = f"{tmp_path}/src"
    spark.read.parquet(f"{small}/file_events.parquet").orderBy("arrived_at").repartition(6).write.parquet(src)
    late = "400 days"
    got = events.run_once(events.unique_events(events.stream_of(spark, src), late=late).select("event_id"), f"{tmp_path}/u")
    want = spark.read.parquet(src).select("event_id").distinct()
    assert key(r["event_id"] for r in got.collect()) == key(r["event_id"] for r in want.collect())


def test_latest_rows(spark, tmp_path):
    src = f"{tmp_path}/src"
    d = spark.createDataFrame([(f"f{i % 7}", i) for i in range(50)], "k string, t long")
    d.repartition(5).write.parquet(src)
    events.upsert_each(events.stream_of(spark, src, 1), f"{tmp_path}/s", f"{tmp_path}/target", "k", "t")
    last = max(int(p.name[2:]) for p in (tmp_path / "target").iterdir())
    got = spark.read.parquet(f"{tmp_path}/target/v={last}")
    assert {tuple(r) for r in got.select("k", "t").collect()} == {tuple(r) for r in d.groupBy("k").agg(F.max("t")).collect()}


def test_quiet_time(spark):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:10"), ("b", None)]
    d = spark.createDataFrame(rows, "file_path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r["file_path"], r["events"]) for r in events.settled(d).collect()}
    assert got == {("a", 2), ("a", 1)}
