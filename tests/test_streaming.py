"""Streams against the same computation on the whole table."""

import pytest
from pyspark.sql import functions as F

from quern.streaming import pipelines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feed")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 100).parquet(f"file://{folder}/in")
    return f"file://{folder}/in", events


def drained(spark, rows, name, mode="append"):
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_write_through(spark, feed, tmp_path):
    folder, events = feed
    seen = []
    stream = pipelines.source(spark, folder, events.schema, 3)
    for _ in range(2):  # a second run finds nothing new
        pipelines.write_through(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/check", {"error": lambda df, n: seen.append(df.count())}).awaitTermination(120)
    log = spark.read.parquet(f"file://{tmp_path}/log")
    assert log.count() == events.count() and sum(seen) == events.filter("event_type = 'error'").count()
    assert pipelines.ring(log, 10).count() == 10


def test_windowed_counts(spark, feed):
    folder, events = feed
    got = drained(spark, pipelines.windowed_counts(pipelines.source(spark, folder, events.schema, 100), "1 day"), "per_day", "complete")
    want = events.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("start"), "event_type").agg(F.count("*").alias("n"))
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(got) == key(want)


def test_turns(spark, feed):
    folder, events = feed
    got = drained(spark, pipelines.turns(pipelines.source(spark, folder, events.schema, 100), "6 hours"), "turns_seen")
    assert 0 < got.agg(F.sum("n")).first()[0] <= events.count() and got.filter("end <= start").count() == 0


def test_chains(spark, feed):
    folder, events = feed
    part = pipelines.source(spark, folder, events.schema, 100)
    got = drained(spark, pipelines.chains(part, ["view", "click", "purchase"], "100 days"), "chains_seen").filter("complete")
    want = events.groupBy("user_id").agg(F.collect_set("event_type").alias("s")).filter("array_contains(s, 'view') AND array_contains(s, 'click') AND array_contains(s, 'purchase')")
    assert {r["correlation"] for r in got.collect()} == {r["user_id"] for r in want.collect()}


def test_queue(spark):
    rows = [(1, "a", "t", "x", "pending", 0), (2, "a", "t", "x", "pending", 0), (3, "b", "t", " ", "pending", 0), (4, "c", "t", "y", "pending", 2), (5, "d", "t", "z", "pending", 0), (6, "e", "t", "z", "completed", 0)]
    tasks = spark.createDataFrame(rows, "id long, entity_uuid string, entity_type string, text string, status string, retry_count int")
    out = {r["id"]: (r["status"], r["retry_count"]) for r in pipelines.flushed(tasks, lambda df: df.filter("entity_uuid = 'a'")).collect()}
    assert out == {1: ("completed", 0), 3: ("completed", 0), 4: ("failed", 3), 5: ("pending", 1), 6: ("completed", 0)}
