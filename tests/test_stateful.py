"""Stateful streams against the batch queries and their SQL, and a queue that is stopped and started again."""

import time
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.catalogue import QUERIES
from quern.operators import stats
from quern.plans.reviews import _STT_TURNS
from quern.sources.views import view
from quern.streaming import pipelines, replay, stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    stateful.state_store(spark)
    yield
    spark.conf.set(name, before)


def fed(spark, rows, folder, order, files=6):
    """Rows written one file after the other by `order`, as a stream that reads one file a batch."""
    pdf = rows.toPandas()
    pdf = pdf.iloc[pdf[order].argsort(kind="stable")] if isinstance(order, str) else pdf.iloc[order(pdf)]
    size = -(-len(pdf) // files)
    for i in range(0, len(pdf), size):
        spark.createDataFrame(pdf.iloc[i : i + size].astype(object).where(lambda d: d.notna(), None), rows.schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)  # files are read by time
    return pipelines.source(spark, folder, rows.schema, 1)


def drained(spark, rows, name, mode="append"):
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def shuffled(by, within):
    """An order of arrival in which rows are up to `within` late."""

    def order(pdf):
        jitter = pd.Series(range(len(pdf)), index=pdf.index) * 7919 % 101 / 101 * within
        return (pdf[by] - jitter).argsort(kind="stable").to_numpy()

    return order


def test_turns_close_by_every_rule(spark, tmp_path):
    rows = view(spark, SF, "speech_events").select("session", "event_id", (F.col("at_us") + 10**12).alias("at_us"), "kind", "transcript", "speech_final")
    ends = rows.groupBy("session").agg((F.max("event_id") + 10_000_000).alias("event_id"), (F.max("at_us") + 40_000_000).alias("at_us"))
    ends = ends.select("session", "event_id", "at_us", F.lit("EndOfTurn").alias("kind"), F.lit("bye").alias("transcript"), F.lit(False).alias("speech_final"))
    last = spark.createDataFrame([(-1, -1, 10**15, "Update", "", False)], rows.schema)
    all_ = rows.unionByName(ends).unionByName(last)
    stream = fed(spark, all_, f"file://{tmp_path}/in", shuffled("at_us", 50e6)).withColumn("at", F.timestamp_micros("at_us"))
    got = drained(spark, stateful.assembled_turns(stream, "60 seconds"), "turns_by_rule")
    found = Counter(tuple(r[c] for c in ("session", "turn", "n", "transcript", "closed_by")) for r in got.collect())
    con = duckdb.connect()
    speech_events = all_.toPandas()  # noqa: F841  (read by the SQL)
    wanted = con.sql(_STT_TURNS)
    names = wanted.columns
    want = Counter(tuple(dict(zip(names, r))[c] for c in ("session", "turn", "n", "transcript", "closed_by")) for r in wanted.fetchall() if dict(zip(names, r))["session"] >= 0)
    assert found == want and {k[4] for k in want} == {"mark", "silence", "final", "idle error"}
    batch = stats.assembled_turns(all_.withColumn("at", F.timestamp_micros("at_us"))).filter("session >= 0")
    assert Counter(tuple(r[c] for c in ("session", "turn", "n", "transcript", "closed_by")) for r in batch.collect()) == want


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


def with_time(stream):
    return stream.withColumn("at", F.timestamp_micros("at_us"))


def closed(spark, events):
    """The events and one, of another user, far behind them: the watermark passes all others."""
    end = events.agg((F.max("at_us") + 10**15).alias("at_us")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit("end").alias("event_type"), "at_us")
    return events.unionByName(end)


def test_changes(spark, events, tmp_path):
    stream = fed(spark, closed(spark, events), f"file://{tmp_path}/in", shuffled("at_us", 3e9))
    got = drained(spark, stateful.changes(with_time(stream), "user_id", "event_type", "2 hours"), "changes_seen")
    want = QUERIES["ev_state_changes"](spark, SF).collect()
    assert Counter((r["user_id"], r["event_id"], r["value"], r["before"]) for r in got.collect()) == Counter((r["user_id"], r["event_id"], r["event_type"], r["before"]) for r in want)


def test_changes_forget(spark, tmp_path):
    rows = [(1, 7, "on", 0), (2, 7, "on", 10), (3, 7, "on", 100), (4, 7, "off", 101), (5, 8, "on", 5000)]
    df = spark.createDataFrame([(i, u, k, (s + 1000) * 1_000_000) for i, u, k, s in rows], "event_id long, user_id long, event_type string, at_us long")
    stream = with_time(fed(spark, df, f"file://{tmp_path}/in", "at_us", 3))
    got = drained(spark, stateful.changes(stream, "user_id", "event_type", "0 seconds", expiry="60 seconds"), "changes_forgotten")
    assert [(r["event_id"], r["before"]) for r in got.orderBy("event_id").collect()] == [(1, None), (3, None), (4, "on"), (5, None)]


def test_ring(spark, events, tmp_path):
    many = events.unionByName(events.withColumn("event_id", F.col("event_id") + 1_000_000)).unionByName(events.withColumn("event_id", F.col("event_id") + 2_000_000))
    stream = with_time(fed(spark, many, f"file://{tmp_path}/in", shuffled("at_us", 1e12)))
    stateful.ring_sink(stateful.latest(stream, {"user_id": "long"}, 100, 3), f"file://{tmp_path}/ring", f"file://{tmp_path}/check").awaitTermination(180)
    got = stateful.ring(spark, f"file://{tmp_path}/ring", 100).select("event_id", "user_id").collect()
    want = many.orderBy(F.desc("at_us"), F.desc("event_id")).limit(100).select("event_id", "user_id").collect()
    assert got == want
    whole = with_time(fed(spark, events, f"file://{tmp_path}/in2", "at_us", 2))
    stateful.ring_sink(stateful.latest(whole, {"user_id": "long"}), f"file://{tmp_path}/ring2", f"file://{tmp_path}/check2").awaitTermination(180)
    key = lambda rows: sorted((r["event_id"], r["user_id"]) for r in rows)
    assert key(stateful.ring(spark, f"file://{tmp_path}/ring2").collect()) == key(QUERIES["ev_ring_last_1000"](spark, SF).collect())


def test_counts(spark, events, tmp_path):
    stream = with_time(fed(spark, events, f"file://{tmp_path}/in", shuffled("at_us", 1e12)))
    got = drained(spark, stateful.running_counts(stream, "user_id"), "counts_seen", "update").groupBy("user_id").agg(F.max("n").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, QUERIES["ev_count_by_corr"](spark, SF).select("user_id", "n").collect()))


def test_counts_expire(spark, tmp_path):
    df = spark.createDataFrame([(1, 7, (s + 1000) * 1_000_000) for s in (0, 1, 500, 1000, 1001)], "event_id long, user_id long, at_us long")
    stream = with_time(fed(spark, df, f"file://{tmp_path}/in", "at_us", 5))
    got = drained(spark, stateful.running_counts(stream, "user_id", "0 seconds", expiry="60 seconds"), "counts_expired", "update")
    assert sorted(r["n"] for r in got.collect()) == [1, 1, 1, 2, 2]


def test_chains(spark, events, tmp_path):
    stream = with_time(fed(spark, closed(spark, events), f"file://{tmp_path}/in", "at_us", 2))
    got = drained(spark, stateful.chains(stream, "user_id", "event_type", ["signup", "view", "purchase", "error"], "10000 days", "0 seconds"), "chains_in_order")
    assert sorted(r["user_id"] for r in got.filter("complete").collect()) == sorted(r["user_id"] for r in QUERIES["ev_chain_complete"](spark, SF).collect())
    rows = [(1, 7, "a", 0), (2, 7, "b", 3), (3, 8, "a", 0), (4, 8, "b", 9), (5, 9, "a", 1), (6, 9, "a", 4), (7, 9, "b", 8), (8, 0, "x", 100)]
    df = spark.createDataFrame([(i, u, k, (s + 1000) * 1_000_000) for i, u, k, s in rows], "event_id long, user_id long, event_type string, at_us long")
    got = drained(spark, stateful.chains(with_time(fed(spark, df, f"file://{tmp_path}/in2", "at_us", 1)), "user_id", "event_type", "ab"), "chains_given_up")
    # 8's second event comes too late and begins a chain of its own, which is given up too
    assert Counter((r["user_id"], r["complete"]) for r in got.collect()) == Counter({(7, True): 1, (8, False): 2, (9, True): 1})


# The queue -----------------------------------------------------------------------------


def waited(done, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if done():
            return True
        time.sleep(0.3)
    return False


def put(spark, folder, rows):
    spark.createDataFrame(rows, "id long, entity_uuid string, entity_type string, text string").coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder):
    try:
        return spark.read.parquet(folder).collect()
    except Exception:  # nothing has been written yet
        return []


def test_queue_retries_restarts_and_falls_back(spark, tmp_path):
    folder, out = f"file://{tmp_path}/tasks", f"file://{tmp_path}/out"
    switch = tmp_path / "open"

    def one(text):
        import os

        if text.startswith("never") or text.startswith("later") and not os.path.exists(switch):
            raise ValueError(text)
        return [float(len(text))]

    def run(texts):
        return [one(t) for t in texts]  # one bad text fails its whole batch

    def start():
        schema = spark.read.parquet(folder).schema
        tasks = stateful.queue(pipelines.source(spark, folder, schema, 1), one, run, lanes=2, size=4, every_ms=300, delay_ms=300, most_retries=3 if switch.exists() else 1000)
        return tasks.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/check").trigger(processingTime="200 milliseconds").start()

    first = [(i, f"u{i}", "note", f"text {i}") for i in range(9)]
    put(spark, folder, [*first, (20, "u3", "note", "again"), (21, "blank", "note", "  "), (22, "none", "note", None), (23, "l1", "note", "later 1"), (24, "l2", "note", "later 2")])
    q = start()
    assert waited(lambda: len(read(spark, out)) == 9), q.exception()
    put(spark, folder, [(31, "l1", "note", "waits already"), (32, "late", "note", "more")])
    assert waited(lambda: len(read(spark, out)) == 10), q.exception()
    q.stop()  # cuts short whatever batch is being worked off
    assert {r["entity_uuid"] for r in read(spark, out)} == {"late", *(f"u{i}" for i in range(9))}
    switch.write_text("")
    put(spark, folder, [(30, "n1", "note", "never")])
    q = start()
    assert waited(lambda: len(read(spark, out)) == 13), q.exception()
    time.sleep(1)
    q.stop()
    rows = {r["entity_uuid"]: r for r in read(spark, out)}
    assert len(read(spark, out)) == len(rows) == 13  # nothing is lost or doubled
    assert rows["n1"]["status"] == "failed" and rows["n1"]["retry_count"] == 3 and "never" in rows["n1"]["error"]
    assert rows["l1"]["status"] == "completed" and rows["l1"]["retry_count"] > 0 and rows["l1"]["vector"] == [7.0]
    assert all(rows[f"u{i}"]["status"] == "completed" and rows[f"u{i}"]["retry_count"] == 0 for i in range(9)) and rows["u3"]["vector"] == [6.0]


def test_queue_delays(spark):
    class Handle:
        timers = []

        def registerTimer(self, at):
            self.timers.append(at)

        def getListState(self, name, schema):
            return State()

    class State(list):
        exists = lambda self: bool(self)
        get = lambda self: iter(list(self))

        def put(self, rows):
            self[:] = rows

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentProcessingTimeInMs(self):
            return self.at

    calls = []

    def one(text):
        calls.append(text)
        raise ValueError("no")

    p = stateful.Queue(stateful._each(one), one, 10, 2000, 2000, 3)
    p.init(Handle())
    frame = pd.DataFrame([(i, f"u{i}", "t", "x") for i in range(9)], columns=["id", "entity_uuid", "entity_type", "text"])
    assert list(p.handleInputRows((0,), iter([frame]), Now(0))) == [] and calls == [] and Handle.timers == [2000]  # too few
    list(p.handleInputRows((0,), iter([frame.assign(entity_uuid="u10")]), Now(100)))
    assert len(calls) == 11 and {t[4] for t in p.tasks} == {2100}  # ten wait: the batch fails with the first, then each
    assert list(p.handleExpiredTimer((0,), Now(2000), None)) == [] and len(calls) == 11
    list(p.handleExpiredTimer((0,), Now(2100), None))
    assert {t[4] for t in p.tasks} == {2100 + 4000} and {t[3] for t in p.tasks} == {2}
    (out,) = p.handleExpiredTimer((0,), Now(6100), None)
    assert len(out) == 10 and set(out["status"]) == {"failed"} and set(out["retry_count"]) == {3} and not p.tasks


def _odd_fails(text):
    if len(text) % 2:
        raise ValueError(text)
    return [float(len(text))]


def test_queue_flushes_all(spark):
    rows = [(i, f"u{i}", "note", "x" * (i + 1)) for i in range(25)]
    slices = [spark.createDataFrame(part, "id long, entity_uuid string, entity_type string, text string") for part in (rows[:13], [*rows[13:], (99, "none", None, None)])]
    got = replay.appended(slices, lambda s: stateful.queue(s, _odd_fails, lanes=2, flush=True)).collect()
    assert {r["entity_uuid"]: (r["status"], r["retry_count"]) for r in got} == {f"u{i}": ("completed", 0) if i % 2 else ("failed", 3) for i in range(25)} and len(got) == 25


def test_replay_goes_on_and_restores_the_setting(spark, events):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.example.Other")
    with replay.stateful_queries(spark):
        assert spark.conf.get(name) == before  # the module's tests use the same one
        seen = replay.updated(replay.halves(events, "at_us"), lambda s: stateful.running_counts(with_time(s), "user_id"))
    assert spark.conf.get(name) == "org.example.Other"
    spark.conf.set(name, before)
    assert seen.groupBy("user_id").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == events.count()
    halves = replay.halves(events.withColumn("at_us", F.when(F.col("event_id") > 2, F.col("at_us"))), "at_us")
    assert halves[0].count() + halves[1].count() == events.count()
    with pytest.raises(Exception, match="nowhere"):
        replay.appended([events], lambda s: s.withColumn("x", F.raise_error(F.lit("nowhere"))))


def test_queue_flush_of_nothing(spark):
    nothing = spark.createDataFrame([], "id long, entity_uuid string, entity_type string, text string")
    assert replay.appended([nothing], lambda s: stateful.queue(s, _odd_fails, flush=True)).count() == 0


# Subscribers ---------------------------------------------------------------------------


def test_subscribers_are_independent(spark, tmp_path):
    folder, log = f"file://{tmp_path}/in", f"file://{tmp_path}/log"
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.filter("event_id < 300").coalesce(1).write.parquet(folder)
    through = lambda: pipelines.write_through(pipelines.source(spark, folder, events.schema), log, f"file://{tmp_path}/c", {}).awaitTermination(120)
    through()
    seen = {"all": [], "errors": [], "late": []}

    def into(name):
        return lambda df, n: seen[name].extend(r["event_id"] for r in df.collect())

    def broken(df, n):
        raise RuntimeError("this subscriber is broken")

    args = lambda name: (spark, log, events.schema, f"file://{tmp_path}/{name}")
    bad = stateful.subscribe(*args("bad"), broken)
    stateful.subscribe(*args("all"), into("all")).awaitTermination(120)
    stateful.subscribe(*args("errors"), into("errors"), "error").awaitTermination(120)
    with pytest.raises(Exception, match="broken"):
        bad.awaitTermination(120)
    events.filter("event_id >= 300").coalesce(1).write.mode("append").parquet(folder)
    through()
    for _ in range(2):
        stateful.subscribe(*args("all"), into("all")).awaitTermination(120)
    stateful.subscribe(*args("late"), into("late"), since=F.col("event_id") >= 300).awaitTermination(120)
    bad = []
    stateful.subscribe(*args("bad"), lambda df, n: bad.append(df.count())).awaitTermination(120)
    ids = sorted(r["event_id"] for r in events.collect())
    assert sorted(seen["all"]) == ids and sorted(seen["late"]) == [i for i in ids if i >= 300] and sum(bad) == len(ids)
    assert sorted(seen["errors"]) == sorted(r["event_id"] for r in events.filter("event_id < 300 AND event_type = 'error'").collect())


def test_waiting_rows_are_packed():
    """2,500 rows of a key wait as three values of the state store, and come out in order."""

    class Kept(list):
        get = lambda self: iter(list(self))
        appendList = list.extend

        def put(self, rows):
            self[:] = rows

    class One(Kept):
        get = lambda self: self[0] if self else None

        def update(self, value):
            self[:] = [value]

    class Handle:
        timers = []
        registerTimer = timers.append

        def getListState(self, name, schema):
            return Kept()

        def getValueState(self, name, schema):
            return One()

    class Now:
        def getCurrentWatermarkInMs(self):
            return 2_000

    p = stateful.Changes(None)
    p.key = "user_id"
    p.init(Handle())
    rows = [Row(user_id=7, at_us=(i * 7919 % 2_500 + 1) * 1000, event_id=i, value=None if i % 5 == 0 else "ab"[i % 2]) for i in range(2_500)]
    assert list(p.handleInputRows((7,), iter(rows), None)) == [] and len(p.waiting) == 3 and Handle.timers == [1]
    out = list(p.handleExpiredTimer((7,), Now(), None))
    ready = sorted((r for r in rows if r.at_us <= 2_000_000), key=lambda r: r.at_us)
    want = [(r.event_id, r.value, b.value if b else None) for b, r in zip([None, *ready], ready) if (b.value if b else None) != r.value]
    assert [tuple(r)[1:] for r in out] == want and len(p.waiting) == 1 and p.state.get() == (ready[-1].value, 2_000_000) and Handle.timers[1:] == [2001]
