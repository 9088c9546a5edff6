"""Blobs, hooks, errors, tools, services, chunks, queues and streams: what has no SQL."""

import time

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern import errors, tools
from quern.functions import texts, times, vectors
from quern.functions.embedder import embed
from quern.operators import chunks, learning, search, stats
from quern.sources.store import BlobStore, EntityStore, marked_synced, merged
from quern.streaming import pipelines


@pytest.fixture
def store(spark, tmp_path):
    return EntityStore(spark, f"file://{tmp_path}/store")


def test_blobs(spark, store):
    blobs = BlobStore(store)
    ids = spark.createDataFrame([("a",), ("b",), ("z",)], "uuid string")
    assert {r["size"] for r in blobs.sizes(ids).collect()} == {-1} and blobs.delete(ids) == 0
    blobs.save(spark.createDataFrame([("a", bytearray(range(10))), ("b", bytearray())], "uuid string, content binary"))
    blobs.save(spark.createDataFrame([("a", bytearray(b"0123456789abc"))], "uuid string, content binary"))
    assert {r["uuid"]: (r["present"], r["size"]) for r in blobs.sizes(ids).collect()} == {"a": (True, 13), "b": (True, 0), "z": (False, -1)}
    parts = sorted((r["position"], bytes(r["slice"])) for r in blobs.slices(ids, 5).collect())
    assert parts == [(0, b"01234"), (1, b"56789"), (2, b"abc")]
    assert blobs.delete(ids) == 2 and blobs.load(ids).count() == 0


def test_delete_has_hooks(spark, store):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "uuid string, n long")
    store.save("things", rows)
    seen = []
    hook = lambda name: lambda gone: seen.append((name, sorted(r["uuid"] for r in gone.collect())))
    one = spark.createDataFrame([("a",), ("q",)], "uuid string")
    assert store.delete("things", one, before=[hook("before")], after=[hook("after")]) == 1
    assert seen == [("before", ["a"]), ("after", ["a"])]
    assert store.delete("things", one, before=[hook("never")]) == 0 and len(seen) == 2

    def refuse(gone):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        store.delete("things", rows, before=[refuse])
    assert store.count("things") == 1 and store.clear("things") == 1 and store.count("things") == 0 and store.tables() == ["things"]


def test_handlers_run_in_their_order(spark, store):
    seen = []
    given = {h: (lambda df, h=h: seen.append(h)) for h in ("cascade", "version", "embed", "index")}
    store.save("things", spark.createDataFrame([("a",)], "uuid string"), after=[lambda df: seen.append("own")], handlers=given)
    assert seen == ["own", "index", "embed", "version", "cascade"]
    with pytest.raises(ValueError):
        store.save("things", spark.createDataFrame([("a",)], "uuid string"), handlers={"other": print})


def test_upsert_keeps_keys_unique(spark, store):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 1, "x"), ("b", 1, "y")], "uuid string, updated_at long, name string")
    got = {r["uuid"]: r["name"] for r in merged(rows.limit(0), rows).collect()}
    assert got == {"a": "new", "b": "y"}
    store.save("things", rows)
    store.save("things", rows)
    assert store.count("things") == 2 and merged(store.read("things"), rows).count() == 2


def test_mark_synced(spark, store):
    rows = spark.createDataFrame([("a", None, "local"), ("b", "s1", "local"), ("c", None, "local")], "uuid string, sync_id string, sync_status string")
    done = spark.createDataFrame([("a", "r1"), ("a", "r1"), ("b", None), ("z", "r9")], "uuid string, sync_id string")
    want = {("a", "r1", "synced"), ("b", "s1", "synced"), ("c", None, "local")}
    assert {tuple(r) for r in marked_synced(rows, done).collect()} == want
    store.save("things", rows)
    store.mark_synced("things", done)
    assert {tuple(r) for r in store.read("things").select("uuid", "sync_id", "sync_status").collect()} == want


def test_errors_are_translated(spark, store):
    with pytest.raises(errors.TransactionFailed):
        store.commit({"bad": spark.range(1).select(F.raise_error(F.lit("broken")).cast("string").alias("uuid"))})
    for raised, kind in ((OSError("No space left on device"), errors.StorageLimit), (AnalysisException("no such column"), errors.QueryFailed), (OSError("FileNotFoundException: x"), errors.EntityNotFound), (ValueError("?"), errors.PersistenceError), (errors.DuplicateEntity("d"), errors.DuplicateEntity)):
        with pytest.raises(kind) as found:
            with errors.translating("things"):
                raise raised
        assert type(found.value) is kind
    spark.conf.set("spark.sql.ansi.enabled", "true")
    with pytest.raises(errors.QueryFailed):
        with errors.translating("things"):
            spark.sql("SELECT CAST(9999999999 AS INT)").collect()


def test_task_tools(spark, store):
    registry = tools.ToolRegistry()
    tools.register_tasks(registry, store, times.moment("2024-01-20 12:00:00"))
    assert [t.name for t in registry.of("task")] == ["task.complete", "task.create", "task.list"]
    made = registry.tools["task.create"].run(spark, {"title": "one", "dueDate": "2024-01-19T10:00:00.000Z"}).first()
    assert (made["title"], made["priority"], str(made["due_date"]), made["completed"]) == ("one", "medium", "2024-01-19 10:00:00", False)
    registry.tools["task.create"].run(spark, {"title": "two", "priority": "high"})
    count = lambda f: registry.tools["task.list"].run(spark, {"filter": f}).count()
    assert [count(f) for f in ("all", "overdue", "high_priority", "completed", "strange")] == [2, 1, 1, 0, 2]
    assert registry.tools["task.complete"].run(spark, {"taskId": made["uuid"]}).first()["completed"]
    assert [count(f) for f in ("overdue", "completed", "incomplete")] == [0, 1, 1]
    rows = registry.execute(spark, [("task.create", {}), ("task.create", {"title": ""}), ("task.complete", {"taskId": "?"}), ("task.list", {})]).collect()
    assert [r["success"] for r in rows] == [False, False, False, True] and rows[3]["rows"] == 2


def test_services_and_servers(spark):
    services = tools.Services()
    services.register("embedding", "local", "L")
    services.register("embedding", "remote", "R")
    assert services.get("embedding") == "L"
    services.switch("embedding", "remote")
    assert services.get("embedding") == "R"
    for call in (lambda: services.switch("embedding", "?"), lambda: services.get("?")):
        with pytest.raises(KeyError):
            call()
    a, b = tools.ToolRegistry(), tools.ToolRegistry()
    a.register(tools.Tool("x.one", lambda s, g: s.range(3)))
    b.register(tools.Tool("y.two", lambda s, g: s.range(4)))
    servers = tools.Servers()
    servers.mount("x", a)
    servers.mount("y", b)
    assert servers.route("y.two") is b
    with pytest.raises(KeyError):
        servers.route("z.one")
    assert [(r["success"], r["rows"]) for r in servers.execute(spark, [("x.one", {}), ("y.two", {}), ("z.one", {})]).collect()] == [(True, 3), (True, 4), (False, None)]


def test_chunks_of_windows(spark):
    words = [f"w{i}" for i in range(500)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None)], "id long, text string")
    config = chunks.ChunkConfig("parent", 200, 50, 128, 400, segments="windows")
    got = [(r["start_token"], r["end_token"], r["text"].split()) for r in chunks.chunked(rows, config).orderBy("ordinal").collect()]
    windows = [words[i : i + 200] for i in range(0, 500, 150)]
    assert [w for *_, t in got for w in t] == [w for x in windows for w in x]  # windows share tokens, and so do chunks
    assert all(b - a == len(t) <= 400 for a, b, t in got)
    whole = chunks.chunked(rows, chunks.PARENT).orderBy("ordinal").collect()  # one sentence without an end is cut
    assert [(r["start_token"], r["end_token"]) for r in whole] == [(0, 400), (400, 500)]
    with pytest.raises(ValueError):
        chunks.ChunkConfig("x", 200, 50, 128, 400, segments="letters")


def test_unstructured_texts_take_windows(spark, monkeypatch):
    monkeypatch.setattr(chunks.texts, "unstructured", lambda text: F.contains(text, F.lit("spoken")))
    rows = spark.createDataFrame([(1, "spoken " * 300), (2, "A sentence. Another one.")], "id long, text string")
    got = chunks.chunked(rows, chunks.PARENT).groupBy("id").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("n")).collect()
    assert {r["id"]: r["n"] for r in got} == {1: 200 + 150, 2: 4}


def test_index_faults(spark):
    rows = spark.createDataFrame([(i, f"A sentence of text {i}. And one more.") for i in range(4)] + [(9, " ")], "id long, text string")
    index = chunks.two_levels(rows)
    assert chunks.faults(index, rows).count() == 0
    other = rows.filter("id <> 2").unionByName(spark.createDataFrame([(7, "New text.")], "id long, text string"))
    assert {tuple(r) for r in chunks.faults(index.filter("id <> 3"), other).collect()} == {(2, "orphan"), (3, "missing"), (7, "missing")}
    assert chunks.reindexed(index, rows.filter("id = 1")).count() == index.count()


def test_search_by_text_and_rebuild(spark):
    rows = spark.createDataFrame([(1, "red apple", None), (2, "blue sky", None), (3, "", [1.0] * 384)], "item_id long, text string, embedding array<double>")
    built = search.rebuilt(rows)
    got = {r["item_id"]: r["embedding"] for r in built.collect()}
    assert np.allclose(got[1], embed("red apple")) and got[3] == [1.0] * 384
    hits, vector = search.search_text(built.withColumnRenamed("embedding", "vector"), "blue sky", 1)
    assert hits.first()["item_id"] == 2 and np.allclose(vector, embed("blue sky"))


def test_nothing_to_select_from(spark):
    df = spark.createDataFrame([([],)], "names array<string>")
    with pytest.raises(Exception, match="nothing to choose"):
        df.select(learning.selection(F.col("names"))).collect()
    with pytest.raises(Exception, match="0..1"):
        spark.range(1).select(vectors.similarity(F.lit(1.5))).collect()
    assert spark.range(1).select(vectors.similarity(F.lit(1.5), strict=False).alias("s")).first()["s"] == 0.0


def test_retry_presets(spark):
    got = {n: spark.range(1).select(times.retry_schedule(n).alias("s")).first()["s"] for n in times.RETRIES}
    assert got["quick"] == [1.0, 2.0] and got["standard"] == [2.0, 4.0] and got["slow"] == [5.0, 10.0, 20.0, 40.0] and sum(got["critical"]) == 511


def test_queue_batches_and_fallback(spark):
    rows = [(i, f"e{i % 30}", "t", "" if i == 5 else f"text {i}", "pending" if i < 40 else "failed", i % 3, None, None, None) for i in range(50)]
    tasks = spark.createDataFrame(rows, "id long, entity_uuid string, entity_type string, text string, status string, retry_count int, enqueued_at timestamp, last_attempt_at timestamp, last_error string")
    assert [r["id"] for r in pipelines.next_batch(tasks, 4).orderBy("id").collect()] == [0, 1, 2, 3]

    def fails(batch):
        return batch.select(F.raise_error(F.lit("down")).cast("string").alias("entity_uuid"))

    with pytest.raises(Exception):
        pipelines.flushed(tasks, fails).collect()
    out = pipelines.flushed(tasks, fails, one=lambda batch: batch.filter("id % 2 = 0"))
    got = {r["id"]: (r["status"], r["retry_count"]) for r in out.collect()}
    assert got[0] == ("completed", 0) and got[5] == ("completed", 2) and got[1] == ("pending", 2) and got[11] == ("failed", 3) and len(got) == 40


def test_streams_of_positions_and_audio(spark, tmp_path):
    query = pipelines.locations(spark, 50).writeStream.format("memory").queryName("positions").start()
    try:
        for _ in range(60):
            if spark.table("positions").count():
                break
            time.sleep(0.5)
        row = spark.table("positions").first()
        assert 48 < row["lat"] < 48.2 and 11.4 < row["lon"] < 11.6
    finally:
        query.stop()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(bytes(range(256)) * 30)
    query = pipelines.audio_chunks(spark, f"file://{tmp_path}/in").writeStream.format("memory").queryName("audio").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {r["position"]: len(r["slice"]) for r in spark.table("audio").collect()}
    assert got == {0: 3200, 1: 3200, 2: 1280}


def test_ancestors_stop_at_missing_parents(spark):
    events = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 99)], "event_id long, parent_event_id long")
    got = {r["event_id"]: (r["root"], r["depth"]) for r in stats.ancestors(events, 3).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (2, 3), 6: (6, 0)}


def test_media_text(spark):
    df = spark.createDataFrame([(" t ", None, "u"), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(texts.media_text(df["a"], df["b"], df["c"])).collect()] == ["t \n\nu", ""]
