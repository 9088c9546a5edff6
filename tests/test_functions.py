"""Functions and operators on hand-made edge cases."""

import json
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.functions import access, embedder, files, patches, places, texts, times, vectors
from quern.operators import chunks, finders, graph, learning, search, versions
from quern.tools import Tool, ToolRegistry


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_vectors(spark):
    row = one(spark, vectors.cosine_similarity(vec(1, 0), vec(1, 0)), vectors.cosine_similarity(vec(1, 0), vec(0, 1)), vectors.cosine_similarity(vec(1, 0), vec(-2, 0)), vectors.cosine_similarity(vec(0, 0), vec(1, 1)), vectors.cosine_distance(vec(0, 0), vec(1, 1)), vectors.euclidean_distance(vec(0, 0), vec(3, 4)))
    assert list(row) == [1.0, 0.0, -1.0, 0.0, 1.0, 5.0]
    with pytest.raises(PySparkException):
        spark.range(1).select(vectors.cosine_similarity(vec(1, 2) if random.random() >= 0 else vec(1), vec(1))).collect()
    assert one(spark, vectors.normalised(vec(3, 4)), vectors.similarity_label(F.lit(-0.5))) == ([0.6, 0.8], "0.0%")


def test_search_ties_and_limits(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in (3, 1, 2)], "item_id long, vector array<float>")
    assert [r["item_id"] for r in search.nearest(items, [2.0, 0.0], k=10).collect()] == [1, 2, 3]
    assert search.nearest(items, [-1.0, 0.0], k=2, least_similarity=0.0).count() == 0
    assert search.nearest(items.limit(0), [1.0, 0.0]).count() == 0


def test_texts(spark):
    text = "Hello world. Foo bar! Baz? (x). 3. End"
    assert one(spark, texts.sentences(F.lit(text)))[0] == ["Hello world. Foo bar!", "Baz?", "(x).", "3. End"]
    assert one(spark, texts.sentences(F.lit("A dog. B cat."), strict_case=True))[0] == ["A dog.", "B cat."]
    assert one(spark, texts.sentences(F.lit("   ")), texts.sentences(F.lit(""))) == ([], [])
    assert one(spark, texts.token_count(F.lit("a  b\tc ")))[0] == 2
    assert one(spark, texts.sliding_windows(F.lit("a b c d e"), 3, 1))[0] == ["a b c", "c d e", "e"]
    assert one(spark, texts.sliding_windows(F.lit(""), 3, 1))[0] == []
    with pytest.raises(ValueError):
        texts.sliding_windows(F.lit("a"), 2, 2)
    assert one(spark, texts.unstructured(F.lit(text)))[0] is False
    got = one(spark, texts.dotted_name(F.lit("a.b")), texts.dotted_name(F.lit("a.b.c")), texts.joined_url(F.lit("http://h/"), F.lit("/p")), texts.composite_key(F.lit("a"), F.lit("b")))
    assert tuple(got[0]) == ("a", "b") and got[1] is None and got[2] == "http://h/p" and got[3] == "a|b"
    assert one(spark, texts.prompt(F.lit("Hi"), F.array(F.lit("x"), F.lit("y")), F.create_map(F.lit("k"), F.lit("v"))))[0] == "Hi\nTools: x, y\nk: v"
    assert one(spark, texts.embedding_text(F.lit("stt"), F.lit('{"transcript": "t"}')), texts.embedding_text(F.lit("tts"), F.lit("{}"))) == ("t", "")


def test_times(spark):
    now, due = times.moment("2024-01-02 00:00:00"), times.moment("2024-01-03 00:30:00")
    null = F.lit(None).cast("timestamp_ntz")
    row = one(spark, times.overdue(due, F.lit(False), now), times.due_before(due, now, 24), times.due_within_hours(due, now, 24), times.due_between(null, now, 24), times.same_day(due, now), times.stale(null, now, 1), times.remaining_seconds(due, now), times.remaining_seconds(now, due), times.backoff_seconds(F.lit(3)))
    assert list(row) == [False, False, True, False, False, True, 88_200, 0, 4.0]


def test_places_and_access(spark):
    row = one(spark, F.round(places.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)), 1), places.within_km(F.lit(None).cast("double"), F.lit(0.0), (0.0, 0.0), 10))
    assert list(row) == [round(places.EARTH_KM * np.pi / 2, 1), False]
    shared = F.array(F.lit(2).cast("long"))
    null = F.lit(None).cast("long")
    row = one(spark, access.accessible_by(F.lit(1), F.lit("private"), shared, 2), access.accessible_by(null, F.lit("private"), shared, 3), access.accessible_by(null, F.lit("public"), shared, 3), access.share(shared, 2), access.unshare(shared, 2))
    assert list(row) == [True, False, True, [2], []]


def test_files(spark):
    row = one(spark, files.extension(F.lit("A.b/X.JPG")), files.extension(F.lit("none")), files.media_type(F.lit("mkv")), files.media_type(F.lit("?")), files.media_class(F.lit("audio/mp4")), files.slices(F.lit(b"abcde"), 2))
    assert list(row) == ["jpg", "", "video/x-matroska", files.DEFAULT_TYPE, "audio", [b"ab", b"cd", b"e"]]
    items = F.array(F.struct(F.lit("image/png").alias("content_type"), F.lit(3).cast("long").alias("size_bytes")), F.struct(F.lit("audio/aac").alias("content_type"), F.lit(4).cast("long").alias("size_bytes")))
    assert one(spark, F.size(files.attachments_of(items, "image")), files.attachments_size(items)) == (1, 7)


def test_embedder(spark):
    assert embedder.fnv1a("abc") == 440_920_331
    assert not embedder.embed("").any() and not embedder.embed(" !!! ").any()
    assert np.allclose(embedder.embed("Hello, World"), embedder.embed("hello world")) and np.isclose(np.linalg.norm(embedder.embed("x")), 1)
    assert np.allclose(embedder.embed("a a"), embedder.embed("a")) and np.allclose(embedder.embed("é"), embedder.embed(""))
    got = spark.createDataFrame([("hi",), (None,)], "t string").select(embedder.embedding(F.col("t")).alias("v")).collect()
    assert np.allclose(got[0]["v"], embedder.embed("hi")) and not any(got[1]["v"])


CASES = [
    ({"name": "John", "age": 30}, {"name": "Jane", "age": 31}), ({}, {}), ({"a": [1, 2, 3, 4]}, {"a": [1, 9]}), ({"a": [1]}, {"a": [1, 2, 3]}), ({"a": None}, {}), ({"a": 1}, {"a": None}),
    ({"a/b": 1, "c~d": 2}, {"a/b": 3}), ({"a": {"b": {"c": 1}}}, {"a": {"b": {"d": [1]}}}), ({"a": 1}, {"a": "1"}), ({"a": [1, {"b": 2}]}, {"a": [{"b": 3}, 1]}), ({"a": 1}, {"a": True}),
]


@pytest.mark.parametrize("old, new", CASES)
def test_patches_turn_old_into_new(old, new):
    assert patches.apply(old, patches.diff(old, new)) == new
    assert patches.diff(new, new) == []


def test_random_patches():
    rng = random.Random(7)

    def tree(depth):
        kind = rng.randrange(4 if depth else 2)
        if kind == 2:
            return {rng.choice("abc/~"): tree(depth - 1) for _ in range(rng.randrange(4))}
        return [tree(depth - 1) for _ in range(rng.randrange(4))] if kind == 3 else rng.choice([1, "x", None, True])

    for _ in range(300):
        a, b = {"r": tree(3)}, {"r": tree(3)}
        assert patches.apply(a, patches.diff(a, b)) == b


def test_changed_fields(spark):
    row = one(spark, patches.changed_fields(F.lit('{"a": 1, "b": 2}'), F.lit('{"b": 3, "c": null}')), patches.changed_fields(F.lit(None).cast("string"), F.lit('{"z": 1}')))
    assert list(row) == [["a", "b", "c"], ["z"]]


def test_version_round_trip(spark):
    rng = random.Random(1)
    states, rows = {}, []
    for e in ("x", "y"):
        for n in range(45):
            state = {"n": n, "tags": [rng.randrange(3) for _ in range(rng.randrange(4))], **({"odd": True} if n % 2 else {})}
            rows.append((e, n, json.dumps(state)))
            states[e, n] = state
    found = versions.numbered(spark.createDataFrame(rows, "entity_uuid string, created_at int, state string")).cache()
    assert [r[0] for r in found.filter("is_snapshot AND entity_uuid = 'x'").select("version_number").orderBy("version_number").collect()] == [1, 21, 41]
    for at in (0, 19, 20, 30, 44):
        got = {r["entity_uuid"]: json.loads(r["state"]) for r in versions.reconstruct(found, F.lit(at)).collect()}
        assert got == {e: states[e, at] for e in ("x", "y")}
    assert versions.reconstruct(found, F.lit(-1)).count() == 0
    assert versions.pruned(found, 2).count() == 50 and versions.pruned(found, 9).count() == 90
    with pytest.raises(ValueError):
        versions.pruned(found, 0)
    assert one(spark, versions.is_snapshot(F.lit(1), None), versions.is_snapshot(F.lit(2), 1)) == (False, False)


def test_traversal_takes_least_depth(spark):
    pairs = [("A", "B"), ("B", "C"), ("A", "C"), ("C", "D"), ("D", "E"), ("E", "A"), ("B", "B")]
    edges = spark.createDataFrame([(a, b, "t") for a, b in pairs], "source_uuid string, target_uuid string, edge_type string")
    walk = lambda *a: {r["uuid"]: r["depth"] for r in graph.traverse(edges, *a).collect()}
    assert walk("A", 3) == {"B": 1, "C": 1, "D": 2, "E": 3}
    assert walk("A", 2, "incoming") == {"E": 1, "D": 2}
    assert walk("Z", 1, "both") == {}
    for bad in (("A", 0), ("A", 4), ("A", 1, "sideways")):
        with pytest.raises(ValueError):
            graph.traverse(edges, *bad)
    assert graph.incident(edges, spark.createDataFrame([("B",)], "uuid string")).count() == 3
    assert graph.without_nodes(edges, spark.createDataFrame([("B",)], "uuid string")).count() == 4


def test_chunks(spark):
    assert chunks.packed([], chunks.CHILD) == []
    assert chunks.packed(["a b c"], chunks.CHILD) == [(0, 3, "a b c")]
    long = " ".join(map(str, range(130)))
    assert [c[:2] for c in chunks.packed([long], chunks.CHILD)] == [(0, 60), (60, 120), (120, 130)]
    with pytest.raises(ValueError):
        chunks.ChunkConfig("bad", 5, 5, 1, 2)
    rows = spark.createDataFrame([(1, "One two three four. " * 60), (2, None), (3, "")], "id long, text string")
    found = chunks.two_levels(rows)
    assert {r["id"] for r in found.collect()} == {1}
    assert found.select("chunk_id").distinct().count() == found.count()
    again = chunks.reindexed(found, rows.filter("id = 1"))
    assert again.count() == found.count()


def test_learning_state(spark):
    fb = spark.createDataFrame([("c", "correct", "a", "b"), ("c", "correct", "b", "b"), ("c", "correct", "b", None), ("d", "deny", "b", "b")], "component_type string, action string, selected string, corrected string")
    counters = learning.namespace_counters(fb)
    assert [tuple(r) for r in counters.collect()] == [("c", 1, 2, 2)]
    states = spark.createDataFrame([("c", 5, 0), ("d", 1, 1)], "component_type string, version long, feedback_count_applied long")
    assert sorted(tuple(r) for r in learning.updated_state(states, counters).select("component_type", "version", "feedback_count_applied").collect()) == [("c", 7, 2), ("d", 1, 1)]


def test_cleanup_needs_many_failures(spark):
    rows = spark.createDataFrame([(i, "failed") for i in range(5)], "uuid long, status string").withColumn("finished_at", times.moment("2024-01-01 00:00:00"))
    now = times.moment("2024-02-01 00:00:00")
    assert finders.cleaned(rows, now, most=5).count() == 5 and finders.cleaned(rows, now, most=4).count() == 0


def test_finders(spark):
    rows = spark.createDataFrame([(1, "local"), (2, "synced"), (3, None)], "uuid long, sync_status string")
    assert [r["uuid"] for r in finders.unsynced(rows).collect()] == [1]
    assert finders.by(rows, "uuid", uuid=[2, 3, 9]).count() == 2


def test_tools(spark):
    registry = ToolRegistry()
    registry.register(Tool("task.list", lambda s, a: s.range(a["n"]), "lists", ("n",)))
    with pytest.raises(ValueError):
        registry.register(Tool("task", lambda s, a: s.range(1)))
    rows = registry.execute(spark, [("task.list", {"n": 3}), ("task.list", {}), ("no.tool", {})]).collect()
    assert [(r["success"], r["rows"]) for r in rows] == [(True, 3), (False, None), (False, None)]
    assert registry.namespaces() == ["task"] and len(registry.of("task")) == 1 and registry.exported()[0]["name"] == "task.list"


def test_windows_split_a_text_once(spark):
    """Not once a window, which is quadratic in a text's length."""
    df = spark.createDataFrame([(" ".join(map(str, range(1000))),), (None,), ("",)], "text string").select(texts.sliding_windows(F.col("text"), 12, 4).alias("w"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [len(r["w"]) for r in df.collect()] == [125, 0, 0]
