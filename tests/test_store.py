"""The entity store: transactions, uniqueness, compare and set, blobs."""

import pytest
from pyspark.sql import functions as F

from quern.errors import CommitConflict, DuplicateEntity, EntityNotFound, QueryFailed, VersionConflict
from quern.schemas import NAMES, schema
from quern.sources.store import EntityStore, blobs, inserted, merged, typed_view, unique, without


def rows(spark, *data):
    return spark.createDataFrame(list(data), "uuid string, name string, version long")


@pytest.fixture
def store(spark, tmp_path):
    found = EntityStore(spark, f"file://{tmp_path}/store")
    found.save("things", rows(spark, ("a", "one", 1), ("b", "two", 1)))
    return found


def test_upsert_and_lookup(spark, store):
    store.save("things", rows(spark, ("b", "zwei", 2), ("c", "drei", 1)), before=[lambda df: df.withColumn("name", F.upper("name"))])
    assert {r["uuid"]: r["name"] for r in store.read("things").collect()} == {"a": "one", "b": "ZWEI", "c": "DREI"}
    assert store.get("things", "a")["name"] == "one" and store.find("things", "z").count() == 0 and store.count("things") == 3
    with pytest.raises(EntityNotFound):
        store.get("things", "z")
    with pytest.raises(EntityNotFound):
        store.read("nothing")


def test_failing_stage_changes_nothing(spark, store):
    def refuse(df):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        store.save("things", rows(spark, ("a", "x", 9)), before=[refuse])
    assert store.get("things", "a")["name"] == "one"


def test_transaction_is_all_or_nothing(spark, store):
    bad = rows(spark, ("q", "q", 1)).select(F.raise_error(F.lit("broken")).cast("string").alias("uuid"))
    with pytest.raises(Exception):
        store.commit({"other": rows(spark, ("x", "x", 1)), "things": bad})
    assert store.tables() == ["things"] and store.count("things") == 2
    old = store.read("things")
    store.commit({"other": rows(spark, ("x", "x", 1)), "things": rows(spark)})
    assert store.tables() == ["other", "things"] and store.count("things") == 0 and old.count() == 2  # readers keep their snapshot


def test_unique_insert_and_delete(spark, store):
    with pytest.raises(DuplicateEntity):
        store.insert("things", rows(spark, ("a", "again", 1)))
    with pytest.raises(DuplicateEntity):
        store.insert("things", rows(spark, ("n", "one", 1), ("m", "one", 1)), "name")
    store.insert("things", rows(spark, ("n", "new", 1)))
    assert store.delete("things", rows(spark, ("n", "", 0), ("missing", "", 0))) == 1
    assert store.delete_where("things", F.col("name") == "two") == 1 and store.count("things") == 1
    assert inserted(rows(spark, ("a", "x", 1)), rows(spark, ("a", "y", 1), ("k", "2", 1), ("k", "1", 1)), "uuid").collect()[0]["name"] == "1"


def test_compare_and_set(spark, store):
    left = store.swap("things", rows(spark, ("a", "won", 1), ("b", "lost", 7)))
    assert [r["uuid"] for r in left.collect()] == ["b"]
    assert tuple(store.get("things", "a")) == ("a", "won", 2) and store.get("things", "b")["name"] == "two"
    with pytest.raises(VersionConflict):
        store.swap_one("things", rows(spark, ("a", "late", 1)))
    with pytest.raises(EntityNotFound):
        store.swap("things", rows(spark, ("zz", "", 1)))


def test_mark_synced(spark, store):
    store.save("sync", spark.createDataFrame([("a", None, "local"), ("b", None, "local")], "uuid string, sync_id string, sync_status string"))
    store.mark_synced("sync", spark.createDataFrame([("a", "s1")], "uuid string, sync_id string"))
    assert sorted(tuple(r) for r in store.read("sync").collect()) == [("a", "s1", "synced"), ("b", None, "local")]


def test_schemas_and_json_views(spark):
    assert all("uuid" in schema(n).names or n in ("system_events", "chunks", "embedding_tasks") for n in NAMES)
    data = [("u", "task", '{"title": "t", "n": 3}', None, None, None, None), ("v", "note", "{}", None, None, None, None), ("w", "task", "not json", None, None, None, None)]
    view = typed_view(spark.createDataFrame(data, schema("entities")), "task", {"title": "string", "n": "int"})
    assert sorted((r["uuid"], r["title"], r["n"]) for r in view.collect()) == [("u", "t", 3), ("w", None, None)]


def test_blobs(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert [(r["length"], bytes(r["content"])) for r in blobs(spark, f"file://{tmp_path}").collect()] == [(3, b"abc")]


def many(spark, n, name="x"):
    return spark.range(n).selectExpr("concat('k', id) AS uuid", f"'{name}' AS name", "1L AS version")


def written(tmp_path, since):
    return sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if f not in since)


def test_a_small_save_writes_its_buckets_only(spark, tmp_path):
    sizes = {}
    for n in (200, 20_000):
        store = EntityStore(spark, f"file://{tmp_path}/s{n}", bucket_bytes=4000)
        store.save("things", many(spark, n))
        before = set(tmp_path.rglob("*.parquet"))
        store.save("things", rows(spark, ("k7", "changed", 2)))
        sizes[n] = written(tmp_path, before)
        assert store.get("things", "k7")["name"] == "changed" and store.count("things") == n == store.read("things").count()
        assert store.read("things").filter("name = 'x'").count() == n - 1
    assert sizes[20_000] < 2 * sizes[200] < 20_000


def test_tables_are_dealt_anew_as_they_grow(spark, tmp_path):
    store = EntityStore(spark, f"file://{tmp_path}/s", buckets=2, bucket_bytes=3000)
    dealt = []
    for n in (10, 2000, 4000, 8000):
        store.save("things", many(spark, n, f"n{n}"))
        dealt.append(store.manifests.latest().tables["things"].dealt)
        assert store.count("things") == store.read("things").select("uuid").distinct().count() == n
    assert dealt[0] == 2 and dealt == sorted(dealt) and dealt[-1] > 8
    assert store.find("things", "k3999").count() == 1 and store.find("things", "k8000").count() == 0


def test_snapshots_and_vacuum(spark, store, tmp_path):
    before = store.snapshot()
    store.save("things", rows(spark, ("a", "new", 2), ("c", "three", 1)))
    store.save("other", rows(spark, ("x", "x", 1)))
    assert before.tables() == ["things"] and before.get("things", "a")["name"] == "one" and before.count("things") == before.read("things").count() == 2
    assert store.vacuum(3600) == 0 and before.read("things").count() == 2
    files = len(list(tmp_path.rglob("*.parquet")))
    assert store.vacuum(-10) > 0 and len(list(tmp_path.rglob("*.parquet"))) < files
    assert store.get("things", "a")["name"] == "new" and store.count("things") == store.read("things").count() == 3 and store.tables() == ["other", "things"]
    with pytest.raises(Exception):
        before.read("things").collect()
    store.save("things", rows(spark, ("b", "still", 5)))
    assert {r["uuid"]: r["name"] for r in store.read("things").collect()} == {"a": "new", "b": "still", "c": "three"}


def test_two_writers(spark, store):
    first, second = store.transaction(), store.transaction()
    first.save("things", rows(spark, ("a", "first", 2)))
    second.save("things", rows(spark, ("a", "second", 2)))
    first.commit()
    with pytest.raises(CommitConflict):
        second.commit()
    assert store.get("things", "a")["name"] == "first"
    entry = store.manifests.latest().tables["things"]
    apart = [k for k in "abcdefghijklmnop" if spark.sql(f"SELECT pmod(xxhash64('{k}'), {entry.dealt})").first()[0] != spark.sql(f"SELECT pmod(xxhash64('a'), {entry.dealt})").first()[0]][0]
    first, second = store.transaction(), store.transaction()
    first.save("things", rows(spark, ("a", "again", 3)))
    first.save("other", rows(spark, ("o", "o", 1)))
    second.save("things", rows(spark, (apart, "elsewhere", 1)))
    second.commit()
    first.commit()  # other buckets: neither is lost
    assert store.get("things", "a")["name"] == "again" and store.get("things", apart)["name"] == "elsewhere" and store.tables() == ["other", "things"]
    reader = store.transaction()
    total = reader.read("things").count()
    reader.save("other", rows(spark, ("total", str(total), 1)))
    store.save("things", rows(spark, ("zz", "late", 1)))
    with pytest.raises(CommitConflict):  # it has read what is no longer so
        reader.commit()
    assert store.find("other", "total").count() == 0


def test_a_single_write_begins_again(spark, store):
    calls = []

    def slow(transaction):
        transaction.save("things", rows(spark, ("a", f"try {len(calls)}", 2)))
        if not calls:
            store.save("things", rows(spark, ("a", "in between", 5), ("b", "in between", 5)))
        calls.append(1)

    store._tried("things", slow)
    assert len(calls) == 2 and store.get("things", "a")["name"] == "try 1" and store.get("things", "b")["name"] == "in between"


def test_a_transaction_sees_its_own_writes(spark, store):
    t = store.transaction()
    t.save("things", rows(spark, ("c", "three", 1)))
    t.delete("things", rows(spark, ("a", "", 0)))
    assert t.delete_where("things", F.col("name") == "two") == 1
    t.insert("things", rows(spark, ("d", "four", 1)))
    assert sorted(r["uuid"] for r in t.read("things").collect()) == ["c", "d"] and store.count("things") == 2
    t.commit()
    assert sorted(r["uuid"] for r in store.read("things").collect()) == ["c", "d"] and store.count("things") == 2


def test_uuids_are_unique_from_the_first_save(spark, tmp_path):
    store = EntityStore(spark, f"file://{tmp_path}/s")
    store.save("things", rows(spark, ("a", "x", 9), ("a", "x", 10), ("a", "b", 11)))
    assert [tuple(r) for r in store.read("things").collect()] == [("a", "x", 10)]
    odd = spark.sql("SELECT 'a' AS uuid, 1 AS n, map('k', 2) AS m UNION ALL SELECT 'a', 1, map('k', 3)")
    assert unique(odd).first()["m"] == {"k": 3}


def test_rows_that_come_out_otherwise_each_time(spark, store):
    store.save("things", spark.range(50).select(F.expr("uuid()").alias("uuid"), F.lit("random").alias("name"), F.lit(1).cast("long").alias("version")))
    assert store.count("things") == store.read("things").count() == 52


def test_new_columns_and_types(spark, store):
    store.save("things", rows(spark, ("a", "one", 1)).withColumn("extra", F.lit(5)))
    assert {r["uuid"]: r["extra"] for r in store.read("things").collect()} == {"a": 5, "b": None}
    store.save("things", spark.createDataFrame([("b", "two", 2.5)], "uuid string, name string, version double"))
    assert {r["uuid"]: r["version"] for r in store.read("things").collect()} == {"a": 1.0, "b": 2.5}


def test_reads_raise_the_stores_errors(spark, store):
    with pytest.raises(QueryFailed):
        store.query("things", lambda df: df.filter("nothing = 1"))
    with pytest.raises(QueryFailed):
        store.delete_where("things", F.col("nothing") == 1)
    with pytest.raises(QueryFailed):
        store.insert("things", rows(spark, ("q", "q", 1)), "nothing")
    with pytest.raises(EntityNotFound):
        store.delete("nowhere", rows(spark, ("q", "q", 1)))
    assert store.query("things", lambda df: df.filter("uuid = 'a'").select("name"))[0]["name"] == "one"


def shuffled(spark, what):
    """Bytes that `what` exchanges."""
    scala = spark.sparkContext._jsc.sc()

    def now():
        scala.listenerBus().waitUntilEmpty(30_000)
        return scala.statusStore().executorSummary("driver").totalShuffleWrite()

    before = now()
    what()
    return now() - before


def test_a_write_exchanges_contents_once(spark, tmp_path):
    made = spark.range(400).selectExpr("id AS uuid", "transform(sequence(1, 300), i -> hash(id, i)) AS numbers")
    docs = made.select("uuid", F.concat_ws("", F.transform("numbers", lambda n: F.sha2(n.cast("string"), 256))).cast("binary").alias("content"))
    docs.write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    contents = EntityStore(spark, f"file://{tmp_path}/s", buckets=2, bucket_bytes=500_000)
    once = shuffled(spark, lambda: docs.repartition(4, "uuid").write.parquet(f"file://{tmp_path}/dealt"))
    assert shuffled(spark, lambda: contents.save("blobs", docs)) < 1.2 * once
    assert len(list(tmp_path.glob("s/blobs/rows-*"))) == 1 and contents.manifests.latest().tables["blobs"].dealt > 2  # into enough buckets at once
    assert shuffled(spark, lambda: contents.save("blobs", docs.filter("uuid % 4 = 0").withColumn("content", F.reverse("content")))) < 1.5 * once
    assert shuffled(spark, lambda: contents.delete("blobs", docs.filter("uuid % 5 = 0"))) < 1.2 * once
    want = docs.filter("uuid % 5 <> 0").withColumn("content", F.when(F.col("uuid") % 4 == 0, F.reverse("content")).otherwise(F.col("content")))
    assert contents.count("blobs") == 320 and contents.read("blobs").exceptAll(want).isEmpty()


def test_writes_give_what_the_functions_give(spark, tmp_path):
    """Rows without uuid, uuids that come several times, columns on one side and values without order."""
    old = spark.sql("SELECT * FROM VALUES ('a', 1, map('k', 1)), ('b', 1, map('k', 1)), ('b', 2, NULL), (NULL, 1, NULL), (NULL, 2, NULL), ('c', 3, NULL) AS t(uuid, n, m)")
    new = spark.sql("SELECT * FROM VALUES ('a', 5, 2), ('a', 7, 1), ('d', NULL, 1), ('d', 0, NULL), (NULL, 9, 9), (NULL, 8, 9) AS t(uuid, n, extra)")
    found = EntityStore(spark, f"file://{tmp_path}/s", buckets=3)
    found.save("fresh", new)
    found.commit({"things": old})
    found.save("things", new)
    plain = lambda rows: sorted(repr(sorted(r.asDict().items())) for r in rows.collect())
    assert plain(found.read("fresh")) == plain(unique(new)) and plain(found.read("things")) == plain(merged(old, new))
    found.commit({"things": old})
    assert found.delete("things", new.select("uuid")) == 1
    assert plain(found.read("things")) == plain(without(old, new))
