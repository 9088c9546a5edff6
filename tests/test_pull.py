"""Incremental pulls against the batch merge."""

import pytest
from pyspark.sql import functions as F

from quern.catalogue import QUERIES
from quern.sources.store import EntityStore
from quern.sources.views import view
from quern.streaming import pipelines, pull

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark, tmp_path):
    found = EntityStore(spark, f"file://{tmp_path}/store", buckets=2)
    found.save("things", view(spark, SF, "local_entities").select("uuid", "payload", "updated_at"))
    return found


def state(store):
    return sorted((r["uuid"], round(r["payload"], 2)) for r in store.read("things").collect())


def wanted(spark):
    return sorted((r["uuid"], r["payload"]) for r in QUERIES["sync_lww_merge"](spark, SF).collect())


def test_a_stream_of_changes(spark, store, tmp_path):
    remote = view(spark, SF, "remote_entities").select("uuid", "payload", "updated_at")
    old = remote.withColumns({"updated_at": F.lit(-5).cast(remote.schema["updated_at"].dataType), "payload": F.lit(0.0).cast(remote.schema["payload"].dataType)})
    folder = f"file://{tmp_path}/in"
    for part in (remote.filter("uuid % 3 = 0"), old, remote.filter("uuid % 3 <> 0")):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: pipelines.source(spark, folder, remote.schema, 1)
    pull.pull_stream(stream(), store, "things", f"file://{tmp_path}/c").awaitTermination(120)
    # Only the uuids that nobody else has a newer copy of could have taken an old change.
    assert state(store) == wanted(spark)
    pull.pull_stream(stream(), store, "things", f"file://{tmp_path}/again").awaitTermination(120)  # every batch once more
    assert state(store) == wanted(spark)


def test_pulls_by_cursor(spark, store):
    remote = view(spark, SF, "remote_entities").select("uuid", "payload", "updated_at")
    early = remote.filter("updated_at <= 50")
    assert pull.pull_once(early, store, "things") == early.count()
    again = early.filter(F.col("updated_at") == early.agg(F.max("updated_at")).first()[0]).count()
    assert pull.pull_once(early, store, "things") == again
    late = remote.filter("updated_at >= 50").count()
    assert pull.pull_once(remote, store, "things") == late < remote.count()
    assert state(store) == wanted(spark)
    assert store.get(pull.CURSORS, "things")["updated_at"] == remote.agg(F.max("updated_at")).first()[0]


def test_the_cursor_and_the_rows_come_together(spark, store):
    remote = view(spark, SF, "remote_entities").select("uuid", "payload", "updated_at")
    broken = remote.withColumn("payload", F.when(F.col("uuid") > 100, F.raise_error(F.lit("no")).cast("double")).otherwise(F.col("payload").cast("double")).cast(remote.schema["payload"].dataType))
    with pytest.raises(Exception):
        pull.pull_once(broken, store, "things")
    assert store.tables() == ["things"]
    assert pull.pull_once(remote.limit(0), store, "things") == 0 and store.tables() == ["things"]
