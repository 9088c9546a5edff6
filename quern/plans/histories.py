"""Version history, synchronisation and compare-and-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sync, versions
from ..sources import store
from ..sources.views import table, view
from .registry import query

_TIME = "2024-01-15 00:00:00"


@query("SELECT version_number, event_type FROM versions WHERE entity_uuid = 9 ORDER BY version_number")
def ver_history(spark, sf_dir):
    return view(spark, sf_dir, "versions").filter("entity_uuid = 9").orderBy("version_number").select("version_number", "event_type")


@query("SELECT entity_uuid, max(version_number) AS version_number, arg_max(event_type, version_number) AS event_type, arg_max(value, version_number) AS value FROM versions GROUP BY entity_uuid")
def ver_latest(spark, sf_dir):
    return versions.latest(view(spark, sf_dir, "versions"), "event_type", "value")


@query(f"SELECT entity_uuid, max(version_number) AS version_number, arg_max(value, version_number) AS value FROM versions WHERE created_at <= TIMESTAMP '{_TIME}' GROUP BY entity_uuid")
def ver_at_time(spark, sf_dir):
    return versions.latest(view(spark, sf_dir, "versions").filter(f"created_at <= TIMESTAMP_NTZ '{_TIME}'"), "value")


@query(f"SELECT entity_uuid, version_number FROM versions WHERE created_at BETWEEN TIMESTAMP '{_TIME}' AND TIMESTAMP '2024-01-16 00:00:00'")
def ver_between(spark, sf_dir):
    return view(spark, sf_dir, "versions").filter(f"created_at BETWEEN TIMESTAMP_NTZ '{_TIME}' AND TIMESTAMP_NTZ '2024-01-16 00:00:00'").select("entity_uuid", "version_number")


@query("SELECT event_id, version_number, version_number = 1 OR version_number % 20 = 1 AS is_snapshot FROM versions")
def ver_snapshot_flags(spark, sf_dir):
    return view(spark, sf_dir, "versions").select("event_id", "version_number", versions.is_snapshot(F.col("version_number")).alias("is_snapshot"))


@query("""SELECT event_id, CAST(version_number - (version_number - 1) % 20 AS BIGINT) AS snapshot_number FROM versions""")
def ver_nearest_snapshot(spark, sf_dir):
    found = versions.nearest_snapshot(view(spark, sf_dir, "versions"))
    return found.select("event_id", F.col("snapshot_number").cast("long").alias("snapshot_number"))


@query("""WITH last AS (SELECT entity_uuid, max(version_number) AS m FROM versions GROUP BY entity_uuid)
    SELECT event_id FROM versions JOIN last USING (entity_uuid) WHERE (m - 1) // 20 + 1 <= 2 OR version_number >= ((m - 1) // 20 - 1) * 20 + 1""")
def ver_prune_keep2(spark, sf_dir):
    return versions.pruned(view(spark, sf_dir, "versions"), 2).select("event_id")


_STATE = "concat('{\"type\": \"', event_type, '\", \"value\": ', CAST(event_id % 5 AS VARCHAR(20)), '}')"


@query("""WITH p AS (SELECT event_id, event_type, lag(event_type) OVER w AS e, event_id % 5 AS v, lag(event_id % 5) OVER w AS b FROM versions WINDOW w AS (PARTITION BY entity_uuid ORDER BY version_number))
    SELECT event_id, concat_ws(',', CASE WHEN e IS DISTINCT FROM event_type THEN 'type' END, CASE WHEN b IS DISTINCT FROM v THEN 'value' END) AS changed FROM p""")
def ver_changed_fields(spark, sf_dir):
    from pyspark.sql import Window

    from ..functions import patches

    rows = view(spark, sf_dir, "versions").withColumn("state", F.expr(_STATE))
    before = F.lag("state").over(Window.partitionBy("entity_uuid").orderBy("version_number"))
    rows = rows.withColumn("before", before)
    return rows.select("event_id", F.array_join(patches.changed_fields(F.col("before"), F.col("state")), ",").alias("changed"))


@query(f"""SELECT entity_uuid, concat('{{"type": "', arg_max(event_type, (created_at, event_id)), '", "value": ', CAST(arg_max(event_id, (created_at, event_id)) % 5 AS VARCHAR), '}}') AS state
    FROM versions WHERE created_at <= TIMESTAMP '{_TIME}' GROUP BY entity_uuid""")
def ver_reconstruct(spark, sf_dir):
    """States recorded as deltas with snapshots, then folded back as of a time.

    Later states have no influence on the numbers of earlier ones: they are left out before.
    """
    rows = view(spark, sf_dir, "versions").filter(f"created_at <= TIMESTAMP_NTZ '{_TIME}'").select("entity_uuid", "created_at", F.expr(_STATE).alias("state"))
    return versions.reconstruct(versions.numbered(rows), F.lit(_TIME).cast("timestamp_ntz"))


@query("SELECT uuid FROM local_entities WHERE dirty")
def sync_dirty(spark, sf_dir):
    return view(spark, sf_dir, "local_entities").filter("dirty").select("uuid")


_BOTH = "FROM local_entities l FULL JOIN remote_entities r ON l.uuid = r.uuid"


@query(f"""SELECT coalesce(l.uuid, r.uuid) AS uuid, round(CASE WHEN r.uuid IS NULL OR l.updated_at > r.updated_at THEN l.payload ELSE r.payload END, 2) AS payload,
    CASE WHEN r.uuid IS NULL OR l.updated_at > r.updated_at THEN 'local' ELSE 'remote' END AS side {_BOTH}""")
def sync_lww_merge(spark, sf_dir):
    found = sync.last_writer_wins(view(spark, sf_dir, "local_entities"), view(spark, sf_dir, "remote_entities"))
    return found.select("uuid", F.round("payload", 2).alias("payload"), "side")


@query(f"""SELECT coalesce(l.uuid, r.uuid) AS uuid, round(coalesce(l.payload, r.payload), 2) AS payload, CASE WHEN l.uuid IS NULL THEN 'remote' ELSE 'local' END AS side {_BOTH}""")
def sync_resolve_keep_local(spark, sf_dir):
    found = sync.resolved(view(spark, sf_dir, "local_entities"), view(spark, sf_dir, "remote_entities"), "local")
    return found.select("uuid", F.round("payload", 2).alias("payload"), "side")


@query("SELECT uuid, updated_at, deleted FROM remote_entities WHERE updated_at > 80 ORDER BY updated_at, uuid")
def sync_delta_pull(spark, sf_dir):
    return sync.changed_since(view(spark, sf_dir, "remote_entities"), 80).select("uuid", "updated_at", "deleted")


@query("SELECT uuid FROM remote_entities WHERE type = 'P' AND NOT deleted ORDER BY updated_at DESC, uuid")
def sync_soft_delete_view(spark, sf_dir):
    return sync.live(view(spark, sf_dir, "remote_entities"), "P").select("uuid")


@query("SELECT l.uuid FROM local_entities l LEFT JOIN remote_entities r ON l.uuid = r.uuid WHERE l.dirty AND (r.uuid IS NULL OR l.updated_at > r.updated_at)")
def sync_to_push(spark, sf_dir):
    return sync.to_push(view(spark, sf_dir, "local_entities"), view(spark, sf_dir, "remote_entities")).select("uuid")


def _versioned(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uuid"), (F.col("o_orderkey") % 3).alias("version"))
    incoming = stored.filter("uuid % 2 = 0").select("uuid", (F.col("uuid") % 6 % 4).alias("version"))
    return store.compare_and_set(stored, incoming)


@query("SELECT o_orderkey AS uuid, o_orderkey % 6 % 4 + 1 AS version FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 6 % 4 = o_orderkey % 3")
def cas_apply(spark, sf_dir):
    return _versioned(spark, sf_dir)[0]


@query("SELECT o_orderkey AS uuid, o_orderkey % 6 % 4 AS version, o_orderkey % 3 AS stored_version FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 6 % 4 <> o_orderkey % 3")
def cas_conflicts(spark, sf_dir):
    return _versioned(spark, sf_dir)[1]


@query("""SELECT o_orderkey AS uuid, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0
    UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 35 = 0""")
def ent_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uuid"), F.col("o_orderstatus").alias("status"))
    return store.merged(orders.filter("uuid % 7 <> 0"), orders.filter("uuid % 5 = 0").withColumn("status", F.lit("new")))


@query("SELECT o_orderkey AS uuid FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def ent_delete_where(spark, sf_dir):
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return store.without(table(spark, sf_dir, "orders"), poor, "o_custkey").select(F.col("o_orderkey").alias("uuid"))


@query("SELECT o_orderkey AS uuid, CASE WHEN c_acctbal >= 0 THEN o_custkey END AS owner FROM orders JOIN customer ON c_custkey = o_custkey")
def ent_set_null_on_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("uuid"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uuid"), F.col("o_custkey").alias("owner"))
    return store.nulled_references(rows, "owner", gone)
