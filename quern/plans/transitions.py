"""State transitions, sharing, attachments and texts of entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import access, texts, times
from ..operators import finders
from ..sources import store
from ..sources.views import table, view
from ..streaming import pipelines
from .registry import query

_NOW = "2001-08-01 00:00:00"


@query("""SELECT uuid, CASE WHEN uuid % 3 = 0 THEN true WHEN uuid % 3 = 1 THEN false ELSE completed END AS completed,
    CASE WHEN uuid % 4 = 1 THEN 'high' ELSE priority END AS priority FROM tasks""")
def task_transitions(spark, sf_dir):
    """complete, reopen and setPriority; a priority that is not known is ignored."""
    rows = view(spark, sf_dir, "tasks")
    asked = F.element_at(F.array(F.lit("urgent"), F.lit("high"), F.lit(""), F.lit("none")), (F.col("uuid") % 4 + 1).cast("int"))
    event = F.element_at(F.array(F.lit("complete"), F.lit("reopen"), F.lit("touch")), (F.col("uuid") % 3 + 1).cast("int"))
    return rows.select("uuid", finders.task_state(F.col("completed"), event).alias("completed"), finders.task_priority(F.col("priority"), asked).alias("priority"))


@query("""SELECT uuid, CASE WHEN NOT fired AND uuid % 2 = 0 THEN true ELSE fired END AS fired, CASE WHEN NOT fired AND uuid % 4 = 0 THEN true ELSE cancelled END AS cancelled FROM timers""")
def timer_transitions(spark, sf_dir):
    rows = view(spark, sf_dir, "timers")
    stop = ~F.col("fired") & (F.col("uuid") % 2 == 0)
    return rows.select("uuid", (F.col("fired") | stop).alias("fired"), (F.col("cancelled") | (stop & (F.col("uuid") % 4 == 0))).alias("cancelled"))


@query("SELECT uuid, 0 AS hours_since_check, name FROM subscriptions WHERE uuid % 10 = 0 UNION ALL SELECT uuid, hours_since_check, name FROM subscriptions WHERE uuid % 10 <> 0")
def sub_record_polling(spark, sf_dir):
    polled = F.col("uuid") % 10 == 0
    return view(spark, sf_dir, "subscriptions").select("uuid", F.when(polled, F.lit(0).cast("long")).otherwise(F.col("hours_since_check")).alias("hours_since_check"), "name")


@query("""SELECT uuid, len(list_distinct([shared_with, 7])) AS shared, CASE WHEN shared_with = 7 THEN 0 ELSE 1 END AS unshared FROM owned""")
def acc_share_unshare(spark, sf_dir):
    shared = F.array("shared_with").cast("array<bigint>")
    rows = view(spark, sf_dir, "owned")
    return rows.select("uuid", F.size(access.share(shared, 7)).cast("long").alias("shared"), F.size(access.unshare(shared, 7)).alias("unshared"))


@query("SELECT uuid FROM owned WHERE owner_id = 11 OR visibility = 'public' OR shared_with = 11 ORDER BY uuid")
def acc_row_policy(spark, sf_dir):
    """A table under a policy: what a user may see of it."""
    may = access.accessible_by(F.col("owner_id"), F.col("visibility"), F.array("shared_with"), 11)
    return view(spark, sf_dir, "owned").filter(may).select("uuid").orderBy("uuid")


@query("""SELECT o_orderkey AS uuid, count(*) FILTER (l_returnflag = 'R') AS images, count(*) FILTER (l_returnflag = 'A') AS audio, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size_bytes
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def file_attachments(spark, sf_dir):
    """Attachments of an entity by class, and their total size."""
    from ..functions import files

    kind = F.when(F.col("l_returnflag") == "R", "image/png").when(F.col("l_returnflag") == "A", "audio/aac").otherwise("video/mp4")
    item = F.struct(kind.alias("content_type"), F.col("l_quantity").cast("long").alias("size_bytes"))
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("uuid")).agg(F.collect_list(item).alias("items"))
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uuid"))
    counts = [F.size(files.attachments_of(F.col("items"), c)).cast("long").alias(n) for c, n in (("image", "images"), ("audio", "audio"))]
    return lists.join(owners, "uuid", "left_semi").select("uuid", *counts, files.attachments_size(F.col("items")).alias("size_bytes"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN concat('heard ', CAST(event_id AS VARCHAR)) WHEN 'view' THEN concat('said ', CAST(event_id AS VARCHAR)) ELSE '' END AS txt FROM events""")
def inv_embedding_text(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "stt").when(F.col("event_type") == "view", "llm").otherwise("tts")
    said = F.concat(F.when(kind == "stt", 'heard ').otherwise("said "), F.col("event_id").cast("string"))
    output = F.to_json(F.when(kind == "stt", F.create_map(F.lit("transcript"), said)).otherwise(F.create_map(F.lit("response"), said)))
    return table(spark, sf_dir, "events").select("event_id", texts.embedding_text(kind, output).alias("txt"))


@query("""SELECT s_suppkey AS uuid, concat('Supplier ', s_name, chr(10), 'Tools: ', CAST(s_nationkey AS VARCHAR), ', x', chr(10), 'a: ', s_name, chr(10), 'b: 1') AS prompt FROM supplier""")
def txt_prompts(spark, sf_dir):
    tools = F.array(F.col("s_nationkey").cast("string"), F.lit("x"))
    context = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.col("s_name"))
    prompt = texts.prompt(F.concat(F.lit("Supplier "), F.col("s_name")), tools, context)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uuid"), prompt.alias("prompt"))


@query("SELECT c_custkey AS uuid, c_name AS name FROM customer WHERE c_custkey % 4 <> 0")
def ent_insert_if_absent(spark, sf_dir):
    """Insert with unique keys: those stored already are left alone."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uuid"), F.col("c_name").alias("name"))
    return store.inserted(rows.filter("uuid % 4 = 0"), rows.unionByName(rows.filter("uuid < 50")), "uuid")


@query("""SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'failed' AND retry_count < 3) AS retryable, max(last_attempt_at) AS last_attempt FROM embedding_tasks""")
def queue_stats(spark, sf_dir):
    return pipelines.queue_counts(view(spark, sf_dir, "embedding_tasks"))


@query("""SELECT l.uuid, CASE WHEN r.uuid IS NOT NULL OR NOT l.dirty THEN 'synced' ELSE 'local' END AS status, CASE WHEN r.uuid IS NOT NULL THEN concat('r', CAST(r.uuid AS VARCHAR)) END AS sync_id
    FROM local_entities l LEFT JOIN remote_entities r ON r.uuid = l.uuid AND NOT r.deleted""")
def sync_mark_synced(spark, sf_dir):
    """Rows that the remote confirms by its live copies, marked as the store does it."""
    rows = view(spark, sf_dir, "local_entities").select("uuid", F.when(F.col("dirty"), "local").otherwise("synced").alias("sync_status"), F.lit(None).cast("string").alias("sync_id"))
    confirmed = view(spark, sf_dir, "remote_entities").filter("NOT deleted").select("uuid", F.concat(F.lit("r"), F.col("uuid").cast("string")).alias("sync_id"))
    return store.marked_synced(rows, confirmed).select("uuid", F.col("sync_status").alias("status"), "sync_id")


@query(f"""SELECT o_orderkey AS uuid, CAST(date_diff('second', o_orderdate, TIMESTAMP '{_NOW}') // 3600 AS BIGINT) AS hours, o_orderdate < TIMESTAMP '{_NOW}' - INTERVAL 48 HOUR AS stale FROM orders""")
def time_since_check(spark, sf_dir):
    now, at = times.moment(_NOW), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uuid"), times.whole_hours(at, now).alias("hours"), times.stale(at, now, 48).alias("stale"))


@query("""SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL""")
def json_typed_view(spark, sf_dir):
    entities = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("uuid"), F.col("event_type").alias("type"), F.col("props").alias("data"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return store.typed_view(entities, "click", {"k": "string"}).groupBy("k").agg(F.count("*").alias("n"))
