"""Queries over subscriptions, channels, media, blobs, queues, synchronisation and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import access, files, patches, texts, times
from ..functions import vectors as V
from ..operators import chunks, finders, graph, search, sync
from ..sources import store
from ..sources.views import TABLES, table, view
from ..streaming import pipelines
from .registry import query
from .vectors import _COSINE, _items, _vector

NOW = "2024-01-20 00:00:00"


# Subscriptions, channels, media, tasks, timers ---------------------------------------


@query("SELECT uuid, name FROM subscriptions WHERE active ORDER BY name")
def sub_active(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "subscriptions"), "name", active=True).select("uuid", "name")


@query("SELECT uuid, name FROM subscriptions WHERE contains(lower(name), '0007') ORDER BY name")
def sub_name_contains(spark, sf_dir):
    return view(spark, sf_dir, "subscriptions").filter(texts.contains_ignoring_case(F.col("name"), "0007")).orderBy("name").select("uuid", "name")


@query("SELECT uuid, name FROM subscriptions WHERE source_url = 'https://feed.example.com/12' ORDER BY uuid LIMIT 1")
def sub_by_source_url(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "subscriptions"), "uuid", source_url="https://feed.example.com/12").limit(1).select("uuid", "name")


@query("SELECT uuid, name FROM channels WHERE youtube_id = 'yt7' ORDER BY uuid LIMIT 1")
def ch_by_youtube_id(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "channels"), "uuid", youtube_id="yt7").limit(1).select("uuid", "name")


@query("SELECT uuid FROM channels WHERE subscribed AND days_since_added <= 30")
def ch_recently_subscribed(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "channels"), subscribed=True).filter("days_since_added <= 30").select("uuid")


@query("SELECT uuid FROM channels WHERE subscribed AND (hours_since_check IS NULL OR hours_since_check >= 1)")
def ch_needing_check(spark, sf_dir):
    return view(spark, sf_dir, "channels").filter(F.col("subscribed") & finders.stale("hours_since_check", 1)).select("uuid")


@query("""SELECT uuid, CASE uuid % 4 WHEN 2 THEN true WHEN 3 THEN false ELSE active END AS active, CASE WHEN uuid % 4 = 1 THEN 10 + 3 ELSE 10 END AS downloaded,
    CASE WHEN uuid % 4 = 0 THEN 0 ELSE hours_since_check END AS hours_since_check FROM subscriptions""")
def sub_transitions(spark, sf_dir):
    """poll, download, activate and deactivate."""
    event = F.element_at(F.array(*(F.lit(x) for x in ("poll", "download", "activate", "deactivate"))), (F.col("uuid") % 4 + 1).cast("int"))
    new = finders.subscription_state(F.col("active"), F.lit(10), F.col("hours_since_check"), event, F.lit(3))
    return view(spark, sf_dir, "subscriptions").select("uuid", new.alias("s")).select("uuid", "s.*")


@query("""SELECT uuid, CASE uuid % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE subscribed END AS subscribed, CASE WHEN uuid % 3 = 0 AND NOT subscribed THEN 0 ELSE days_since_added END AS days_since_added,
    CASE WHEN uuid % 3 = 2 THEN 0 ELSE hours_since_check END AS hours_since_check FROM channels""")
def ch_transitions(spark, sf_dir):
    """subscribe, unsubscribe and check."""
    event = F.element_at(F.array(*(F.lit(x) for x in ("subscribe", "unsubscribe", "check"))), (F.col("uuid") % 3 + 1).cast("int"))
    new = finders.channel_state(F.col("subscribed"), F.col("days_since_added"), F.col("hours_since_check"), event)
    return view(spark, sf_dir, "channels").select("uuid", new.alias("s")).select("uuid", "s.*")


@query("""SELECT uuid, CASE uuid % 4 WHEN 0 THEN 'downloading' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE status END AS status, CASE WHEN uuid % 4 = 1 THEN -uuid ELSE blob_id END AS blob_id,
    CASE WHEN uuid % 4 = 1 THEN 99 ELSE size_bytes END AS size_bytes, CASE WHEN uuid % 4 = 2 THEN 'failed' END AS error FROM media_items""")
def media_transitions(spark, sf_dir):
    """start, complete and fail."""
    event = F.element_at(F.array(*(F.lit(x) for x in ("start", "complete", "fail", "none"))), (F.col("uuid") % 4 + 1).cast("int"))
    new = finders.media_state(F.col("status"), F.col("blob_id"), F.col("size_bytes"), event, -F.col("uuid"), F.lit(99).cast("long"))
    return view(spark, sf_dir, "media_items").select("uuid", new.alias("s")).select("uuid", "s.*")


@query("""SELECT channel_id, count(*) AS n, min(uuid) AS first_id, max(uuid) AS last_id FROM media_items WHERE status = 'completed' GROUP BY channel_id ORDER BY channel_id""")
def media_grouped_by_channel(spark, sf_dir):
    """A search's results by channel."""
    done = finders.by(view(spark, sf_dir, "media_items"), status="completed").groupBy("channel_id")
    return done.agg(F.count("*").alias("n"), F.min("uuid").alias("first_id"), F.max("uuid").alias("last_id")).orderBy("channel_id")


@query("""SELECT page_id, regexp_replace(concat(' ', url, chr(10), CASE WHEN page_id % 2 = 0 THEN 'about' ELSE '' END, chr(10), url), '^\\s+|\\s+$', '', 'g') AS txt FROM pages""")
def media_embedding_text(spark, sf_dir):
    about = F.when(F.col("page_id") % 2 == 0, "about")
    return table(spark, sf_dir, "pages").select("page_id", texts.media_text(F.concat(F.lit(" "), F.col("url")), about, F.col("url")).alias("txt"))


@query("SELECT uuid, completed FROM tasks WHERE owner_id = 7")
def task_by_owner(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "tasks"), owner_id=7).select("uuid", "completed")


@query("SELECT uuid, label FROM timers WHERE label = 'click' AND NOT fired ORDER BY uuid LIMIT 1")
def timer_by_label(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "timers"), "uuid", label="click", fired=False).limit(1).select("uuid", "label")


# Attachments, access, times ----------------------------------------------------------


@query("""SELECT uuid, CASE WHEN uuid % 3 = 0 THEN 2 ELSE 3 END AS n, CASE WHEN uuid % 3 = 0 THEN 30 + 5 ELSE 10 + 20 + 5 END AS size_bytes, CASE WHEN uuid % 3 <> 0 THEN 10 END AS first_size, false AS has_nine FROM channels""")
def file_attachment_changes(spark, sf_dir):
    """One attachment is replaced or taken away, one added; then they are looked up."""
    item = lambda u, n: F.struct(u.alias("uuid"), n.cast("long").alias("size_bytes"))
    odd = F.col("uuid") % 3 == 0
    items = F.array(item(F.lit("1"), F.lit(10)), item(F.lit("2"), F.when(odd, F.lit(30)).otherwise(F.lit(20))))
    items = F.when(odd, files.without_attachment(items, F.lit("1"))).otherwise(files.with_attachment(items, item(F.lit("2"), F.lit(20))))
    items = files.with_attachment(items, item(F.lit("3"), F.lit(5)))
    rows = view(spark, sf_dir, "channels").select("uuid", items.alias("items"))
    one = files.attachment(F.col("items"), F.lit("1"))["size_bytes"]
    return rows.select("uuid", F.size("items").alias("n"), files.attachments_size(F.col("items")).alias("size_bytes"), one.alias("first_size"), files.attachment(F.col("items"), F.lit("9")).isNotNull().alias("has_nine"))


@query("""SELECT uuid, CASE WHEN owner_id = 7 THEN 'public' ELSE visibility END AS opened, CASE WHEN owner_id = 7 THEN 'private' ELSE visibility END AS closed FROM owned""")
def acc_visibility(spark, sf_dir):
    owner, seen = F.col("owner_id"), F.col("visibility")
    return view(spark, sf_dir, "owned").select("uuid", access.made_public(owner, seen, 7).alias("opened"), access.made_private(owner, seen, 7).alias("closed"))


@query("""SELECT event_id, CASE WHEN date_part('microsecond', ts) % 1000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso, ts AS back FROM events""")
def time_iso(spark, sf_dir):
    iso = times.to_iso(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", iso.alias("iso"), times.from_iso(F.concat(iso, F.lit("Z"))).alias("back"))


@query("""SELECT id, CAST(2 * power(2, retry_count - 1) AS DOUBLE) AS seconds, true AS jitter_fits FROM embedding_tasks WHERE retry_count > 0""")
def retry_delays(spark, sf_dir):
    """Backoff by attempt, and that a delay with jitter is half to all of it."""
    delay = times.backoff_seconds(F.col("retry_count"), times.RETRIES["standard"][1])
    shaken = times.jittered(delay, F.col("id"))
    return view(spark, sf_dir, "embedding_tasks").filter("retry_count > 0").select("id", delay.alias("seconds"), ((shaken >= delay / 2) & (shaken <= delay)).alias("jitter_fits"))


@query("""SELECT event_id, event_id % 3 = event_id % 4 AS same FROM events""")
def ver_json_equal(spark, sf_dir):
    """Equality of JSON whatever the order of keys."""
    a = F.expr("concat('{\"k\": ', event_id % 3, ', \"l\": [1, {\"x\": true, \"y\": null}]}')")
    b = F.expr("concat('{\"l\": [1, {\"y\": null, \"x\": true}], \"k\": ', event_id % 4, '}')")
    return table(spark, sf_dir, "events").select("event_id", patches.equal(a, b).alias("same"))


# Blobs and the catalogue -------------------------------------------------------------


@query("""SELECT i.uuid, o.html IS NOT NULL AS present, CAST(coalesce(octet_length(encode(o.html)), -1) AS BIGINT) AS size FROM (SELECT page_id * 2 AS uuid FROM pages) i LEFT JOIN pages o ON o.page_id = i.uuid""")
def blob_sizes(spark, sf_dir):
    """Presence and size of blobs; -1 for those that are not there."""
    pages = table(spark, sf_dir, "pages")
    ids = pages.select((F.col("page_id") * 2).alias("uuid"))
    return store.blob_sizes(ids, pages.select(F.col("page_id").alias("uuid"), F.col("html").cast("binary").alias("content")))


@query("""SELECT page_id AS uuid, CAST(i AS INT) AS position, md5(substr(h, i * 2048 + 1, 2048)) AS digest FROM (SELECT page_id, hex(encode(html)) AS h FROM pages), LATERAL (SELECT unnest(range(0, CAST(ceil(length(h) / 2048.0) AS BIGINT))) AS i)""")
def blob_slice_bytes(spark, sf_dir):
    """Every slice of every blob, by a digest of its bytes."""
    blobs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("uuid"), F.col("html").cast("binary").alias("content"))
    return store.blob_slices(blobs, 1024).select("uuid", "position", F.md5(F.hex("slice")).alias("digest"))


@query("""SELECT m.blob_id AS uuid, b.storage_path, b.size_bytes, b.uuid IS NOT NULL AS remote FROM media_items m LEFT JOIN blob_metadata b ON b.uuid = m.blob_id WHERE m.blob_id IS NOT NULL""")
def blob_metadata_of(spark, sf_dir):
    ids = view(spark, sf_dir, "media_items").filter("blob_id IS NOT NULL").select(F.col("blob_id").alias("uuid"))
    return store.blob_metadata(ids, view(spark, sf_dir, "blob_metadata"))


@query("SELECT DISTINCT table_name AS name, column_name AS field, CAST(ordinal_position AS INT) AS position FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")")
def cat_columns(spark, sf_dir):
    """The columns of all stored tables."""
    found = store.described({t: table(spark, sf_dir, t) for t in TABLES})
    rows = F.array(*(F.struct(F.lit(t).alias("name"), F.lit(c).alias("field"), F.lit(i).alias("position")) for t, c, i, _ in found))
    return spark.range(1).select(F.inline(rows))


# Queue and chunks --------------------------------------------------------------------


@query(f"""WITH p AS (SELECT entity_uuid, min(id) AS id FROM embedding_tasks WHERE status = 'pending' AND (last_attempt_at IS NULL OR last_attempt_at + to_seconds(2 * retry_count) <= TIMESTAMP '{NOW}') GROUP BY entity_uuid)
    SELECT id, entity_uuid FROM p ORDER BY id LIMIT 10""")
def queue_pending_batch(spark, sf_dir):
    """The next ten tasks whose delay is over."""
    return pipelines.next_batch(view(spark, sf_dir, "embedding_tasks"), 10, times.moment(NOW)).select("id", "entity_uuid")


@query("SELECT id, chunk_id FROM stored_chunks WHERE embedding IS NULL")
def chunk_pending_ids(spark, sf_dir):
    return chunks.pending(view(spark, sf_dir, "stored_chunks"))


# Synchronisation ---------------------------------------------------------------------


@query("SELECT uuid FROM local_entities WHERE dirty")
def sync_unsynced(spark, sf_dir):
    """Rows that wait to be pushed, by their status."""
    status = F.when(F.col("dirty"), "local").otherwise("synced")
    return finders.unsynced(view(spark, sf_dir, "local_entities").withColumn("sync_status", status)).select("uuid")


@query("SELECT l.uuid FROM local_entities l ANTI JOIN remote_entities r USING (uuid)")
def sync_unsynced_by_id(spark, sf_dir):
    """Rows without an id of the remote."""
    ids = view(spark, sf_dir, "remote_entities").select("uuid", F.col("uuid").alias("sync_id"))
    return finders.unsynced_by_id(view(spark, sf_dir, "local_entities").join(ids, "uuid", "left")).select("uuid")


@query("SELECT event_id, version_number FROM versions WHERE entity_uuid = 9 AND event_type = 'error'")
def ver_unsynced(spark, sf_dir):
    """Versions of one entity that wait to be pushed (errors stand for those)."""
    status = F.when(F.col("event_type") == "error", "local").otherwise("synced")
    return finders.unsynced(finders.by(view(spark, sf_dir, "versions"), entity_uuid=9).withColumn("sync_status", status)).select("event_id", "version_number")


@query("SELECT r.uuid, coalesce(CASE WHEN l.dirty THEN 'local' WHEN l.uuid IS NOT NULL THEN 'synced' END, 'local') AS status FROM remote_entities r LEFT JOIN local_entities l ON l.uuid = r.uuid")
def sync_status_of(spark, sf_dir):
    """The status of each uuid; one that is not known is local."""
    known = view(spark, sf_dir, "local_entities").select("uuid", F.when(F.col("dirty"), "local").otherwise("synced").alias("status"))
    return sync.status_of(view(spark, sf_dir, "remote_entities"), known)


@query("""SELECT uuid, CASE WHEN NOT dirty THEN 'synced' WHEN uuid % 5 = 0 THEN 'local' WHEN taken THEN 'synced' ELSE 'local' END AS status
    FROM (SELECT l.*, r.uuid IS NOT NULL AS taken FROM local_entities l LEFT JOIN remote_entities r ON r.uuid = l.uuid)""")
def sync_round(spark, sf_dir):
    """One round on a mobile network: blobs stay, of the others those are synced that the remote took."""
    rows = view(spark, sf_dir, "local_entities").select("uuid", F.when(F.col("dirty"), "local").otherwise("synced").alias("status"), (F.col("uuid") % 5 == 0).alias("is_blob"))
    return sync.round_of(rows, view(spark, sf_dir, "remote_entities"), online=True, wifi=False).select("uuid", "status")


@query("SELECT uuid, updated_at FROM (SELECT *, CASE WHEN uuid % 3 <> 0 THEN uuid % 4 END AS owner_id FROM remote_entities) WHERE updated_at > 80 AND (owner_id = 2 OR owner_id IS NULL) ORDER BY updated_at, uuid")
def sync_delta_pull_owner(spark, sf_dir):
    owner = F.when(F.col("uuid") % 3 != 0, F.col("uuid") % 4)
    return sync.changed_since(view(spark, sf_dir, "remote_entities").withColumn("owner_id", owner), 80, owner=2).select("uuid", "updated_at")


@query("""SELECT o_custkey AS uuid, max(o_orderdate) AS updated_at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS payload FROM orders GROUP BY o_custkey""")
def ent_upsert_repeated(spark, sf_dir):
    """A bulk upsert that has most keys several times: the last update of each stays."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uuid"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("payload"))
    return store.merged(rows.limit(0), rows)


# Edges -------------------------------------------------------------------------------


@query("SELECT source_uuid, target_uuid, edge_type FROM edges WHERE source_uuid = 'n:3' AND edge_type = 'child_of' AND target_uuid = (SELECT concat('r:', CAST(n_regionkey AS VARCHAR)) FROM nation WHERE n_nationkey = 3)")
def edge_find(spark, sf_dir):
    """The first edge of a type between two entities."""
    edges = view(spark, sf_dir, "edges")
    target = table(spark, sf_dir, "nation").filter("n_nationkey = 3").select(F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("target_uuid"))
    return finders.edge_of(edges.join(target, "target_uuid", "left_semi"), "n:3", None, "child_of").select(edges.columns)


@query("""SELECT source_uuid, target_uuid, edge_type, seq FROM part_edges ANTI JOIN (SELECT DISTINCT source_uuid, target_uuid, edge_type FROM part_edges WHERE seq % 3 = 0) USING (source_uuid, target_uuid, edge_type)""")
def edge_delete_by_key(spark, sf_dir):
    edges = view(spark, sf_dir, "part_edges")
    return graph.without_edges(edges, edges.filter("seq % 3 = 0"))


@query("""SELECT 'order' AS source_type, CAST(o_orderkey AS VARCHAR) AS source_uuid, 'customer' AS target_type, CAST(o_custkey AS VARCHAR) AS target_uuid, 'references' AS edge_type FROM orders""")
def edge_factory(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("source_uuid"), F.col("o_custkey").cast("string").alias("target_uuid"))
    return graph.edges_between(rows, "order", "customer", "references")


# Search ------------------------------------------------------------------------------


@query(f"""WITH hits AS (SELECT e.vec_id, {_COSINE} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 11 ORDER BY s DESC, e.vec_id LIMIT 10)
    SELECT vec_id AS item_id, d.source, round(s, 6) AS similarity FROM hits JOIN documents d ON d.doc_id = vec_id * 3""")
def vec_search_entities(spark, sf_dir):
    """The k best, then their entities; hits without one are dropped."""
    items = _items(spark, sf_dir)
    hits = search.nearest(items, _vector(items, 11), k=10)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), "source")
    found = docs.join(F.broadcast(hits), F.col("doc_id") == F.col("item_id") * 3)  # ten rows
    return found.select("item_id", "source", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query(f"""WITH hits AS (SELECT e.vec_id, e.label, {_COSINE} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 5 AND e.label = 2 ORDER BY s DESC, e.vec_id LIMIT 10)
    SELECT vec_id AS id, d.doc_id AS entity_id, d.source, round(1 - s, 6) AS distance FROM hits JOIN documents d ON d.doc_id = vec_id % 150""")
def vec_chunk_search(spark, sf_dir):
    """The nearest chunks of one type of entity, with their entities."""
    items = _items(spark, sf_dir)
    stored = items.select(F.col("item_id").alias("id"), (F.col("item_id") % 150).alias("entity_id"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("entity_type"), "vector")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), "source")
    return search.nearest_chunks(stored, docs, _vector(items, 5), 10, "t2").select("id", "entity_id", "source", F.round("distance", 6).alias("distance"))


@query(f"""SELECT e.vec_id AS item_id, round(1 - {_COSINE}, 6) AS distance, (SELECT round(list_sum(CAST(embedding AS DOUBLE[])), 6) FROM embeddings WHERE vec_id = 9) AS query_sum
    FROM embeddings e, embeddings q WHERE q.vec_id = 9 ORDER BY 1 - {_COSINE}, e.vec_id LIMIT 5""")
def vec_search_with_query(spark, sf_dir):
    """Results together with the vector they were searched by (its sum stands for it)."""
    items = _items(spark, sf_dir)
    found, vector = search.search_text(items, "9", 5, provider=lambda text: _vector(items, int(text)))
    return found.select("item_id", F.round("distance", 6).alias("distance"), F.round(F.lit(sum(vector)), 6).alias("query_sum"))


@query(f"""SELECT e.vec_id AS item_id, round(abs({_COSINE}), 5) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 2 AND e.vec_id <> 2""")
def vec_similarity_strict(spark, sf_dir):
    """Similarities from distances, an error outside 0..1 (here of absolute cosines, which never are)."""
    items = _items(spark, sf_dir)
    q = F.array(*(F.lit(x) for x in _vector(items, 2)))
    cosine = F.abs(V.cosine_similarity(V.doubles(F.col("vector")), V.doubles(q)))
    return items.filter("item_id <> 2").select("item_id", F.round(V.similarity(1 - cosine), 5).alias("similarity"))
