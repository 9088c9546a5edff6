"""Whole tables through the entity store, its hooks and transactions, the blob store and the tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tools
from ..errors import PersistenceError
from ..functions import texts, vectors
from ..operators import chunks, search
from ..operators.tables import shared_folder
from ..sources.store import BlobStore, EntityStore
from ..sources.views import table, view
from .registry import query
from .texts import _chunk_sql


def _store(spark) -> EntityStore:
    return EntityStore(spark, shared_folder(spark))


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uuid"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"))


def _customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uuid"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("balance"))


@query("""SELECT 'before' AS seen, 'orders' AS name, o_orderkey AS uuid, o_orderstatus AS status FROM orders UNION ALL SELECT 'before', 'customers', c_custkey, c_mktsegment FROM customer
    UNION ALL SELECT 'within', 'orders', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE o_orderstatus END FROM orders
    UNION ALL SELECT 'after', 'orders', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE o_orderstatus END FROM orders UNION ALL SELECT 'after', 'customers', c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 0""")
def store_transaction(spark, sf_dir):
    """Two tables changed in one transaction, as a snapshot from before, the transaction itself and later readers see them.

    A second transaction, which clears a table, fails before it is committed and leaves nothing.
    """
    store = _store(spark)
    store.save("orders", _orders(spark, sf_dir))
    store.save("customers", _customers(spark, sf_dir))
    before = store.snapshot()
    one = store.transaction()
    one.save("orders", _orders(spark, sf_dir).filter("uuid % 3 = 0").withColumn("status", F.lit("closed")))
    one.delete_where("customers", F.col("balance") < 0)
    within = one.read("orders")
    one.commit()
    other = store.transaction()
    try:
        other.clear("orders")
        other.insert("customers", _customers(spark, sf_dir))  # keys that are there
        other.commit()
    except PersistenceError:
        pass
    after = store.snapshot()
    named = lambda seen, name, rows: rows.select(F.lit(seen).alias("seen"), F.lit(name).alias("name"), "uuid", "status")
    out = named("within", "orders", within)
    for seen, snapshot in (("before", before), ("after", after)):
        for name in ("orders", "customers"):
            out = out.unionByName(named(seen, name, snapshot.read(name)))
    return out


@query("""SELECT 'orders' AS name, o_orderkey AS uuid, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2024-02-02 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS updated_at
    FROM orders WHERE o_custkey % 4 <> 0
    UNION ALL SELECT 'versions', o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2024-02-02 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END FROM orders
    UNION ALL SELECT 'gone', o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2024-02-02 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END FROM orders WHERE o_custkey % 4 = 0""")
def store_hooks(spark, sf_dir):
    """Saves that set updated_at, change rows before and copy them afterwards, and a delete whose rows a hook keeps."""
    store = _store(spark)
    at = lambda day: F.lit(f"2024-02-0{day} 00:00:00").cast("timestamp_ntz")
    copied = {"version": lambda rows: store.save("versions", rows)}
    store.save("orders", _orders(spark, sf_dir), touch=at(1), handlers=copied)
    store.save("orders", _orders(spark, sf_dir).filter("uuid % 5 = 0"), touch=at(2), before=[lambda rows: rows.withColumn("status", F.lit("new"))], handlers=copied)
    store.delete("orders", _orders(spark, sf_dir).filter("owner % 4 = 0"), after=[lambda gone: store.save("gone", gone)])
    named = [store.read(n).select(F.lit(n).alias("name"), "uuid", "status", "updated_at") for n in ("orders", "versions", "gone")]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("""SELECT event_id AS uuid, event_type FROM events WHERE user_id % 3 <> 0 OR event_id % 10 = 0""")
def store_event_log(spark, sf_dir):
    """A log that grows by batches and loses the events of some correlations; it is then cleared, and a batch comes again."""
    store = _store(spark)
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("uuid"), "user_id", "event_type")
    again = events.filter("uuid % 10 = 0")
    store.insert("events", events.filter("uuid % 2 = 0"))
    store.insert("events", events.filter("uuid % 2 <> 0"))
    store.delete_where("events", F.col("user_id") % 3 == 0)
    left = store.read("events")
    store.clear("events")
    store.insert("events", again)
    return left.join(store.read("events").select("uuid"), "uuid", "left_anti").unionByName(store.read("events")).select("uuid", "event_type")


@query("""SELECT doc_id AS uuid, strlen(text) AS size, sha256(text) AS digest FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'over' || text ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)""")
def store_blobs(spark, sf_dir):
    """Contents written, a quarter of them written over, a fifth deleted."""
    blobs = BlobStore(_store(spark))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uuid"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    blobs.save(docs)
    blobs.save(docs.filter("uuid % 4 = 0").select("uuid", F.concat(F.lit("over").cast("binary"), "content").alias("content")))
    blobs.delete(docs.filter("uuid % 5 = 0"))
    return blobs.load(docs).select("uuid", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"))


@query("""SELECT o_orderkey AS uuid, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 + 1 ELSE o_orderkey % 4 END AS version, o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0 AS refused FROM orders""")
def store_swap(spark, sf_dir):
    """Compare and set in a store: even keys with the version that is stored, some odd ones with another."""
    store = _store(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uuid"), (F.col("o_orderkey") % 4).alias("version"))
    store.save("orders", rows)
    wrong = rows.filter("uuid % 2 <> 0 AND uuid % 3 = 0").withColumn("version", F.col("version") + 7)
    refused = store.swap("orders", rows.filter("uuid % 2 = 0").unionByName(wrong)).select("uuid", F.lit(True).alias("refused"))
    return store.read("orders").join(refused, "uuid", "left").select("uuid", "version", F.coalesce("refused", F.lit(False)).alias("refused"))


@query("""SELECT 'create' AS call, 'task.create' AS tool, true AS success, 1 AS rows, NULL AS error UNION ALL SELECT 'untitled', 'task.create', false, NULL, 'ValueError: missing: title'
    UNION ALL SELECT 'complete', 'task.complete', true, 1, NULL UNION ALL SELECT 'unknown', 'task.complete', false, NULL, 'ValueError: there is no task none'
    UNION ALL SELECT 'nowhere', 'task.burn', false, NULL, 'KeyError: ''task.burn''' UNION ALL SELECT 'all', 'task.list', true, (SELECT count(*) + 1 FROM tasks), NULL
    UNION ALL SELECT 'completed', 'task.list', true, (SELECT count(*) + 1 FROM tasks WHERE completed), NULL""")
def tool_calls(spark, sf_dir):
    """Calls of the task tools over the stored tasks; one task is created, an open one completed; failures are rows."""
    store, registry = _store(spark), tools.ToolRegistry()
    tasks = view(spark, sf_dir, "tasks")
    store.save("tasks", tasks.select(F.col("uuid").cast("string").alias("uuid"), F.lit("t").alias("title"), "priority", "due_date", F.lit("").alias("description"), "completed"))
    tools.register_tasks(registry, store, F.lit("2001-08-02 00:00:00").cast("timestamp_ntz"))
    open_ = str(tasks.filter("NOT completed").agg(F.min("uuid")).first()[0])
    calls = {
        "create": ("task.create", {"title": "new"}),
        "untitled": ("task.create", {"priority": "high"}),
        "complete": ("task.complete", {"taskId": open_}),
        "unknown": ("task.complete", {"taskId": "none"}),
        "nowhere": ("task.burn", {}),
        "all": ("task.list", {}),
        "completed": ("task.list", {"filter": "completed"}),
    }
    out = None
    for name, call in calls.items():
        row = registry.execute(spark, [call]).select(F.lit(name).alias("call"), "tool", "success", "rows", "error")
        out = row if out is None else out.unionByName(row)
    return out


# Texts and vectors ---------------------------------------------------------------------


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN [1.0::DOUBLE] WHEN length(text) % 2 = 0 THEN [CAST(length(text) AS DOUBLE)] ELSE list_transform(range(384), lambda x: 0.0::DOUBLE) END AS embedding FROM documents")
def ent_embed_missing(spark, sf_dir):
    """Embeddings for the rows that have none, by a provider that gives odd lengths the zero vector."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1.0))).alias("embedding"))
    provider = lambda text: F.when(F.length(text) % 2 == 0, F.array(F.length(text).cast("double"))).otherwise(vectors.zeros(384))
    return search.rebuilt(rows, provider).select("id", "embedding")


@query(r"""SELECT doc_id, len(parts) >= 2 AND len(list_filter(parts, lambda s: regexp_matches(s, '[.!?]$'))) < 0.05 * len(parts) AS unstructured FROM (SELECT doc_id,
    list_filter(list_transform(string_split(regexp_replace(text, '(^\.|[!?]|[^A-Za-z0-9]\.)\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS parts FROM documents)""")
def txt_unstructured(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.unstructured(F.col("text")).alias("unstructured"))


@query("SELECT event_id, concat_ws('|', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), event_type) AS key, concat('https://example.org/', event_type, '/', event_id) AS url FROM events")
def edge_keys(spark, sf_dir):
    """Composite keys, and urls joined with one slash whatever both sides bring."""
    path = F.concat(F.repeat(F.lit("/"), (F.col("event_id") % 3).cast("int")), "event_type", F.lit("/"), F.col("event_id").cast("string"))
    base = F.concat(F.lit("https://example.org"), F.repeat(F.lit("/"), (F.col("event_id") % 2).cast("int")))
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", texts.composite_key(F.col("user_id"), F.col("event_id"), F.col("event_type")).alias("key"), texts.joined_url(base, path).alias("url"))


_PARENTS = f"""WITH RECURSIVE p_source AS (SELECT doc_id AS key, {{}} AS text FROM documents), {_chunk_sql("p", chunks.PARENT)}"""


@query(_PARENTS.format("coalesce(text, '')") + " SELECT key AS id, ordinal, start_token, end_token, text FROM p_chunks")
def txt_chunks_lateral(spark, sf_dir):
    """Chunks by the table function of SQL."""
    chunks.register_functions(spark)
    sql = "SELECT d.doc_id AS id, c.ordinal, c.start_token, c.end_token, c.text FROM {docs} d, LATERAL text_chunks(d.text, 'parent') c"
    return spark.sql(sql, docs=table(spark, sf_dir, "documents"))


@query(_PARENTS.format("CASE WHEN doc_id % 4 = 0 THEN concat('Changed. ', text) ELSE coalesce(text, '') END") + " SELECT key AS id, ordinal, start_token, end_token, text FROM p_chunks")
def txt_reindexed(spark, sf_dir):
    """An index of chunks in which those of changed texts have been replaced; parents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    changed = docs.filter("id % 4 = 0").withColumn("text", F.concat(F.lit("Changed. "), "text"))
    return chunks.reindexed(chunks.parents(docs), changed, make=chunks.parents).select("id", "ordinal", "start_token", "end_token", "text")
