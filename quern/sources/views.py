"""Domain tables as views over the stored tables.

Each view is SQL that Spark and DuckDB read alike, so that a query and its check start
from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name: SELECT over the stored tables (or over earlier views).
VIEWS = {
    "invocations": """SELECT event_id AS uuid, event_type AS component_type, user_id AS correlation_id,
        event_type <> 'error' AS success, value AS confidence, props AS metadata, ts AS created_at FROM events""",
    "turns": """SELECT conv_id * 1000 + turn AS uuid, conv_id AS conversation_id, turn AS seq, role,
        CASE WHEN role = 'user' THEN conv_id * 1000 + turn + 1000000000 END AS stt_id,
        CASE WHEN role = 'assistant' THEN conv_id * 1000 + turn + 2000000000 END AS llm_id,
        CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN conv_id * 1000 + turn + 3000000000 END AS tts_id,
        CASE WHEN length(text) % 7 = 0 THEN 'error' ELSE 'success' END AS result,
        CASE WHEN length(text) % 7 = 0 THEN 'llm' END AS failure_component,
        turn % 3 = 0 AS marked_for_feedback, CASE WHEN turn % 6 = 0 THEN conv_id * 10 + turn END AS marked_at FROM conversations""",
    "feedback": """SELECT l.doc_id AS invocation_id, d.source AS component_type,
        CASE WHEN l.doc_id % 2 = 0 THEN l.doc_id % 100 END AS turn_id,
        CASE WHEN l.quality = 0 THEN 'correct' WHEN l.toxic = 1 THEN 'deny' ELSE 'confirm' END AS action,
        CASE WHEN l.quality = 0 AND l.doc_id % 7 <> 0 THEN d.lang END AS corrected,
        CASE WHEN l.doc_id % 3 = 0 THEN 'fr' ELSE d.lang END AS selected, l.quality, l.toxic, l.doc_id AS seq
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "channels": """SELECT s_suppkey AS uuid, s_name AS name, concat('yt', CAST(s_suppkey AS VARCHAR(20))) AS youtube_id,
        s_suppkey % 3 <> 0 AS subscribed, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 7 END AS hours_since_check,
        s_suppkey % 45 AS days_since_added FROM supplier""",
    "media_items": """SELECT doc_id AS uuid, text AS title, source AS channel_id, n_chars AS size_bytes,
        CASE lang WHEN 'en' THEN 'mp3' WHEN 'de' THEN 'mp4' WHEN 'fr' THEN 'WEBM' ELSE 'm4a' END AS format,
        CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'downloading' WHEN 2 THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN doc_id % 5 > 2 AND doc_id % 4 <> 0 THEN doc_id + 500 END AS blob_id, doc_id % 30 AS days_since FROM documents""",
    "downloads": """SELECT o_orderkey AS uuid, concat('v', CAST(o_custkey AS VARCHAR(20))) AS video_id,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'downloading' ELSE 'processing' END END AS status,
        CASE WHEN o_orderkey % 2 = 0 THEN 'mp3' ELSE 'MP4' END AS format, o_orderkey % 6 AS retry_count, 3 AS max_retries,
        CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 11 <> 0 THEN o_orderdate END AS finished_at FROM orders""",
    "tasks": """SELECT o_orderkey AS uuid, o_custkey AS owner_id, o_orderstatus = 'F' AS completed,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority,
        CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS due_date FROM orders""",
    "timers": """SELECT event_id AS uuid, event_type AS label, ts AS created_at,
        CASE WHEN event_type = 'purchase' THEN ts END AS fired_at, event_type IN ('purchase', 'error') AS fired,
        event_type = 'error' AS cancelled, ts AS ends_at FROM events""",
    "subscriptions": """SELECT c_custkey AS uuid, c_name AS name, c_mktsegment AS source_type, c_acctbal > 0 AS active,
        concat('https://feed.example.com/', CAST(c_custkey AS VARCHAR(20))) AS source_url,
        CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 48 END AS hours_since_check FROM customer""",
    "edges": """SELECT concat('n:', CAST(n_nationkey AS VARCHAR(20))) AS source_uuid, concat('r:', CAST(n_regionkey AS VARCHAR(20))) AS target_uuid, 'child_of' AS edge_type FROM nation
        UNION ALL SELECT concat('c:', CAST(c_custkey AS VARCHAR(20))), concat('n:', CAST(c_nationkey AS VARCHAR(20))), 'belongs_to' FROM customer
        UNION ALL SELECT concat('s:', CAST(s_suppkey AS VARCHAR(20))), concat('n:', CAST(s_nationkey AS VARCHAR(20))), 'belongs_to' FROM supplier
        UNION ALL SELECT concat('o:', CAST(o_orderkey AS VARCHAR(20))), concat('c:', CAST(o_custkey AS VARCHAR(20))), 'references' FROM orders""",
    "part_edges": """SELECT concat('p:', CAST(l_partkey AS VARCHAR(20))) AS source_uuid, concat('s:', CAST(l_suppkey AS VARCHAR(20))) AS target_uuid,
        'related_to' AS edge_type, l_orderkey * 10 + l_linenumber AS seq FROM lineitem""",
    "versions": """SELECT user_id AS entity_uuid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_number,
        event_type, value, ts AS created_at, event_id FROM events""",
    "local_entities": """SELECT o_orderkey AS uuid, o_totalprice AS payload, o_orderkey % 100 AS updated_at, o_orderkey % 4 = 0 AS dirty FROM orders WHERE o_orderkey % 10 <> 0""",
    "remote_entities": """SELECT o_orderkey AS uuid, o_totalprice + 1 AS payload, (o_orderkey * 7) % 100 AS updated_at, o_orderkey % 17 = 0 AS deleted,
        o_orderstatus AS type FROM orders WHERE o_orderkey % 10 <> 1""",
    "adaptation": """SELECT s_nationkey AS component, CASE WHEN s_suppkey % 3 = 0 THEN 'global' ELSE 'user' END AS scope,
        CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 5 END AS user_id, s_suppkey AS version, s_acctbal AS data FROM supplier""",
    "namespaces": """SELECT DISTINCT p_brand AS namespace, concat(p_brand, '.', replace(p_type, ' ', CASE WHEN p_size % 5 = 0 THEN '.' ELSE '_' END)) AS tool FROM part""",
    "owned": """SELECT o_orderkey AS uuid, o_custkey AS owner_id, CASE WHEN o_orderkey % 9 = 0 THEN 'public' ELSE 'private' END AS visibility,
        CASE WHEN o_orderkey % 8 = 0 THEN 7 ELSE o_custkey % 50 END AS shared_with FROM orders""",
    "turn_invocations": """SELECT conv_id * 1000 + turn + 1000000000 AS uuid, 'stt' AS component_type, conv_id * 1000 + turn AS turn_id, turn AS seq, length(text) % 11 <> 0 AS success FROM conversations WHERE role = 'user'
        UNION ALL SELECT conv_id * 1000 + turn + 2000000000, 'llm', conv_id * 1000 + turn, turn, length(text) % 5 <> 0 FROM conversations WHERE role = 'assistant'
        UNION ALL SELECT conv_id * 1000 + turn + 3000000000, 'tts', conv_id * 1000 + turn, turn, true FROM conversations WHERE role = 'assistant'""",
    "component_invocations": """SELECT event_id AS uuid, user_id AS correlation_id, ts AS created_at, CASE event_id % 9 WHEN 0 THEN 'stt' WHEN 1 THEN 'tts' WHEN 2 THEN 'namespace_selector' WHEN 3 THEN 'tool_selector'
        WHEN 4 THEN 'context_injector' WHEN 5 THEN 'llm_config_selector' WHEN 6 THEN 'llm_orchestrator' WHEN 7 THEN 'response_renderer' ELSE 'other' END AS component_type FROM events""",
    "chained_events": """SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN event_id - 1 WHEN event_id % 12 = 6 THEN -event_id END AS parent_event_id FROM events""",
    "embedding_tasks": """SELECT event_id AS id, concat('e', CAST(user_id AS VARCHAR(20))) AS entity_uuid, event_type AS entity_type, CASE WHEN event_id % 10 = 0 THEN '' ELSE props END AS text,
        CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status, event_id % 5 AS retry_count,
        CASE WHEN event_id % 4 <> 0 THEN ts END AS last_attempt_at FROM events""",
    "stored_chunks": """SELECT doc_id AS id, concat('k', CAST(doc_id AS VARCHAR(20))) AS chunk_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS embedding FROM documents""",
    "blob_metadata": """SELECT doc_id + 500 AS uuid, concat(source, '/', lang) AS storage_path, n_chars AS size_bytes FROM documents WHERE lang <> 'en'""",
    "speech_events": """SELECT event_id, event_id - event_id % 50 AS session, event_id * 400000 + (event_id - event_id % 5) * 380000 + (event_id - event_id % 17) * 1800000 AS at_us,
        CASE WHEN event_id % 13 = 0 THEN 'EndOfTurn' WHEN event_id % 3 = 0 THEN 'Update' ELSE 'Results' END AS kind,
        CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('t', CAST(event_id AS VARCHAR(20))) END AS transcript, event_id % 7 = 0 AS speech_final FROM events""",
    "places": """SELECT c_custkey AS uuid, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey % 180 AS DOUBLE) - 90 END AS lat,
        CAST((c_custkey * 7) % 360 AS DOUBLE) - 180 AS lon FROM customer""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _needs(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a DataFrame; only the columns that are used get read."""
    sql = VIEWS[name]
    return spark.sql(_braced(sql), **{t: table(spark, sf_dir, t) for t in _needs(sql, TABLES)})


def _braced(sql: str) -> str:
    """Table names behind FROM and JOIN as parameters."""
    return re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", sql)


def with_views(sql: str) -> str:
    """`sql` with the views that it names put in front, for a plain SQL engine."""
    found = [f"{n} AS ({VIEWS[n]})" for n in _needs(sql, VIEWS)]
    if not found:
        return sql
    head = "WITH RECURSIVE " if re.match(r"\s*WITH RECURSIVE\b", sql) else "WITH "
    rest = re.sub(r"^\s*WITH (RECURSIVE )?", ", ", sql) if re.match(r"\s*WITH\b", sql) else f" {sql}"
    return head + ", ".join(found) + rest
