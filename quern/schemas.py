"""Typed schemas of the entity tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

_BASE = "id BIGINT, uuid STRING NOT NULL, created_at TIMESTAMP, updated_at TIMESTAMP, sync_id STRING, sync_status STRING"

_COLUMNS = {
    "invocations": "correlation_id STRING, component_type STRING, turn_id STRING, success BOOLEAN, confidence DOUBLE, input STRING, output STRING, metadata STRING",
    "turns": "correlation_id STRING, conversation_id STRING, timestamp TIMESTAMP, stt_invocation_id STRING, llm_invocation_id STRING, tts_invocation_id STRING, result STRING, error_message STRING, failure_component STRING, latency_ms BIGINT, marked_for_feedback BOOLEAN, marked_at TIMESTAMP, feedback_trained_at TIMESTAMP",
    "feedback": "invocation_id STRING, component_type STRING, turn_id STRING, action STRING, corrected_data STRING, reason STRING, timestamp TIMESTAMP",
    "adaptation_state": "component_type STRING, scope STRING, user_id STRING, data STRING, version BIGINT, last_updated_at TIMESTAMP, last_update_reason STRING, feedback_count_applied BIGINT",
    "events": "correlation_id STRING, parent_event_id STRING, source STRING, timestamp TIMESTAMP, payload STRING",
    "edges": "source_type STRING, source_uuid STRING, target_type STRING, target_uuid STRING, edge_type STRING, metadata STRING, created_by STRING",
    "entity_versions": "entity_type STRING, entity_uuid STRING, version_number BIGINT, delta STRING, changed_fields ARRAY<STRING>, is_snapshot BOOLEAN, snapshot STRING, user_id STRING, change_description STRING",
}
_PLAIN = {
    "system_events": "event_type STRING, correlation_id STRING, created_at TIMESTAMP, json_data STRING",
    "chunks": "id STRING, source_entity_id STRING, source_entity_type STRING, start_token INT, end_token INT, config STRING, text STRING, embedding ARRAY<DOUBLE>",
    "entities": "uuid STRING, type STRING, data STRING, created_at TIMESTAMP, updated_at TIMESTAMP, owner_id STRING, deleted_at TIMESTAMP",
    "blob_metadata": "uuid STRING, entity_uuid STRING, storage_path STRING, filename STRING, content_type STRING, size_bytes BIGINT, created_at TIMESTAMP, owner_id STRING",
    "embedding_tasks": "id BIGINT, entity_uuid STRING, entity_type STRING, text STRING, status STRING, retry_count INT, enqueued_at TIMESTAMP, last_attempt_at TIMESTAMP, last_error STRING",
}

NAMES = (*_COLUMNS, *_PLAIN)


def schema(name: str) -> StructType:
    """The schema of an entity table (needs a session, which parses it)."""
    return StructType.fromDDL(f"{_BASE}, {_COLUMNS[name]}" if name in _COLUMNS else _PLAIN[name])
