"""Pulling what has changed elsewhere into a store, so that a repeated pull changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import sync
from ..sources.store import EntityStore, Transaction, unique

#: The table of a store that says how far each pull has come.
CURSORS = "sync_cursors"


def merge(transaction: Transaction, name: str, changes: DataFrame) -> None:
    """Merges changes (uuid, updated_at and others) into a table; the newer copy of each uuid stays."""
    transaction.combine(name, unique(changes), sync.pulled)


def pull_stream(changes: DataFrame, store: EntityStore, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Merges a stream of changes batch by batch. A batch that is run again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        store._tried(name, lambda t: merge(t, name, batch))

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pull_once(remote: DataFrame, store: EntityStore, name: str) -> int:
    """Merges the rows of `remote` (uuid, a long updated_at and others) from the last pull on; how many these were.

    The cursor, the greatest updated_at seen, is written in the same transaction. Rows as
    old as it are read again: some may have come later, and merging them twice is harmless.
    """

    def write(transaction: Transaction) -> int:
        seen = transaction.find(CURSORS, name).first() if CURSORS in transaction.tables() else None
        changes = remote if seen is None else remote.filter(F.col("updated_at") >= seen["updated_at"])
        n, last = changes.agg(F.count("*"), F.max("updated_at").cast("long")).first()
        if last is not None:
            merge(transaction, name, changes)
            transaction.save(CURSORS, store.spark.createDataFrame([(name, last)], "uuid string, updated_at long"))
        return n

    return store._tried(name, write)
