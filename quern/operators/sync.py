"""Merging local and remote copies of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both(local: DataFrame, remote: DataFrame) -> DataFrame:
    mark = lambda df, n: df.select("uuid", F.struct("payload", "updated_at").alias(n))
    return mark(local, "l").join(mark(remote, "r"), "uuid", "full_outer")


def last_writer_wins(local: DataFrame, remote: DataFrame) -> DataFrame:
    """uuid, payload, updated_at, side: the newer copy; of equally old ones the remote."""
    newer = F.col("r").isNull() | F.coalesce(F.col("l.updated_at") > F.col("r.updated_at"), F.lit(False))
    return _chosen(_both(local, remote), newer)


def pulled(local: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of `local` after `changes` (each uuid once): the newer copy whole, of equally old ones the changed.

    The same rows as `last_writer_wins` gives, for any columns; what was merged before
    changes nothing when it comes again.
    """
    known = local.select("uuid", F.col("updated_at").alias("__known"))
    newer = changes.join(known, "uuid", "left").filter("__known IS NULL OR NOT coalesce(__known > updated_at, false)").drop("__known")
    return local.join(newer.select("uuid"), "uuid", "left_anti").unionByName(newer, allowMissingColumns=True)


def resolved(local: DataFrame, remote: DataFrame, keep: str) -> DataFrame:
    """Every conflict decided for one side, whatever the clocks say."""
    if keep not in ("local", "remote"):
        raise ValueError("keep is local or remote")
    return _chosen(_both(local, remote), F.col("l").isNotNull() if keep == "local" else F.col("r").isNull())


def _chosen(both: DataFrame, local: Column) -> DataFrame:
    side = F.when(local, F.col("l")).otherwise(F.col("r"))
    return both.select("uuid", side["payload"].alias("payload"), side["updated_at"].alias("updated_at"), F.when(local, "local").otherwise("remote").alias("side"))


def changed_since(rows: DataFrame, since, owner=None) -> DataFrame:
    """The delta pull: everything updated after `since`, deleted rows too, oldest first.

    owner: only this owner's rows and those without an owner.
    """
    if owner is not None:
        rows = rows.filter((F.col("owner_id") == owner) | F.col("owner_id").isNull())
    return rows.filter(F.col("updated_at") > since).orderBy("updated_at", "uuid")


def live(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of a type that are not deleted, the latest first."""
    return rows.filter((F.col("type") == kind) & ~F.col("deleted")).orderBy(F.col("updated_at").desc(), "uuid")


def status_of(wanted: DataFrame, statuses: DataFrame) -> DataFrame:
    """uuid, status of each wanted uuid; one that is not known is local."""
    known = statuses.groupBy("uuid").agg(F.max("status").alias("status"))
    return wanted.select("uuid").join(known, "uuid", "left").withColumn("status", F.coalesce("status", F.lit("local")))


def round_of(rows: DataFrame, confirmed: DataFrame, online: bool = True, wifi: bool = True) -> DataFrame:
    """Rows (uuid, status, is_blob) after a round of sync: local -> syncing -> synced, or local again.

    Offline nothing moves; blobs move on wifi only. `confirmed` (uuid) are those that the
    remote took; the others of the round wait for the next.
    """
    if not online:
        return rows
    moves = (F.col("status") == "local") & (~F.col("is_blob") | F.lit(wifi))
    took = confirmed.select("uuid").distinct().withColumn("took", F.lit(True))
    both = rows.withColumn("status", F.when(moves, "syncing").otherwise(F.col("status"))).join(took, "uuid", "left")
    done = F.when(F.col("took"), "synced").otherwise("local")
    return both.withColumn("status", F.when(F.col("status") == "syncing", done).otherwise(F.col("status"))).drop("took")


def to_push(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Dirty local rows that the remote lacks or has in an older version."""
    other = remote.select("uuid", F.col("updated_at").alias("theirs"))
    dirty = local.filter("dirty").join(other, "uuid", "left")
    return dirty.filter(F.col("theirs").isNull() | (F.col("updated_at") > F.col("theirs"))).drop("theirs")
