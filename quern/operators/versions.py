"""Version history: numbering, snapshots, differences, time travel, pruning."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patches

FREQUENCY = 20


def is_snapshot(number: Column, frequency: int | None = FREQUENCY) -> Column:
    """The first version, and then every `frequency`-th after it; None: the first never."""
    if frequency is None:
        return F.lit(False)
    return (number == 1) | (number % frequency == 1)


def latest(versions: DataFrame, *columns: str) -> DataFrame:
    """Each entity's row with the highest number."""
    last = F.max_by(F.struct(*columns), "version_number").alias("row")
    return versions.groupBy("entity_uuid").agg(F.max("version_number").alias("version_number"), last).select("entity_uuid", "version_number", "row.*")


def numbered(states: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """States (entity_uuid, created_at, state JSON) as versions after those stored.

    Adds version_number, delta (JSON operations), changed_fields, is_snapshot, snapshot.
    `stored` has the last version_number and state of each entity.
    """
    w = Window.partitionBy("entity_uuid").orderBy("created_at", "state")
    rows = states.withColumns({"n": F.row_number().over(w), "before": F.lag("state").over(w)})
    base = F.lit(0)
    if stored is not None:
        last = stored.select("entity_uuid", F.col("version_number").alias("base"), F.col("state").alias("base_state"))
        rows = rows.join(last, "entity_uuid", "left")
        base = F.coalesce("base", F.lit(0))
        rows = rows.withColumn("before", F.coalesce("before", "base_state"))
    number = F.col("n") + base
    rows = rows.withColumn("version_number", number)
    snap = is_snapshot(F.col("version_number"))
    return rows.select(
        "entity_uuid", "version_number", "created_at", patches.json_diff(F.col("before"), F.col("state")).alias("delta"),
        patches.changed_fields(F.col("before"), F.col("state")).alias("changed_fields"), snap.alias("is_snapshot"), F.when(snap, F.col("state")).alias("snapshot"),
    )


def nearest_snapshot(versions: DataFrame, frequency: int = FREQUENCY) -> DataFrame:
    """Adds snapshot_number: the last snapshot at or before each version."""
    w = Window.partitionBy("entity_uuid").orderBy("version_number")
    flag = F.when(is_snapshot(F.col("version_number"), frequency), F.col("version_number"))
    return versions.withColumn("snapshot_number", F.last(flag, ignorenulls=True).over(w))


def reconstruct(versions: DataFrame, at: Column) -> DataFrame:
    """entity_uuid, state of each entity as of a time: its last snapshot, then later deltas.

    Entities without a version by then are left out. Only the versions from the snapshot
    on reach the fold, at most as many as lie between two snapshots.
    """
    known = versions.filter(F.col("created_at") <= at)
    base = known.filter("is_snapshot").groupBy("entity_uuid").agg(F.max("version_number").alias("base"))
    parts = known.join(base, "entity_uuid").filter(F.col("version_number") >= F.col("base"))
    item = F.struct("version_number", "snapshot", "delta", (F.col("version_number") == F.col("base")).alias("first"))
    grouped = parts.groupBy("entity_uuid").agg(F.array_sort(F.collect_list(item)).alias("parts"))

    @F.pandas_udf("string")
    def folded(lists: pd.Series) -> pd.Series:
        out = []
        for steps in lists:
            state = None
            for s in steps:
                state = json.loads(s["snapshot"]) if s["first"] else patches.apply(state, json.loads(s["delta"]))
            out.append(json.dumps(state, sort_keys=True))
        return pd.Series(out)

    return grouped.select("entity_uuid", folded("parts").alias("state"))


def pruned(versions: DataFrame, keep: int, frequency: int = FREQUENCY) -> DataFrame:
    """Versions from the `keep`-th last snapshot on; all, where there are no more than that."""
    if keep < 1:
        raise ValueError("at least one snapshot must be kept")
    snaps = versions.filter(is_snapshot(F.col("version_number"), frequency))
    rank = F.row_number().over(Window.partitionBy("entity_uuid").orderBy(F.col("version_number").desc()))
    newest = snaps.select("entity_uuid", "version_number", rank.alias("rank")).filter(F.col("rank") <= keep + 1)  # cut before the shuffle
    oldest = newest.groupBy("entity_uuid").agg(F.min(F.when(F.col("rank") <= keep, F.col("version_number"))).alias("oldest"), F.count("*").alias("n"))
    joined = versions.join(oldest, "entity_uuid", "left")
    return joined.filter((F.coalesce("n", F.lit(0)) <= keep) | (F.col("version_number") >= F.col("oldest"))).select(versions.columns)
