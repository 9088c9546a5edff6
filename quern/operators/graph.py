"""Edges between entities: uniqueness, neighbours, traversal, cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Written

KEY = ("source_uuid", "target_uuid", "edge_type")


def first_of_each(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each composite key, the lowest in `order`."""
    rest = [c for c in edges.columns if c not in (*KEY, order)]
    if not rest:  # a plain minimum, which is aggregated in place by hash
        return edges.groupBy(*KEY).agg(F.min(order).alias(order)).select(edges.columns)
    lowest = F.min(F.struct(order, *rest)).alias("row")
    return edges.groupBy(*KEY).agg(lowest).select(*KEY, "row.*").select(edges.columns)


def duplicates(edges: DataFrame, order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(order))
    return edges.withColumn("rank", rank).filter("rank > 1").drop("rank")


def add_unique(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The edges of `new` that neither exist nor come twice."""
    return first_of_each(new.join(existing.select(*KEY), list(KEY), "left_anti"), order)


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select(F.col("source_uuid").alias("a"), F.col("target_uuid").alias("b"))
    back = edges.select(F.col("target_uuid").alias("a"), F.col("source_uuid").alias("b"))
    found = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}
    if direction not in found:
        raise ValueError("direction is outgoing, incoming or both")
    return found[direction]  # repeated edges do no harm: what is reached is made distinct


def traverse(edges: DataFrame, start: str, depth: int = 1, direction: str = "outgoing") -> DataFrame:
    """uuid, depth of what is reachable in at most `depth` (1 to 3) steps, at its least depth.

    Each step joins the last frontier only; nodes seen before are left out by an anti
    join and each frontier is written, so every node is expanded once. The start itself is
    not returned. The result is a written table in the shared folder (`tables.remove` removes it).
    """
    if depth not in (1, 2, 3):
        raise ValueError("depth is 1, 2 or 3")
    steps, held = _steps(edges, direction), Written(edges.sparkSession)
    seen = edges.sparkSession.range(1).select(F.lit(start).alias("uuid"), F.lit(0).alias("depth"))
    found, frontier = [], seen
    for d in range(1, depth + 1):
        front = frontier.select(F.col("uuid").alias("a"))
        reached = steps.join(front, "a").select(F.col("b").alias("uuid")).distinct()
        known = reduce(DataFrame.unionByName, [seen, *found]).select("uuid")
        frontier = held.table(reached.join(known, "uuid", "left_anti").withColumn("depth", F.lit(d)))
        found.append(frontier)
    return held.kept(reduce(DataFrame.unionByName, found)) if depth > 1 else frontier


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that begin or end in `nodes` (uuid); two equi-joins, a loop counts once."""
    ends = nodes.select("uuid").distinct()
    out = edges.join(ends.withColumnRenamed("uuid", "source_uuid"), "source_uuid", "left_semi").select(edges.columns)
    into = edges.join(ends.withColumnRenamed("uuid", "target_uuid"), "target_uuid", "left_semi").select(edges.columns)
    return out.unionByName(into).distinct()


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges left after the nodes and all that touches them are deleted."""
    ends = nodes.select("uuid").distinct()
    left = edges.join(ends.withColumnRenamed("uuid", "source_uuid"), "source_uuid", "left_anti")
    return left.join(ends.withColumnRenamed("uuid", "target_uuid"), "target_uuid", "left_anti").select(edges.columns)


def without_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges left after those with the composite keys are deleted; unknown keys are ignored."""
    return edges.join(keys.select(*KEY).distinct(), list(KEY), "left_anti").select(edges.columns)


def edges_between(rows: DataFrame, source_type: str, target_type: str, edge_type: str) -> DataFrame:
    """Edges of one type from rows (source_uuid, target_uuid) of two kinds of entities."""
    return rows.select(F.lit(source_type).alias("source_type"), "source_uuid", F.lit(target_type).alias("target_type"), "target_uuid", F.lit(edge_type).alias("edge_type"))
