"""Approximate search over a graph of neighbours, kept as tables.

A graph has one row an edge: item_id, neighbour, distance, and at most `degree` edges an
item. It is built from exact neighbours within small blocks of items that lie close along
random directions, and made better by meetings: the neighbours of an item, in both
directions, are compared with each other, and each keeps its nearest. A search goes from
item to neighbour for all queries at once, a join a step. Items and graph are written
tables; all that is held for one item or query has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from . import search
from .tables import Written

#: Items of a block of the first graph, and random directions that they are sorted by.
BLOCK, DIRECTIONS = 256, 4

_EDGES = "item_id long, neighbour long, distance double"


def _nearest_edges(edges: DataFrame, most: int, by: str = "item_id", other: str = "neighbour") -> DataFrame:
    """The `most` nearest of each item's edges, each once."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("distance", other))
    return edges.groupBy("item_id", "neighbour").agg(F.min("distance").alias("distance")).withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def _edge_batch(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(d)], ["item_id", "neighbour", "distance"])


def _within_blocks(degree: int, metric: str):
    """Exact neighbours within blocks of rows that follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = pa.Table.from_batches([batch.slice(at, BLOCK)])
                x, ids = search._matrix(part), np.asarray(part["item_id"])
                q, i, d = search.block_nearest(x, x, degree + 1, metric)
                yield _edge_batch(ids[q][q != i], ids[i][q != i], d[q != i])

    return run


def _direction(dimensions: int, seed: int) -> Column:
    """The item's place along a random direction."""
    axis = np.random.default_rng(seed).normal(size=dimensions)
    return vectors.dot(F.col("vector"), F.array(*(F.lit(float(a)) for a in axis)))


def _companies(edges: DataFrame, rows: DataFrame, degree: int) -> DataFrame:
    """item_id, id, vector: the members of each item's company, one a row, those of an item together.

    A company is the item and its neighbours in both directions, 2 * degree + 1 at most.
    """
    back = _nearest_edges(edges.select(F.col("neighbour").alias("item_id"), F.col("item_id").alias("neighbour"), "distance"), degree)
    members = edges.unionByName(back).select("item_id", F.col("neighbour").alias("id")).distinct().unionByName(rows.select("item_id", F.col("item_id").alias("id")))
    return members.join(rows.withColumnRenamed("item_id", "id"), "id").select("item_id", "id", "vector").repartition("item_id").sortWithinPartitions("item_id", "id")


def _met(degree: int, metric: str):
    """Edges between the members of each company, the nearest `degree` of each member.

    What is held is one batch of members and a company that goes on in the next one.
    """

    def edges(part: pa.Table) -> pa.RecordBatch:
        of, ids, x, out = np.asarray(part["item_id"]), np.asarray(part["id"]), search._matrix(part), []
        ends = np.append(np.flatnonzero(np.diff(of)) + 1, len(of))
        for a, b in zip(np.append(0, ends), ends):
            q, i, d = search.block_nearest(x[a:b], x[a:b], degree + 1, metric)
            out.append((ids[a:b][q][q != i], ids[a:b][i][q != i], d[q != i]))
        return _edge_batch(*(np.concatenate(c) for c in zip(*out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            of = np.asarray(part["item_id"])
            last = int(np.argmax(of == of[-1]))
            if last:
                yield edges(part.slice(0, last))
            rest = part.slice(last)
        if rest is not None:
            yield edges(rest)

    return run


def _stored(vector: Column, kind: str) -> Column:
    """A vector as it is kept and exchanged: of floats where it is given so, else of doubles. Distances are computed in doubles."""
    return vector if kind == "array<float>" else vectors.doubles(vector)


def graph(items: DataFrame, degree: int = 24, rounds: int = 3, metric: str = "cosine") -> DataFrame:
    """item_id, neighbour, distance: each item's nearest found, `degree` at most.

    items: item_id (long, unique), vector. Items without a vector are left out. The result
    is a written table in the shared folder, which the caller removes (`tables.remove`).
    """
    held = Written(items.sparkSession)
    rows = held.table(items.filter("vector IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), _stored(F.col("vector"), items.schema["vector"].dataType.simpleString()).alias("vector")))
    first = rows.select(F.size("vector").alias("d")).first()
    if first is None:
        return held.kept(items.sparkSession.createDataFrame([], _EDGES))
    edges = None
    for seed in range(DIRECTIONS):
        near = rows.withColumn("place", _direction(first["d"], seed)).repartitionByRange("place").sortWithinPartitions("place", "item_id").select("item_id", "vector")
        found = near.mapInArrow(_within_blocks(degree, metric), _EDGES)
        edges = found if edges is None else edges.unionByName(found)
    edges = held.table(_nearest_edges(edges, degree))
    for _ in range(rounds):
        met = _companies(edges, rows, degree).mapInArrow(_met(degree, metric), _EDGES)
        edges = held.table(_nearest_edges(edges.unionByName(met), degree))
    return held.kept(edges)


def searched(items: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 10, width: int = 64, steps: int = 8, entries: int = 1_024, metric: str = "cosine") -> DataFrame:
    """query_id, item_id, distance, rank of the k nearest items found for each query.

    A search begins with the nearest of about `entries` items (a hash sample) and keeps the
    `width` nearest that it has seen; a step looks at the neighbours of those not yet
    expanded. It ends after `steps`, or when no query has any left. A written table, see `graph`.
    """
    held = Written(items.sparkSession)
    rows = held.table(items.filter("vector IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), _stored(F.col("vector"), items.schema["vector"].dataType.simpleString()).alias("vector")))
    asked = held.table(queries.filter("vector IS NOT NULL").select("query_id", vectors.doubles(F.col("vector")).alias("q")))
    n = rows.count()
    sample = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(1_000_000)) < int(1e6 * min(1.0, entries / max(n, 1))))
    start = search.nearest_each(sample, asked.withColumnRenamed("q", "vector"), min(width, 16), metric)
    seen = held.table(start.select("query_id", "item_id", "distance", F.lit(False).alias("done")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "item_id"))
    for _ in range(steps):
        open_ = seen.filter("NOT done").select("query_id", "item_id")
        if open_.isEmpty():
            break
        step = open_.join(edges.select("item_id", "neighbour"), "item_id").select("query_id", F.col("neighbour").alias("item_id")).distinct()
        fresh = step.join(seen.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
        measured = fresh.join(rows, "item_id").join(asked, "query_id")
        measured = measured.select("query_id", "item_id", search._METRICS[metric](F.col("q"), vectors.doubles(F.col("vector"))).alias("distance"), F.lit(False).alias("done"))
        both = seen.withColumn("done", F.lit(True)).unionByName(measured)
        seen = held.table(both.withColumn("rank", rank).filter(F.col("rank") <= width).drop("rank"))
    return held.kept(seen.withColumn("rank", rank).filter(F.col("rank") <= k).drop("done"))


def inserted(items: DataFrame, edges: DataFrame, new: DataFrame, degree: int = 24, metric: str = "cosine") -> DataFrame:
    """The graph with new items: each is joined to the neighbours that a search finds, and these to it."""
    found = searched(items.select("item_id", "vector"), edges, new.select(F.col("item_id").alias("query_id"), "vector"), degree, max(64, 2 * degree), metric=metric)
    links = found.select(F.col("query_id").cast("long").alias("item_id"), F.col("item_id").alias("neighbour"), "distance").filter("item_id <> neighbour")
    back = links.select(F.col("neighbour").alias("item_id"), F.col("item_id").alias("neighbour"), "distance")
    return _nearest_edges(edges.unionByName(links).unionByName(back), degree)


def removed(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """The graph without items (item_id) and all edges to them."""
    gone = keys.select("item_id").distinct()
    return edges.join(gone, "item_id", "left_anti").join(gone.withColumnRenamed("item_id", "neighbour"), "neighbour", "left_anti").select("item_id", "neighbour", "distance")


def pruned(edges: DataFrame, degree: int) -> tuple[DataFrame, DataFrame]:
    """The nearest `degree` edges of each item, and the edges that go."""
    kept = _nearest_edges(edges, degree)
    return kept, edges.select("item_id", "neighbour").exceptAll(kept.select("item_id", "neighbour"))


def statistics(edges: DataFrame) -> DataFrame:
    """connections, items: how many items have how many neighbours."""
    return edges.groupBy("item_id").agg(F.count("*").alias("connections")).groupBy("connections").agg(F.count("*").alias("items"))
