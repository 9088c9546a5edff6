"""Exact vector search by top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors

#: Items of a block, and query vectors of one, about; a task holds one of each.
ITEMS, BLOCK = 16_384, 1_024
#: Items and queries whose products are computed at once, and pairs of them whose distances are.
_AT_ONCE, _QUERIES, _PAIRS = 4_096, 256, 16_384
#: By how much the product of two blocks may be off, as a share of the vectors' lengths.
_MARGIN = 1e-9

_METRICS = {"cosine": vectors.cosine_distance, "euclidean": vectors.euclidean_distance}


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a table as rows of a matrix."""
    column = table["vector"].combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    sizes = np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return np.asarray(column.flatten(), np.float64).reshape(len(sizes), sizes[0] if len(sizes) else 0)


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row by row, summed in the order of the column expressions: equal vectors have equal distances."""
    total = lambda x: np.cumsum(x, 1)[:, -1] if x.shape[1] else np.zeros(len(x))
    if metric == "euclidean":
        return np.sqrt(total((a - b) ** 2))
    length = np.sqrt(total(a * a)) * np.sqrt(total(b * b))
    return 1 - np.divide(total(a * b), length, out=np.zeros(len(a)), where=length > 0)


def block_nearest(x: np.ndarray, q: np.ndarray, k: int, metric: str = "cosine") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, item, distance of the k nearest rows of x to each row of q, of equals the first rows.

    Products of blocks choose all that may be among the k; these are computed anew, exactly.
    """
    if not len(x) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if x.shape[1] != q.shape[1]:
        raise ValueError("vectors differ in length")
    if metric == "cosine":  # half the squared distance of unit vectors is 1 - cosine
        unit = lambda v: np.divide(v, n := np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=n > 0)
        xs, qs, own, scale = unit(x), unit(q), np.zeros(len(x)), np.ones((len(q), 1))
    else:
        xs, qs, own = x, q, (x * x).sum(1) / 2
        scale = ((q * q).sum(1) + 2 * own.max() + 1)[:, None]
    found = []
    for first in range(0, len(q), _QUERIES):
        part = slice(first, first + _QUERIES)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(x), _AT_ONCE):
            near = own[at : at + _AT_ONCE] - qs[part] @ xs[at : at + _AT_ONCE].T
            kth = np.partition(near, k - 1, 1)[:, k - 1 : k] if near.shape[1] > k else near.max(1, keepdims=True)
            query, item = np.nonzero(near <= kth + _MARGIN * scale[part])
            query, item = query + first, item + at
            # Where many are equally near, they are many pairs: no copy of all their vectors.
            pieces = (slice(i, i + _PAIRS) for i in range(0, len(query), _PAIRS))
            distance = np.concatenate([np.zeros(0), *(_distances(q[query[p]], x[item[p]], metric) for p in pieces)])
            best = _least(k, *(np.concatenate(c) for c in zip(best, (query, item, distance))))
        found.append(best)
    query, item, distance = (np.concatenate(c) for c in zip(*found))
    return query, item, distance


def _least(k: int, query: np.ndarray, item: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest items of each query, of equals the first."""
    order = np.lexsort((item, distance, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    kept = order[place < k]
    return query[kept], item[kept], distance[kept]


def _of_block(k: int, metric: str):
    def run(items, queries):
        order = pc.sort_indices(items, [("item_id", "ascending")])
        ids, x, q = items["item_id"].take(order), _matrix(items)[np.asarray(order)], _matrix(queries)
        if x.size and len(q):
            # Of equal vectors only the k with the least ids can be among the nearest.
            _, copy = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
            order = np.argsort(copy, kind="stable")
            place = np.arange(len(copy)) - np.searchsorted(copy[order], copy[order])
            if (place >= k).any():
                keep = np.sort(order[place < k])
                ids, x = ids.take(pa.array(keep)), x[keep]
        query, item, distance = block_nearest(x, q, k, metric)
        return pa.table([queries["query_id"].take(pa.array(query)), ids.take(pa.array(item)), pa.array(distance)], ["query_id", "item_id", "distance"])

    return run


def nearest(items: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", least_similarity: float | None = None) -> DataFrame:
    """item_id, distance of the k nearest items; ties by id. Each task keeps k rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = items.select("item_id", _METRICS[metric](vectors.doubles(F.col("vector")), q).alias("distance"))
    if least_similarity is not None:
        rows = rows.filter(1 - F.col("distance") >= least_similarity)
    return rows.orderBy("distance", "item_id").limit(k)


def nearest_each(items: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, item_id, distance, rank of the k nearest items of each query; ties by id.

    Any number of both. They are dealt into blocks; each block of items meets each block
    of queries in one task, as products of matrices of a fixed size, of which k rows a
    query are left: what is exchanged behind it are queries x k x blocks of items. Floats
    become doubles in the task. Rows without a vector are left out; it is an error if
    vectors differ in length.
    """

    def plain(df: DataFrame, key: str) -> DataFrame:
        floats = df.schema["vector"].dataType.simpleString() == "array<float>"
        return df.filter("vector IS NOT NULL").select(key, (F.col("vector") if floats else vectors.doubles(F.col("vector"))).alias("vector"))

    items, queries = plain(items, "item_id"), plain(queries, "query_id")
    rows, columns = max(1, -(-items.count() // ITEMS)), max(1, -(-queries.count() // BLOCK))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int")
        return df.withColumns({own: block, other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})

    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (items, "item_id"))}
    cells = dealt(items, "i", rows, "j", columns).groupBy("i", "j").cogroup(dealt(queries, "j", columns, "i", rows).groupBy("i", "j"))
    pairs = cells.applyInArrow(_of_block(k, metric), f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "item_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def within(items: DataFrame, query: list[float], similarity: float) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = items.select("item_id", vectors.cosine_similarity(vectors.doubles(F.col("vector")), q).alias("similarity"))
    return rows.filter(F.col("similarity") >= similarity)


def centroids(items: DataFrame, by: str) -> DataFrame:
    """by, position, mean: the mean vector of each group, element by element."""
    parts = items.select(by, F.posexplode(vectors.doubles(F.col("vector"))).alias("position", "x"))
    return parts.groupBy(by, "position").agg(F.avg("x").alias("mean"))


def search_text(items: DataFrame, text: str, k: int = 10, provider=None) -> tuple[DataFrame, list[float]]:
    """The k nearest items of a text, and the vector it was searched by."""
    from ..functions.embedder import embed

    vector = [float(x) for x in (provider or embed)(text)]
    return nearest(items, vector, k), vector


def nearest_chunks(chunks: DataFrame, entities: DataFrame, query: list[float], k: int, kind: str) -> DataFrame:
    """id, entity_id, distance and the entities' columns: the k nearest chunks of one type of entity.

    The type is filtered before the k are taken; chunks whose entity is missing are dropped.
    """
    hits = nearest(chunks.filter(F.col("entity_type") == kind).withColumnRenamed("id", "item_id"), query, k)
    owners = chunks.select(F.col("id").alias("item_id"), "entity_id").join(F.broadcast(hits), "item_id")  # k rows
    return entities.join(F.broadcast(owners), "entity_id").withColumnRenamed("item_id", "id")


def rebuilt(rows: DataFrame, provider=None) -> DataFrame:
    """Rows (text, embedding) with an embedding for those that have none; the others stay."""
    from ..functions.embedder import embedding

    made = embedding(F.col("text")) if provider is None else provider(F.col("text"))
    lacking = rows.filter("embedding IS NULL").withColumn("embedding", made.cast(rows.schema["embedding"].dataType.simpleString()))
    return rows.filter("embedding IS NOT NULL").unionByName(lacking.select(rows.columns))
