"""Vector queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import neighbours, search
from ..sources.views import table
from .registry import query


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


def _vector(items: DataFrame, item: int) -> list[float]:
    row = items.filter(F.col("item_id") == item).first()
    return list(row["vector"]) if row else [0.0]


_COSINE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_L2 = "list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"""SELECT e.vec_id AS item_id, round(1 - {_COSINE}, 6) AS distance FROM embeddings e, embeddings q
    WHERE q.vec_id = 0 ORDER BY 1 - {_COSINE}, e.vec_id LIMIT 10""")
def vec_knn_cosine(spark, sf_dir):
    items = _items(spark, sf_dir)
    return search.nearest(items, _vector(items, 0)).select("item_id", F.round("distance", 6).alias("distance"))


@query(f"""SELECT e.vec_id AS item_id, round({_L2}, 6) AS distance FROM embeddings e, embeddings q
    WHERE q.vec_id = 7 ORDER BY {_L2}, e.vec_id LIMIT 10""")
def vec_knn_l2(spark, sf_dir):
    items = _items(spark, sf_dir)
    return search.nearest(items, _vector(items, 7), metric="euclidean").select("item_id", F.round("distance", 6).alias("distance"))


@query(f"""SELECT e.vec_id AS item_id, round({_COSINE}, 6) AS similarity FROM embeddings e, embeddings q
    WHERE q.vec_id = 3 AND {_COSINE} >= 0.25""")
def vec_range_threshold(spark, sf_dir):
    items = _items(spark, sf_dir)
    return search.within(items, _vector(items, 3), 0.25).select("item_id", F.round("similarity", 6).alias("similarity"))


@query(f"""SELECT q.vec_id AS query_id, e.vec_id AS item_id, round(1 - {_COSINE}, 6) AS distance,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - {_COSINE}, e.vec_id) AS rank
    FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5""")
def vec_multi_knn(spark, sf_dir):
    items = _items(spark, sf_dir)
    queries = items.filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "vector")
    found = search.nearest_each(items, queries, 5)
    return found.select("query_id", "item_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH hits AS (SELECT e.vec_id, e.label, {_COSINE} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 11 AND e.label < 5)
    SELECT vec_id AS item_id, label, d.source, round(s, 6) AS similarity FROM hits LEFT JOIN documents d ON d.doc_id = vec_id
    WHERE s >= 0 ORDER BY s DESC, vec_id LIMIT 10""")
def vec_search_typed_join(spark, sf_dir):
    """Filter by type, then the k best, then their entities (missing ones stay)."""
    items = _items(spark, sf_dir)
    hits = search.nearest(items.filter("label < 5"), _vector(items, 11), k=10, least_similarity=0.0)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source")
    named = items.select("item_id", "label").join(F.broadcast(hits), "item_id")  # at most 10 rows
    found = docs.join(F.broadcast(named), "item_id", "right")  # at most 10 rows
    return found.select("item_id", "label", "source", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query("""SELECT label, pos - 1 AS position, round(avg(x), 6) AS mean FROM (
        SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos""")
def vec_label_centroid(spark, sf_dir):
    means = search.centroids(_items(spark, sf_dir), "label")
    return means.select("label", F.col("position").cast("long").alias("position"), F.round("mean", 6).alias("mean"))


@query("""SELECT vec_id AS item_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 4) AS length,
    concat(CAST(label * 10 AS VARCHAR), '.0%') AS text FROM embeddings""")
def vec_normalised(spark, sf_dir):
    items = _items(spark, sf_dir)
    unit = V.normalised(V.doubles(F.col("vector")))
    return items.select("item_id", F.round(V.norm(unit), 4).alias("length"), V.similarity_label(F.col("label") / 10).alias("text"))


@query()
def vec_graph_knn(spark, sf_dir):
    """The five nearest by the neighbour graph, approximate; tests/test_neighbours.py measures the recall."""
    items = _items(spark, sf_dir).select("item_id", "vector")
    queries = items.filter("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    found = neighbours.searched(items, neighbours.graph(items), queries, 5)
    return found.select("query_id", "item_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT least(24, (SELECT count(*) FROM embeddings) - 1) AS connections, count(*) AS items FROM embeddings""")
def vec_graph_degrees(spark, sf_dir):
    """How many items of the neighbour graph have how many neighbours: each has as many as it may."""
    found = neighbours.statistics(neighbours.graph(_items(spark, sf_dir).select("item_id", "vector")))
    return found.select(F.col("connections").cast("long").alias("connections"), "items")
