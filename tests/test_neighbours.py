"""Block search against brute force, and the neighbour graph's recall."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import neighbours, search

SF = "/root/testdata/sf0.1"


def brute(x, q, k, metric):
    out = []
    for v in q:
        if metric == "euclidean":
            d = np.sqrt(((x - v) ** 2).sum(1))
        else:
            n = np.linalg.norm(x, axis=1) * np.linalg.norm(v)
            d = 1 - np.divide(x @ v, n, out=np.zeros(len(x)), where=n > 0)
        out.append(np.lexsort((np.arange(len(x)), d.round(10)))[:k].tolist())
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("k", [1, 7, 300])
def test_block_nearest(metric, k, monkeypatch):
    monkeypatch.setattr(search, "_AT_ONCE", 64)
    rng = np.random.default_rng(k)
    x = rng.normal(size=(200, 8))
    x[50:60], x[0] = x[5], 0
    q = np.vstack([x[:20], rng.normal(size=(10, 8))])
    query, item, distance = search.block_nearest(x, q, k, metric)
    found = [item[query == i].tolist() for i in range(len(q))]
    assert found == brute(x, q, k, metric) and (distance >= -1e-12).all()


def test_nearest_each_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[100:180] = x[7]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "item_id long, vector array<double>").repartition(3)
    queries = items.filter("item_id % 10 = 7 OR vector IS NULL").withColumnRenamed("item_id", "query_id")
    want = {i: b for i, b in zip(range(7, 300, 10), brute(x, x[7::10], 5, "cosine"))}
    for sizes in ((16_384, 1_024), (50, 4)):
        monkeypatch.setattr(search, "ITEMS", sizes[0])
        monkeypatch.setattr(search, "BLOCK", sizes[1])
        found = search.nearest_each(items, queries, 5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append(r["item_id"])
        assert got == want
    with pytest.raises(Exception, match="differ in length"):
        search.nearest_each(items, spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 5).collect()


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


@pytest.fixture(scope="module")
def edges(items):
    return neighbours.graph(items)


def recall(spark, items, edges, queries, k=10):
    exact = {(r["query_id"], r["item_id"]) for r in search.nearest_each(items, queries, k).collect()}
    found = {(r["query_id"], r["item_id"]) for r in neighbours.searched(items, edges, queries, k).collect()}
    return len(exact & found) / len(exact)


def test_recall_of_the_graph(spark, items, edges):
    queries = items.filter("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    assert recall(spark, items, edges, queries) >= 0.9
    assert edges.groupBy("item_id").count().agg(F.max("count"), F.count("*")).first()[:] == (24, items.count())
    assert neighbours.statistics(edges).agg(F.sum("items")).first()[0] == items.count()
    assert edges.filter("item_id = neighbour").isEmpty()


def test_insert_and_remove(spark, items, edges):
    old = items.filter("item_id % 50 <> 3")
    without = neighbours.removed(edges, items.filter("item_id % 50 = 3"))
    assert without.filter("item_id % 50 = 3 OR neighbour % 50 = 3").isEmpty()
    again = neighbours.inserted(old, without, items.filter("item_id % 50 = 3"))
    assert again.groupBy("item_id").count().agg(F.max("count")).first()[0] <= 24
    queries = items.filter("item_id % 50 = 3").withColumnRenamed("item_id", "query_id")
    exact = {(r["query_id"], r["item_id"]) for r in search.nearest_each(old, queries, 10).collect()}
    assert len(exact & {(r["item_id"], r["neighbour"]) for r in again.collect()}) / len(exact) >= 0.8
    kept, gone = neighbours.pruned(edges, 5)
    assert kept.count() == 5 * items.count() and kept.count() + gone.count() == edges.count()


def test_no_items(spark, items):
    none = items.limit(0)
    edges = neighbours.graph(none)
    assert edges.count() == 0 and neighbours.searched(none, edges, items.limit(3).withColumnRenamed("item_id", "query_id")).count() == 0


def test_companies_come_a_member_a_row(spark, items, edges):
    """What a batch holds does not grow with the degree, and companies may lie across batches."""
    some = items.filter("item_id < 300").select(F.col("item_id").cast("long").alias("item_id"), "vector")
    near = edges.filter("item_id < 300 AND neighbour < 300")
    found = neighbours._companies(near, some, 24).coalesce(1)
    assert found.dtypes == [("item_id", "bigint"), ("id", "bigint"), ("vector", "array<float>")]
    whole = found.toArrow().combine_chunks()
    of = whole["item_id"].to_pylist()
    assert len(set(of)) == 300 and max(map(of.count, set(of))) <= 49
    out = []
    for size in (7, 100, 100_000):
        made = list(neighbours._met(24, "cosine")(iter(whole.to_batches(size))))
        assert max(b.num_rows for b in made) <= 24 * (size + 49)
        out.append(sorted(zip(*(b for b in (sum((m.column(c).to_pylist() for m in made), []) for c in range(3))))))
    assert out[0] == out[1] == out[2] and len(out[0]) > 300
    assert not list(neighbours._met(24, "cosine")(iter([])))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_memory_of_a_block_is_bounded(metric):
    """Also where all items are equally near: of 500,000 pairs a few are compared at a time."""
    rng = np.random.default_rng(5)
    if metric == "cosine":
        x = np.outer(2.0 ** rng.integers(-9, 9, 2_000), rng.normal(size=64))
    else:
        x = rng.permuted(np.tile([1.0, 0.0], (2_000, 32)), axis=1)
    q = rng.normal(size=(250, 64)) if metric == "cosine" else np.zeros((250, 64))
    tracemalloc.start()
    query, item, distance = search.block_nearest(x, q, 5, metric)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    assert list(query) == [i for i in range(250) for _ in range(5)] and (np.diff(distance.reshape(250, 5)) >= 0).all()
    if metric == "euclidean":
        assert list(item) == [*range(5)] * 250


def test_memory_of_full_blocks():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(8_192, 64)), rng.normal(size=(1_024, 64))
    tracemalloc.start()
    query, item, _ = search.block_nearest(x, q, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and len(query) == 5 * 1_024
    near = (q[::100] / np.linalg.norm(q[::100], axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    assert (item.reshape(-1, 5)[::100] == np.argsort(-near, 1)[:, :5]).all()
