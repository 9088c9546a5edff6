"""Chunks and embeddings as column expressions against their plain Python, and chunks as a table function of SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import embedder
from quern.operators import chunks

SF = "/root/testdata/sf0.001"
#: Words whose hash wraps around within a vector (found by trying).
WRAPPING = ["w19240", "w164192", "w198864"]
ODD = [None, "", " ", "One. Two! Three? four", "no end", "a b  c. " * 300, "Ünï cödé. KELVIN K sign. İstanbul!", "Dr. X. Y. said 3. things. Then... more?\n\nNext", "word " * 900, "!!! ... ??? ---", "tab\tnew\nline. x_y 1_2"]


@pytest.fixture(scope="module")
def rows(spark):
    odd = spark.createDataFrame(list(enumerate(ODD, 10_000)), "id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text").unionByName(odd)


def python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any(name in plan for name in ("InPandas", "ArrowEval", "BatchEvalPython", "InArrow"))


@pytest.mark.parametrize("config", [chunks.PARENT, chunks.CHILD, chunks.ChunkConfig("tiny", 4, 1, 2, 5, 0.9), chunks.ChunkConfig("windows", 12, 4, 10, 60, 0.5, "windows")])
def test_chunks_equal_plain_packing(rows, config):
    found, plain = chunks.chunked(rows, config), chunks.chunked(rows, config, embedder.embed)
    assert sorted(found.collect()) == sorted(plain.collect())
    assert not python(found) and python(plain) and not python(chunks.two_levels(rows))


def test_embedding_equals_plain(spark, rows):
    wraps = [w for w in WRAPPING if embedder.fnv1a(w) >= embedder._WRAPS]
    assert len(wraps) == 3
    more = spark.createDataFrame([(1, " ".join(wraps)), (2, f"plain words and {wraps[0]}"), (3, wraps[1] * 2)], "id long, text string")
    found = rows.unionByName(more).select("text", embedder.embedding(F.col("text")).alias("v"))
    assert not python(found)
    for r in found.collect():
        assert np.abs(np.array(r["v"]) - embedder.embed(r["text"])).max() < 1e-9, r["text"]
    two = more.alias("a").crossJoin(F.broadcast(more.alias("b"))).select(F.col("a.text").alias("x"), F.col("b.text").alias("y"))
    sums = lambda c: embedder.summed(F.col(c))
    for r in two.select("x", "y", embedder.summed_similarity(sums("x"), sums("y")).alias("s")).collect():
        assert r["s"] == pytest.approx(float(embedder.embed(r["x"]) @ embedder.embed(r["y"])), abs=1e-9)


def test_chunks_by_sql(spark, rows):
    chunks.register_functions(spark)
    rows.createOrReplaceTempView("texts_to_chunk")
    for level, config in (("parent", chunks.PARENT), ("child", chunks.CHILD)):
        found = spark.sql(f"SELECT t.id, c.ordinal, c.start_token, c.end_token, c.text FROM texts_to_chunk t, LATERAL text_chunks(t.text, '{level}') c")
        assert sorted(found.collect()) == sorted(chunks.chunked(rows, config).collect())


def test_parents_are_made_once(rows):
    """Both levels come from one pass without an exchange, and without a filter inferred from what is exploded."""
    plan = chunks.two_levels(rows.filter("id < 10000"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1 and "Join" not in plan
    assert not [line for line in plan.split("\n") if "Filter " in line and "aggregate(" in line]
    index = chunks.reindexed(chunks.parents(rows), rows.filter("id % 2 = 0"), make=chunks.parents)
    assert sorted(index.collect()) == sorted(chunks.two_levels(rows).filter("config = 'parent'").select(index.columns).collect())
