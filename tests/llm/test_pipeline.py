"""The pipeline, stage by stage, against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import common, quality_classifier
from tests.llm.test_operators import library, naive_groups, naive_removed

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    rows = {}
    seen = [sorted((r["doc_id"], r["text"]) for r in docs.collect())]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == names, name
        seen.append(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
        rows[name] = docs.count()
    start, good, single, cut, clean, last = seen
    scores = quality_classifier.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    wanted = {r["doc_id"] for r in scores.filter("predicted = 1").collect()}
    assert good == [r for r in start if r[0] in wanted] and len(good) > 0.7 * len(start)
    groups = naive_groups(good)
    assert {d for d, _ in single} == {least for _, _, least in groups} and set(single) <= set(good)
    want = {d: (n, gone) for d, n, gone, _, _ in naive_removed(single)}
    left = dict(cut)
    assert left.keys() == want.keys()
    assert all(len(left[d].encode()) <= n - gone and len(left[d].encode()) >= n - gone - 8 for d, (n, gone) in want.items())
    split = re.compile(r"\w+")
    items = [split.findall(r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 13]) for w in items for i in range(len(w) - 12)}
    dirty = {d for d, t in cut for w in [split.findall(t.lower())] if any(tuple(w[i : i + 13]) in grams for i in range(len(w) - 12))}
    gone = {d for d, _ in cut} - {d for d, _ in clean}
    assert dirty <= gone and len(gone - dirty) <= 1
    model = library()
    assert last == clean
    for r in docs.collect():
        assert r["piece_ids"] == model.encode(r["text"]) and r["n_pieces"] == len(r["piece_ids"])
    assert np.all([r["n_chars"] == len(r["text"]) for r in docs.collect()])


def test_run_equals_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF))
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))


def test_last_stage_decodes(spark, odd_docs, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (docs, odd_docs):
        out = corpus_pipeline.pieces(spark, rows, SF)
        assert out.count() == rows.count() == out.filter("round_trip").count()
    monkeypatch.setattr(corpus_pipeline.sentencepieces, "_decoded", lambda column, name: pa.array([f"{x}" for x in column.to_pylist()], pa.string()))
    assert corpus_pipeline.pieces(spark, docs, SF).filter("round_trip").count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, odd_docs, name, stage):
    odd = odd_docs.withColumns({n: F.lit(7) for n in ("id", "rows", "block", "dirty", "N_PIECES")})
    out = stage(spark, odd, SF)
    names = [c for c in odd.columns if c != "N_PIECES"] + ["round_trip", "piece_ids", "n_pieces"] if name == "sentencepiece" else odd.columns
    assert out.columns == names
    rows, before = out.collect(), odd.collect()
    key = lambda r: (repr(r["doc_id"]), repr(r["text"]))
    kept, had = Counter(map(key, rows)), Counter(map(key, before))
    if name in ("quality_classifier", "simhash_near_dedup", "benchmark_decontamination"):
        assert not kept - had
    if name in ("benchmark_decontamination", "sentencepiece"):
        assert kept == had
    if name == "simhash_near_dedup":  # of the texts without words, and of the repeated row, one
        assert sorted(repr(r["doc_id"]) for r in rows) == sorted(["1", "4", "5", "6", "7", "8", "None", "None"])
    if name == "suffix_array_dedup":
        assert len(rows) == len(before) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    empty = stage(spark, odd.limit(0), SF)
    assert empty.columns == names and empty.count() == 0
