"""Whitening against plain numpy and exact fractions."""

from fractions import Fraction

import numpy as np
import pytest

from quern.llm import whitening
from quern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def reference(vectors):
    """x, exact covariance, deviations."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    u = [[n * r[i] - s[i] for i in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in u), n**3)) for j in range(d)] for i in range(d)])
    return np.array(u, object), cov, [sum(v * v for v in r) for r in u]


def test_query_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    u, cov, deviation = reference([r["embedding"] for r in rows])
    n = len(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = {r["vec_id"]: w for r, w in zip(rows, (u / n).astype(float) @ vectors / np.sqrt(values))}
    dev = {r["vec_id"]: v for r, v in zip(rows, deviation)}
    out = QUERIES["op11_whitening"](spark, SF)
    assert dict(out.dtypes)["deviation"] == "bigint" and dict(out.dtypes)["n"] == "bigint"
    found = out.collect()
    assert len(found) == 32 * n and len({(r["vec_id"], r["component"]) for r in found}) == len(found)
    sign = {c: np.sign(np.dot([r["whitened"] for r in sorted(found) if r["component"] == c], [want[r["vec_id"]][c - 1] for r in sorted(found) if r["component"] == c])) for c in range(1, 33)}
    for r in found:
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == dev[r["vec_id"]] and r["identity_error"] < 1e-9
        assert r["whitened"] == pytest.approx(sign[k + 1] * want[r["vec_id"]][k], abs=1e-8)
        assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-10)


def test_covariance_is_exact_with_large_entries(spark):
    vectors = [[1e6 * (i % 7) + 0.3 * i, -2.0**40 * (i % 3), 2.0**50 + i, float(i)] for i in range(50)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id int, embedding array<double>")
    kept, d, n = whitening.vectors_of(rows, keep="vec_id")
    model = whitening.fit(kept.select("vector").repartition(5), d, n)
    assert (model.covariance == reference(vectors)[1]).all()
    out = whitening.whitened(rows).collect()
    assert {r["vec_id"]: r["deviation"] for r in out} == dict(enumerate(reference(vectors)[2]))


def test_exact_squares_do_not_depend_on_partitions(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    models = []
    for parts in (1, 3, 17):
        kept, d, n = whitening.vectors_of(rows.repartition(parts))
        models.append(whitening.fit(kept, d, n).covariance)
    assert all((m == models[0]).all() for m in models)


def test_limbs():
    for v in (0, 1, -1, 2**62, -(2**62) - 1, 3**90, -(3**90)):
        parts = whitening.limbs(v)
        assert sum(p << (60 * i) for i, p in enumerate(parts)) == v and all(-(2**63) <= p < 2**63 for p in parts)


@pytest.mark.parametrize("block", [1, 5])
def test_squares(block):
    for x in (np.arange(12).reshape(4, 3) - 5, np.array([[2**59, -(2**60)], [1, 2**60]])):
        found = whitening.squares(x)
        for i in range(x.shape[1]):
            want = [sum(int(r[i]) ** 2 for r in x)] + [sum((int(r[i]) + int(r[j])) ** 2 for r in x) for j in range(i + 1, x.shape[1])]
            assert found[i].tolist() == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1 * i, float(i * i % 5)] for i in range(9)]
    bad = [None, [], [1.0], [None, 1.0], [nan, 1.0], [1.0, -inf], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(3, good[3], "x"), (None, good[4], None)] + [(90 + i, v, "y") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector string").selectExpr("*", "7 AS id", "'a' AS at", "1 AS component", "2 AS n")
    out = whitening.whitened(df).collect()
    assert sorted(r["vec_id"] if r["vec_id"] is not None else -1 for r in out) == sorted([*range(9), 3, -1] * 2)
    assert {r["n"] for r in out} == {11} and {r["component"] for r in out} == {1, 2} and max(r["identity_error"] for r in out) < 1e-9
    by = {c: [r["whitened"] for r in out if r["component"] == c] for c in (1, 2)}
    assert all(abs(np.mean(v)) < 1e-9 and np.mean(np.square(v)) == pytest.approx(1) for v in by.values())
    assert whitening.whitened(df.limit(0)).collect() == [] and whitening.whitened(df.filter("vec_id >= 90 AND vec_id < 92")).collect() == []


def test_components_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in whitening.whitened(one).collect()] == [(1, 1, 1, 0, None, 0.0, None), (1, 2, 1, 0, None, 0.0, None)]
    line = spark.createDataFrame([(i, [float(i), 3.0]) for i in range(5)], "vec_id long, embedding array<double>")
    out = whitening.whitened(line).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-12 for r in out)
    huge = spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert max(abs(r["whitened"]) for r in whitening.whitened(huge).collect()) == pytest.approx(np.sqrt(1.5))
