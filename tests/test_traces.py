"""Traces gathered as runs against a plain sort."""

import pytest

from quern.operators import stats


@pytest.mark.parametrize("ranks", [{"a": 1, "b": 2, "c": 3}, {"a": 2, "b": 2, "c": 1}, {"a": 999, "b": 1}, {"z": 5}])
def test_traces(spark, ranks):
    kinds = ["a", "b", "c", "d", None, "d", "a", "e"]
    rows = [(i, i % 3 if i < 60 else 7, kinds[(i * i + i // 5) % 8], (i * 37) % 20) for i in range(200)]
    found = stats.traces(spark.createDataFrame(rows, "uuid long, correlation_id long, component_type string, created_at long"), ranks)
    want = {}
    for uuid, correlation, kind, at in sorted(rows, key=lambda r: (ranks.get(r[2], 999), r[3], r[0])):
        want.setdefault(correlation, []).append(kind)
    assert {r["correlation_id"]: (r["n"], r["components"]) for r in found.collect()} == {c: (len(k), ">".join(x for x in k if x)) for c, k in want.items()}
    empty = spark.createDataFrame([], "uuid long, correlation_id long, component_type string, created_at long")
    assert stats.traces(empty, ranks).count() == 0
