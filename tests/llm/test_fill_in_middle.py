"""Fill-in-the-middle outputs against a direct rendering, SQL, and the exact way back."""

import hashlib
from collections import Counter

import pytest

from quern.llm import fill_in_middle as fim
from quern.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def direct(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = Counter((*d[:5], sha(d[5]), sha(t or "")) for d, t in ((direct(i, t), t) for i, t in rows))
    assert Counter(map(tuple, fim.digests(df).collect())) == want
    assert Counter(map(tuple, fim.transformed(df).collect())) == Counter(direct(i, t) for i, t in rows)
    return rows


@pytest.mark.parametrize("unit", [1, 3, 1 << 16])
def test_odd_rows(spark, odd_docs, monkeypatch, unit):
    monkeypatch.setattr(fim, "UNIT", unit)
    df = odd_docs.filter("doc_id IS NULL OR doc_id <> 4") if unit == 1 else odd_docs
    check(df)


def test_empty(no_docs):
    assert fim.digests(no_docs).collect() == [] and fim.transformed(no_docs).collect() == []


def test_markers_repeats_and_edges(spark):
    texts = ["a <P> b", "<", "<<<<", "<P", "P>", "x<M>", "><>", "<M" * 40, ">" * 40, "<S", "é😀" * 50, "\n", "a" * 200]
    rows = [(i, t) for i in range(40) for t in texts] + [(3, "same text")] * 5000 + [(None, t) for t in texts]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))


def test_query(spark):
    from tests.compare import connection, difference

    assert difference(QUERIES["op12_fill_in_middle"](spark, SF), connection(SF), ORACLES["op12_fill_in_middle"]) == ""
    forms = Counter(r["form"] for r in QUERIES["op12_fill_in_middle"](spark, SF).collect())
    assert set(forms) == {"plain", "psm", "spm"}


def test_round_trip(spark, docs):
    out = fim.restored(fim.transformed(docs).selectExpr("*", "1 AS TEXT"))
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = out.collect()
    assert out.columns[-1] == "text" and {r["doc_id"]: r["text"] for r in rows} == want


def test_one_exchange_and_rows_of_two_ids(spark, docs):
    df = fim.digests(docs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython") == 0
    twice = docs.limit(20).unionByName(docs.limit(20).selectExpr("doc_id", "concat(text, '!') AS text", "lang", "source", "n_chars"))
    check(twice)


def test_other_columns_are_not_read(docs):
    clash = docs.limit(20).selectExpr("*", "1 AS n", "'x' AS form", "2 AS h", "3 AS g", "4 AS piece", "5 AS position")
    assert sorted(map(repr, fim.digests(clash).collect())) == sorted(map(repr, fim.digests(docs.limit(20)).collect()))
