"""Queries that must see, and return, all rows."""

from quern.catalogue import QUERIES
from quern.operators import search

SF = "/root/testdata/sf0.01"


def test_chains_see_all_events(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type").collect()
    kinds = {u: {r["event_type"] for r in rows if r["user_id"] == u} for u in {r["user_id"] for r in rows}}
    want = {u for u, k in kinds.items() if {"signup", "view", "purchase"} <= k}
    got = [r["user_id"] for r in QUERIES["ev_chain_complete_all"](spark, SF).collect()]
    four = {u for u in want if "error" in kinds[u]}
    assert sorted(got) == sorted(want) and {r["user_id"] for r in QUERIES["ev_chain_complete"](spark, SF).collect()} == four


def test_all_marked_turns_come_in_order(spark):
    want = spark.read.parquet(f"{SF}/conversations.parquet").filter("turn % 3 = 0").count()
    got = QUERIES["turn_marked_by_conv"](spark, SF).collect()
    assert len(got) == want > 50 and want == QUERIES["turn_marked_desc"](spark, SF).count()
    assert got == sorted(got, key=lambda r: (r["conversation_id"], r["marked_at"] is not None, -(r["marked_at"] or 0), r["uuid"]))


def test_search_has_no_most_queries(spark, monkeypatch):
    assert not hasattr(search, "MAX_QUERIES")
    monkeypatch.setattr(search, "BLOCK", 7)
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "item_id long, vector array<double>")
    queries = spark.createDataFrame([(i, [i + 0.25, 1.0]) for i in range(50)], "query_id long, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["item_id"]) for r in search.nearest_each(items, queries, 3, "euclidean").collect())
    want = [(q, k + 1, i) for q in range(50) for k, i in enumerate(sorted(range(60), key=lambda i: (abs(q + 0.25 - i), i))[:3])]
    assert got == want
    assert search.nearest_each(items, queries.limit(0), 3).count() == 0


def test_search_of_more_than_ten_thousand_queries(spark):
    items = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "item_id long, vector array<double>")
    queries = spark.range(10_001).selectExpr("id AS query_id", "array(1.0D, 0.5D) AS vector")
    assert search.nearest_each(items, queries, 1).filter("item_id = 0").count() == 10_001
