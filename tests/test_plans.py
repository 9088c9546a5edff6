"""What the physical plans must and must not contain."""

import re

import pytest

from quern.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name, pushed, read", [
    ("ev_by_type", "EqualTo(event_type,error)", "event_id:bigint,user_id:bigint,event_type:string"),
    ("ev_since", "GreaterThan(ts,", "event_id:bigint,ts:timestamp_ntz"),
    ("ent_point_lookup", "EqualTo(o_orderkey,77)", "o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string"),
    ("turn_by_conv_ordered", "EqualTo(conv_id,3)", "conv_id:bigint,turn:bigint,role:string"),
])
def test_filters_and_columns_reach_the_scan(spark, name, pushed, read):
    text = plan(QUERIES[name](spark, SF))
    assert pushed in text.replace(", ", ",") and read in text


@pytest.mark.parametrize("name", ["vec_knn_cosine", "ev_ring_last_1000"])
def test_top_k_is_taken_in_each_task(spark, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SF))


def test_ranks_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["vec_multi_knn"](spark, SF))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "vec_multi_knn"))
def test_no_cross_join_and_little_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert not re.search("BatchEvalPython", text)
    if not name.startswith(("txt_chunks", "txt_embed", "ver_reconstruct", "ver_json_equal")):
        assert not re.search("Python|Pandas|Arrow", text)


def test_pruning_gathers_no_snapshots(spark):
    text = plan(QUERIES["ver_prune_keep2"](spark, SF))
    assert "WindowGroupLimit" in text and "collect_list" not in text
