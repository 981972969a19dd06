import pytest

import __spark_entry__
from formline.plans.chains import ORACLE_SQL, QUERIES
from tests.oracle import check


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in ORACLE_SQL:
        check(df, small, ORACLE_SQL[name])
    else:
        assert df.count() >= 0


def test_queries_take_whole_tables(spark):
    """On tables beyond any small bound, every row has its say."""
    at = "/root/testdata/sf0.01"
    rows = lambda t, c: spark.read.parquet(f"{at}/{t}.parquet").select(c).distinct().count()
    seen = lambda name, c: QUERIES[name](spark, at).select(c).distinct().count()
    assert seen("redacted_records", "event_id") == rows("events", "event_id") > 2001
    assert seen("model_transitions", "step_at") == rows("events", "event_id") > 901
    assert seen("annotation_revisions", "schema_id") == rows("customer", "c_custkey") > 301
    assert seen("semantic_anchors", "schema_id") <= rows("orders", "o_orderkey")
    assert QUERIES["decision_metrics"](spark, at).agg({"n": "sum"}).first()[0] == rows("orders", "o_orderkey")


@pytest.mark.parametrize("name", ["redacted_records", "umbrella_proposals", "semantic_neighbors", "structural_retrieval", "promoted_schemas", "model_gate", "path_type_distances", "hamming_neighbors"])
def test_larger_tables(spark, name):
    at = "/root/testdata/sf0.01"
    check(QUERIES[name](spark, at), at, ORACLE_SQL[name])
