import pytest
from compare import assert_same, connect

from rookery.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Joins with a table of a few prices or one row of totals.
NESTED_LOOPS = {"c1_c5_price_usage"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLES[name])


def test_ann_recall(spark):
    exact = {(r.query_id, r.chunk_id) for r in _topk(spark, "exact")}
    found = {(r.query_id, r.chunk_id) for r in _topk(spark, "ann")}
    assert len(exact & found) >= 0.9 * len(exact)


def _topk(spark, how):
    from pyspark.sql import functions as F

    from rookery.operators import retrieval
    from rookery.plans.views import Domain

    vectors = Domain(spark, "/root/testdata/sf0.01").chunk_vectors
    asked = vectors.where("CAST(chunk_id AS INT) % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    run = retrieval.vector_topk(asked, vectors, 10) if how == "exact" else retrieval.ann_topk(asked, vectors, 10, lists=32, probes=24)
    return run.collect()


def test_plans_have_no_cartesian_product(spark):
    for name, query in QUERIES.items():
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan or name in NESTED_LOOPS, name
