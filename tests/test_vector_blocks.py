from pyspark.sql import functions as F

from rookery.operators import retrieval
from rookery.plans.views import Domain


def test_blocks_of_queries_find_the_same(spark):
    vectors = Domain(spark, "/root/testdata/sf0.001").chunk_vectors
    asked = vectors.select(F.col("chunk_id").alias("query_id"), "embedding").where("CAST(chunk_id AS INT) < 60")
    whole = sorted(map(tuple, retrieval.vector_topk(asked, vectors, 5).collect()))
    parts = sorted(map(tuple, retrieval.vector_topk(asked, vectors, 5, block=7).collect()))
    assert len(whole) == 300 and parts == whole
