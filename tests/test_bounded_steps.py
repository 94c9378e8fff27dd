"""Steps whose memory and shuffles must not grow with a batch or with pairs."""

import pyarrow as pa
from pyspark.sql import functions as F

from rookery.operators import corpus, extras, refine, retrieval


def test_chunks_leave_in_small_batches(spark):
    text = " ".join(f"word{i}" for i in range(900))
    docs = spark.createDataFrame([(i, text) for i in range(400)] + [(400, None), (401, " ")], "doc_id long, text string").coalesce(1)
    sizes = corpus.chunk_documents(docs).select("doc_id").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long")
    got = [r.n for r in sizes.collect()]
    cuts = len(corpus.cut_points(text))
    assert sum(got) == 400 * cuts
    assert "MapInArrow" in corpus.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()


def test_hashed_vectors_move_nothing(spark):
    chunks = spark.createDataFrame([("a", "one two two"), ("b", "..."), ("c", None), ("d", "ÉTÉ été")], "chunk_id string, content string")
    made = extras.hashed_vectors(chunks)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.chunk_id: r.embedding for r in made.collect()}
    slot = {w: s for w, s in spark.createDataFrame([("one",), ("two",), ("été",)], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(64))).collect()}
    assert set(got) == {"a", "d"} and slot["one"] != slot["two"]
    want = [0.0] * 64
    want[slot["one"]], want[slot["two"]] = 1 / 5**0.5, 2 / 5**0.5
    assert all(abs(x - y) < 1e-6 for x, y in zip(got["a"], want, strict=True)) and got["d"][slot["été"]] == 1.0


def test_backfill_without_a_limit_has_all_pairs(spark):
    rows = [(str(i), [float(i), 1.0] if i % 5 else None) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    asked = chunks.where("embedding IS NOT NULL").select(F.col("chunk_id").alias("query_id"), "embedding")
    out = refine.vector_with_backfill(asked, chunks, k=None)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 48 * (48 + 5) and out.where("score = 0.4D").select("chunk_id").distinct().count() >= 5
    assert sorted(map(tuple, retrieval.vector_pairs(asked, chunks, block=10).collect())) == sorted(map(tuple, retrieval.vector_pairs(asked, chunks).collect()))


def test_bm25_tasks_keep_their_best(spark):
    """A task puts out the best chunks it has seen, and not the best of every few of them."""
    rows = [(f"{i:04}", "alpha beta" + " x" * i) for i in range(1000)]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string").coalesce(1)
    words = spark.createDataFrame([("q1", "alpha"), ("q2", "alpha"), ("q2", "beta")], "query_id string, keyword string")
    stored = chunks.select("chunk_id", F.split("content", " ").alias("words")).coalesce(1)
    asked = words.withColumn("df", F.lit(10)).collect()
    hits, _ = retrieval._bm25_block(asked, stored, 1000, 500.0, 3, 1.2, 0.75)
    assert {(r.query_id, r.chunk_id) for r in retrieval.top_k(hits, 3).collect()} == {(q, f"{i:04}") for q in ("q1", "q2") for i in range(3)}
    assert hits.count() == 6  # of the first chunks; 48 if every few of them had a best
    one = retrieval.bm25(words, chunks, 3).select("query_id", "chunk_id", "score", "rank").collect()
    many = retrieval.bm25(words, chunks, 3, block=1).select("query_id", "chunk_id", "score", "rank").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_bm25_blocks_are_no_column(spark):
    """However many blocks there are, the columns are those of one."""
    chunks = spark.createDataFrame([(f"{i:04}", "alpha beta" + " x" * i) for i in range(50)], "chunk_id string, content string")
    words = spark.createDataFrame([("q1", "alpha"), ("q2", "alpha"), ("q2", "beta")], "query_id string, keyword string")
    one, many = retrieval.bm25(words, chunks, 3), retrieval.bm25(words, chunks, 3, block=1)
    assert many.columns == one.columns == ["query_id", "chunk_id", "score", "rank"]
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))
