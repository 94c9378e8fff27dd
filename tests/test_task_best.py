"""Searches whose tasks keep the best of each query: no table of pairs is joined, shuffled or written."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.operators import best as B
from rookery.operators import textindex as I


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_breaks_ties_by_order():
    rng = np.random.default_rng(1)
    scores = rng.integers(-3, 4, (50, 6))
    scores[rng.random((50, 6)) < 0.3] = B.NONE
    best = B.Best(6, 4)
    for at in range(0, 50, 7):
        best.add([f"{i:02}" for i in range(at, min(at + 7, 50))], scores[at : at + 7], scores[at : at + 7] * 10)
    rows = [(q, c, s, x) for part in best.rows(list("abcdef")) for q, c, s, x in zip(part[0].to_pylist(), part[1].to_pylist(), part[2].tolist(), part[3].tolist(), strict=True)]
    want = {(q, c, s, s * 10) for i, q in enumerate("abcdef") for s, c in sorted(((int(scores[r, i]), f"{r:02}") for r in range(50) if scores[r, i] != B.NONE), key=lambda x: (-x[0], x[1]))[:4]}
    assert len(rows) == len(want) and set(rows) == want


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(11)
    words = ["the", "of", "Vertrag", "été", "contract", "renewal", "a", "b1"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60)] * 5
    chunks = spark.createDataFrame([(f"c{i:03}", t) for i, t in enumerate(texts)] + [("null", None), ("none", "..."), ("blank", "")], "chunk_id string, content string").repartition(5)
    queries = spark.createDataFrame([(f"q{i:02}", t) for i, t in enumerate(texts[:40])] + [("null", None), ("none", "..."), ("blank", "")], "query_id string, text string")
    return queries, chunks


def test_fuzzy_topk_in_tasks(spark, talk):
    queries, chunks = talk
    near = I.similar_sets(queries.select("query_id", I.trigrams(F.col("text")).alias("items")), chunks.select("chunk_id", I.trigrams(F.col("content")).alias("items")), 0.4)
    near = near.join(queries, "query_id").join(chunks, "chunk_id").withColumns({"q": I.normalise(F.col("text")), "c": I.normalise(F.col("content"))})
    bonus = F.when(F.col("c") == F.col("q"), 0.4).when(F.col("c").startswith(F.col("q")), 0.2).otherwise(0.0)
    score = F.round(F.col("similarity") - 0.012 * F.abs(F.char_length("c") - F.char_length("q")) + bonus, 6)
    want = sorted(map(tuple, I.top_k(near.select("query_id", "chunk_id", "similarity", score.alias("score")), 7).collect()))
    out = I.fuzzy_topk(queries, chunks, k=7)
    assert "Join" not in plan(out)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 200
    assert sorted(map(tuple, I.fuzzy_topk(queries, chunks, k=7, block=3).collect())) == want


def test_fuzzy_union_in_tasks(spark, talk):
    queries, chunks = talk
    near = I.similar_sets(queries.select("query_id", I.trigrams(F.col("text")).alias("items")), chunks.select("chunk_id", I.trigrams(F.col("content")).alias("items")), 0.2)
    asked = queries.select("query_id", F.lower("text").alias("pattern"))
    rows = near.where("similarity > 0.2").select("query_id", "chunk_id", F.col("similarity").alias("score"), F.lit("trigram").alias("method"))
    rows = rows.unionByName(I.all_words_rank(queries, chunks).withColumn("method", F.lit("fulltext")))
    rows = rows.unionByName(I.substring_hits(asked, chunks).join(asked, "pattern").select("query_id", "chunk_id", F.lit(0.5).alias("score"), F.lit("like").alias("method")))
    one = rows.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.concat_ws(",", F.sort_array(F.collect_set("method"))).alias("methods"))
    want = sorted(map(tuple, I.top_k(one, 7).select("query_id", "chunk_id", "score", "methods", "rank").collect()))
    out = I.fuzzy_union(queries, chunks, k=7)
    assert "Join" not in plan(out)
    assert sorted(map(tuple, out.collect())) == want and {r[3] for r in want} >= {"trigram", "fulltext,like,trigram", "like"}
    assert sorted(map(tuple, I.fuzzy_union(queries, chunks, k=7, block=3).collect())) == want


def test_keyword_ranks_in_tasks(spark, talk):
    from rookery.operators import retrieval as R

    _, chunks = talk
    words = [("q1", "the"), ("q1", "contract"), ("q1", "été"), ("q2", "of"), ("q2", "zzz"), ("q3", "zzz")]
    out = R.keyword_count_rank(spark.createDataFrame(words, "query_id string, keyword string"), chunks, 9)
    assert "Join" not in plan(out)
    texts = {r.chunk_id: r.content for r in chunks.collect() if r.content}
    want = set()
    for q in ("q1", "q2"):
        hits = [(sum(w in t.lower().split() for x, w in words if x == q), len(t), c) for c, t in texts.items()]
        hits = sorted((h for h in hits if h[0]), key=lambda h: (-h[0], -h[1], h[2]))[:9]
        want |= {(q, c, m, n, i) for i, (m, n, c) in enumerate(hits, 1)}
    assert {(r.query_id, r.chunk_id, r.matched, r.length, r["rank"]) for r in out.collect()} == want and len(want) == 18


def test_matched_kinds_and_counts(spark, talk):
    _, chunks = talk
    asked = spark.createDataFrame([("q1", ["the", "of"]), ("q2", ["contract", "b1", "renewal"]), ("none", [])], "query_id string, items array<string>")
    kinds = B.in_order(chunks.where("content IS NOT NULL")).select("chunk_id", I.words_of(F.col("content")).alias("words"), F.right("chunk_id", F.lit(1)).alias("kind"), F.lit(0).cast("long").alias("carried"))
    rows = {r.chunk_id: (set(r.words), r.kind) for r in kinds.collect()}
    hits = {(q, kind, c, len(set(items) & own)) for q, items in (r for r in asked.collect()) for c, (own, kind) in rows.items() if set(items) & own}
    want = set()
    for q, kind in {h[:2] for h in hits}:
        want |= set(sorted((h for h in hits if h[:2] == (q, kind)), key=lambda h: (-h[3], h[2]))[:2])
    for block in (100, 1):
        found = B.best_matched(asked, kinds, 2, block=block)
        cut = I.top_k(found, 2, ["query_id", "kind"], [F.desc("matched"), F.col("chunk_id")]).collect()
        assert {(r.query_id, r.kind, r.chunk_id, r.matched) for r in cut} == want
        counts = {r.query_id: (r.found, r.kept) for r in B.matched_counts(asked, kinds, 0.5, block=block).collect()}
        assert counts == {q: (sum(h[0] == q for h in hits), sum(h[0] == q and h[3] * 2 >= n for h in hits)) for q, n in (("q1", 2), ("q2", 3))}


def test_first_chunks_of_a_pattern(spark):
    rows = [(f"{i:04}", "alpha beta" if i % 2 else "Alpha") for i in range(2000)]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string").repartition(4)
    patterns = spark.createDataFrame([("alpha",), ("beta",), ("zzz",)], "pattern string")
    hits = I.substring_hits(patterns, chunks, first=3)
    tasks = 2 * spark.sparkContext.defaultParallelism
    assert hits.count() <= 2 * 3 * tasks
    got = I.top_k(hits, 3, ["pattern"], [F.col("chunk_id")])
    assert {(r.pattern, r.chunk_id) for r in got.collect()} == {("alpha", "0000"), ("alpha", "0001"), ("alpha", "0002"), ("beta", "0001"), ("beta", "0003"), ("beta", "0005")}


def test_vectors_of_a_group_in_tasks(spark):
    from rookery.operators import refine, retrieval

    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(300, 8)), 1)
    rows = [(f"{i:03}", None if i % 50 == 7 else str(i % 4), [float(x) for x in vectors[i % 150]]) for i in range(300)] + [("null", "1", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, company_id string, embedding array<double>").repartition(5)
    asked = chunks.where("chunk_id < '040' OR chunk_id = 'null'").withColumnRenamed("chunk_id", "query_id")
    want = set()
    for q, own, a in rows[:40]:
        hits = sorted(((round(float(np.dot(a, b)), 5), c) for c, company, b in rows if company is not None and company == own and b), key=lambda h: (-h[0], h[1]))[:5]
        want |= {(q, c, s, i) for i, (s, c) in enumerate(hits, 1)}
    out = refine.ranked_dot(asked, chunks, 5)
    assert "Join" not in plan(out)
    assert {tuple(r) for r in out.collect()} == want
    some = asked.where("company_id IS NOT NULL AND embedding IS NOT NULL").select("query_id", F.col("embedding").alias("unit"), F.array("company_id").alias("groups"))
    blocks = retrieval.best_within(some, B.in_order(chunks).withColumnsRenamed({"company_id": "group", "embedding": "v"}), 5, block=7)
    assert {tuple(r) for r in blocks.collect()} == want


def test_commonest_character_in_one_walk(spark):
    from rookery.operators import damage

    texts = ["", "aab", "".join(chr(0x4E00 + i) for i in range(20_000)) * 2 + "一", "😀😀x"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", damage.commonest_share(F.col("t")).alias("share"))
    assert "array_distinct" not in plan(out)  # no search of the text for each of its characters
    assert {r.t: r.share for r in out.collect()} == {texts[0]: None, texts[1]: 2 / 3, texts[2]: 3 / 40_001, texts[3]: 2 / 3}


def test_lists_are_searched_in_tasks(spark):
    """With all lists probed the search is exact, and nothing is joined."""
    from rookery.operators import retrieval
    from rookery.plans.views import Domain

    vectors = Domain(spark, "/root/testdata/sf0.001").chunk_vectors
    asked = vectors.select(F.col("chunk_id").alias("query_id"), "embedding").where("CAST(chunk_id AS INT) < 40")
    out = retrieval.ann_topk(asked, vectors, 5, lists=4, probes=4)
    assert "Join" not in plan(out)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, retrieval.vector_topk(asked, vectors, 5).collect()))


def test_fields_are_scored_in_tasks(spark, talk, monkeypatch):
    """Nothing is written or shuffled that grows with the chunks, and neither limits of tasks nor blocks change a row."""
    queries, chunks = talk
    chunks = chunks.withColumn("name", F.concat(F.lit("Renewal "), F.right("chunk_id", F.lit(1))))
    rows, put = {}, I.written

    def counted(df, name):
        out = put(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(I, "written", counted)
    out = I.ngram_multi_field(queries, chunks, k=7)
    columns, want = out.columns, sorted(map(tuple, out.collect()))
    once = dict(rows)
    more = I.ngram_multi_field(queries, chunks.unionByName(chunks.withColumn("chunk_id", F.concat("chunk_id", F.lit("+")))), k=7)
    assert more.count() == len(want) > 100 and rows == once
    monkeypatch.setattr(I, "KNOWN", 3)
    monkeypatch.setattr(I, "NEAR", 0)
    many = I.ngram_multi_field(queries, chunks, k=7, block=60)
    assert many.columns == columns == ["query_id", "chunk_id", "score", "field", "rank"]
    assert sorted(map(tuple, many.collect())) == want


def test_grams_and_shapes_of_words(spark):
    from collections import Counter

    words = ["a", "ab", "été", "vertrag", "契約更新", "x1", "😀"]
    (grams,) = spark.createDataFrame([(" ".join(words),)], "t string").select(I.word_grams(F.col("t"))).first()
    assert Counter(map(I.gram_of, I.gram_codes(" ".join(words[:-1])).tolist())) == Counter(grams)
    assert all(I.gram_of(I.gram_code(g)) == g for g in grams)
    near = I.Near([("contract", 2), ("the", 1), ("of", 0)])
    assert near.among(["contract", "kontrakt", "ontrac", "contractors", "tho", "te", "off", "of", "fo", "zzz"]).tolist() == [True, True, True, False, True, True, False, True, True, False]
    assert near.among([]).tolist() == []


def test_best_takes_single_hits_in_any_order():
    rng = np.random.default_rng(2)
    scores = rng.integers(-3, 4, (60, 5))
    whole, single = B.Best(5, 4), B.Best(5, 4)
    names = np.array([f"{i:02}" for i in range(60)], object)
    whole.add(list(names), scores)
    place = single.places(60)
    for some in np.array_split(rng.permutation(300), 9):
        single.put(some % 5, (scores.ravel()[some] * B.SPAN + place[some // 5]), names[some // 5])
    rows = lambda best: {tuple(r) for part in best.rows(list("abcde")) for r in zip(part[0].to_pylist(), part[1].to_pylist(), part[2].tolist(), strict=True)}
    assert rows(single) == rows(whole) and len(rows(whole)) == 20


def test_tiles_of_vectors_change_no_hit(spark, monkeypatch):
    """Copies, vectors of no length and missing ones, in tiles of any size; a task reads no vector as Python objects."""
    from rookery.operators import retrieval

    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(40, 6)), 1)
    rows = [(f"{i:03}", [0.0] * 6 if i == 5 else [float(x) for x in vectors[i % 40 if i < 200 else 7]]) for i in range(400)] + [("null", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(5)
    asked = chunks.where("chunk_id < '060' OR chunk_id = 'null'").withColumnRenamed("chunk_id", "query_id")
    want = sorted(map(tuple, retrieval.vector_topk(asked.where("embedding IS NOT NULL"), chunks, 5).collect()))
    assert len(want) == 300
    monkeypatch.setattr(retrieval, "slices", None, raising=False)
    for sizes in ((4_096, 512, 512), (50, 3, 7)):
        for name, size in zip(("VECTORS", "TILE", "QUERY_BLOCK"), sizes, strict=True):
            monkeypatch.setattr(retrieval, name, size)
        assert sorted(map(tuple, retrieval.ann_topk(asked, chunks, 5, lists=3, probes=3).collect())) == want
