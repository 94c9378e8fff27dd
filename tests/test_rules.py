import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rookery.functions import rules
from rookery.operators import corpus, maintain, questions, refine, retrieval, textindex, usage
from rookery.plans.views import Domain


def values(spark, rows, make):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("v"))).collect()]


def test_email_and_name_problems(spark):
    mails = ["ada@x.example.com", None, "a@b", "a..b@x.com", "a@b@x.com", "a b@x.com", "x" * 101 + "@x.com", 'a"@x.com']
    assert values(spark, mails, rules.email_problem) == [None, "empty", "too short", "two dots", "not one @", "malformed", "too long", "forbidden character"]
    assert values(spark, ["Ada", " ", "x" * 51, "a<b"], rules.name_problem) == [None, "empty", "too long", "forbidden character"]


def test_null_words_and_casts(spark):
    assert values(spark, ["nan", " N/A ", None, " x "], rules.blank_null_words) == ["", "", "", "x"]
    assert values(spark, ["a nan b none", "nancy null"], rules.strip_null_words) == ["a b", "nancy"]
    assert values(spark, ["12", "x", None], rules.safe_long) == [12, 0, 0]
    assert values(spark, ["a.PDF", "b.xlsx", "https://x/y.pdf", "c"], rules.file_kind) == ["pdf", "excel", "url", "other"]


@pytest.mark.parametrize("tokens, yen", [(0, 150_000), (25_000_000, 150_000), (25_000_001, 150_000.01), (50_000_000, 525_000), (75_000_000, 825_000), (100_000_000, 1_075_000)])
def test_yen_plan_edges(spark, tokens, yen):
    assert spark.range(1).select(usage.yen_plan(F.lit(tokens))).first()[0] == pytest.approx(yen, abs=0.01)


def test_two_tier_edges(spark):
    rows = spark.createDataFrame([(0,), (200_000,), (200_001,)], "t long").select(usage.two_tier_cost(F.col("t"))).collect()
    assert [r[0] for r in rows] == [0.0, 0.25, pytest.approx(0.250003, abs=1e-6)]


def test_width_kana_and_notation(spark):
    assert values(spark, ["AZ 09!"], refine.to_full) == ["ＡＺ　０９！"] and values(spark, ["ＡＺ　０９！"], refine.to_half) == ["AZ 09!"]
    assert values(spark, ["かな"], refine.to_katakana) == ["カナ"] and values(spark, ["カナァ"], refine.to_hiragana) == ["かなァ"]
    assert values(spark, ["Ｅ-mail  サーバー", "Log in web site"], questions.canonical) == ["email サーバ", "login website"]
    assert values(spark, ["ありがとう", "How does it work?", "資料をください", "plain"], questions.intent) == ["casual", "question", "request", "statement"]
    assert values(spark, ["料金の請求方法", "nothing"], lambda c: questions.categorise(c)["category"]) == ["finance", "general"]
    assert values(spark, ["サーバの障害対応を3件 AB株式会社"], questions.important_keywords) == [["サーバ", "障害対応", "株式会社", "AB", "3件"]]


def test_question_variants_and_parts(spark):
    frame = spark.createDataFrame([("1", "ABC株式会社 の 料金")], "id string, text string")
    ways = [r.variant for r in questions.explode_variants(frame).orderBy("variant_no").collect()]
    assert ways[0] == "ABC株式会社 の 料金" and "ABC株式会社の料金" in ways and "ABC 株式会社 の 料金" in ways and len(ways) == len(set(ways))
    text = spark.createDataFrame([("1", "First question here? Ok. The second one is longer.\n3. item")], "id string, text string")
    assert [r.part for r in questions.split_questions(text).orderBy("part_no").collect()] == ["First question here? Ok.", "The second one is longer. 3. item"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=4000))
def test_chunks_cover_the_text(text):
    cuts = corpus.cut_points(text)
    covered = set()
    for s, e in cuts:
        assert 0 <= s < e <= len(text) and e - s <= 800
        covered |= set(range(s, e))
    assert covered == set(range(len(text)))
    assert all(b[0] - a[0] >= 600 for a, b in zip(cuts, cuts[1:], strict=False))


def test_trigram_similarity_is_symmetric(spark):
    texts = ["hello world", "hello word", "world hello", "other"]
    both = spark.createDataFrame([(str(i), t, t) for i, t in enumerate(texts)], "id string, text string, content string")
    hits = textindex.fuzzy_topk(both.withColumnRenamed("id", "query_id"), both.withColumnRenamed("id", "chunk_id"), threshold=0.0).collect()
    found = {(h.query_id, h.chunk_id): h.similarity for h in hits}
    assert all(found[b, a] == s and 0 <= s <= 1 for (a, b), s in found.items()) and found["0", "0"] == found["0", "2"] == 1.0


def test_vector_search_ignores_scale(spark):
    d = Domain(spark, "/root/testdata/sf0.001")
    asked = d.chunk_vectors.where("CAST(chunk_id AS INT) % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    scaled = asked.withColumn("embedding", F.transform("embedding", lambda x: (x * 8).cast("float")))
    rows = lambda q: sorted((r.query_id, r.chunk_id, r.score) for r in retrieval.vector_topk(q, d.chunk_vectors, 5).collect())
    assert rows(asked) == rows(scaled)


def test_repairs_are_idempotent(spark):
    d = Domain(spark, "/root/testdata/sf0.001")
    once = maintain.with_missing_quota(d.users, d.usage_limits)
    assert maintain.with_missing_quota(d.users, once).count() == once.count() == d.users.count()
    unified = maintain.unify_companies(d.users, d.usage_limits)
    again = maintain.unify_companies(d.users, unified)
    assert sorted(map(repr, unified.collect())) == sorted(map(repr, again.collect()))
