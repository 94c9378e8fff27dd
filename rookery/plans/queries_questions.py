"""Question understanding and retrieval over questions, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import questions as Q
from ..operators import retrieval as R
from ..operators.best import best_matched, in_order, matched_counts
from .queries_corpus import CHUNKS, chunks_of
from .registry import query

#: Words of the stored texts, so that the category rules are exercised.
WORDS = {"procedure": ["the", "with"], "finance": ["des", "pour"], "technical": ["der", "ein"], "schedule": ["que", "los"]}


def turns(d):
    return d.chat_turns.select("id", F.col("user_message").alias("text"))


CATEGORY = """c AS (SELECT id, user_message AS text, list_max([{'n': (CAST(contains(lower(user_message), 'the') AS INT) + CAST(contains(lower(user_message), 'with') AS INT)), 'o': 0, 'name': 'procedure'},
 {'n': CAST(contains(lower(user_message), 'des') AS INT) + CAST(contains(lower(user_message), 'pour') AS INT), 'o': -1, 'name': 'finance'},
 {'n': CAST(contains(lower(user_message), 'der') AS INT) + CAST(contains(lower(user_message), 'ein') AS INT), 'o': -2, 'name': 'technical'},
 {'n': CAST(contains(lower(user_message), 'que') AS INT) + CAST(contains(lower(user_message), 'los') AS INT), 'o': -3, 'name': 'schedule'}]) AS b FROM chat_turns)"""


@query("q1_categories", f"WITH {CATEGORY} SELECT id, CASE WHEN b.n > 0 THEN b.name ELSE 'general' END AS category, CAST(b.n AS BIGINT) AS hits, round(least(0.8, b.n * 0.2), 6) AS confidence FROM c")
def categories(d):
    rows = turns(d).select("id", Q.categorise(F.col("text"), WORDS).alias("c"))
    return rows.select("id", F.col("c.category"), F.col("c.hits"), F.round("c.confidence", 6).alias("confidence"))


PROFILE = r"""p AS (SELECT id, user_message AS t, CASE WHEN trim(lower(user_message)) = '' OR regexp_matches(trim(lower(user_message)), '^(hi|hello|hey|thanks|thank you|ok|bye|こんにちは|ありがとう|おはよう|了解)[!. 。！]*$') THEN 'casual'
 WHEN trim(lower(user_message)) LIKE '%?' OR trim(lower(user_message)) LIKE '%？' OR regexp_matches(trim(lower(user_message)), '^(who|what|when|where|why|how|which|is|are|can|do|does)( |$)') THEN 'question'
 WHEN regexp_matches(trim(lower(user_message)), '(please|お願い|ください)') THEN 'request' ELSE 'statement' END AS intent FROM chat_turns),
 prof AS (SELECT id, intent, intent <> 'casual' AS needs_search,
 CAST(len(regexp_extract_all(t, '[.!?。！？]')) >= 3 AS INT) + CAST(len(regexp_extract_all(t, '[,;、]')) >= 4 AS INT) + CAST(len(regexp_extract_all(t, '(^|\n) *([0-9]+[.)]|[-*])')) >= 2 AS INT)
 + CAST(len(regexp_extract_all(t, '[?？]')) >= 2 AS INT) + CAST(length(t) > 300 AS INT) >= 2 AS split, length(t) AS length, regexp_matches(t, '[^\x00-\x7F]') AS non_ascii FROM p)"""


@query("q4_profile_questions", f"WITH {PROFILE} SELECT * FROM prof")
def profile_questions(d):
    return Q.profile_questions(turns(d)).drop("category", "confidence")


@query("q4_intent_distribution", f"WITH {PROFILE} SELECT intent, count(*) AS n, round(avg(length), 6) AS mean_length FROM prof GROUP BY 1")
def intent_distribution(d):
    return Q.question_distribution(Q.profile_questions(turns(d))).where("category IS NULL").select("intent", "n", "mean_length")


@query(
    "q10_keywords",
    r"""WITH k AS (SELECT id, list_concat(list_concat(regexp_extract_all(user_message, '([ァ-ヶー]{3,})', 1), regexp_extract_all(user_message, '([一-龯]{2,})', 1)),
 list_concat(regexp_extract_all(user_message, '([A-Za-z]{2,})', 1), regexp_extract_all(user_message, '([0-9]+(?:円|件|人|日|月|年|%))', 1))) AS w FROM chat_turns),
 u AS (SELECT id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS keyword FROM k), f AS (SELECT id, keyword, min(i) AS i FROM u GROUP BY 1, 2),
 r AS (SELECT id, keyword, row_number() OVER (PARTITION BY id ORDER BY i) AS place FROM f) SELECT id, place, keyword FROM r WHERE place <= 5""",
)
def keywords(d):
    rows = turns(d).select("id", F.posexplode(Q.important_keywords(F.col("text"))).alias("p", "keyword"))
    return rows.select("id", (F.col("p") + 1).alias("place"), "keyword")


@query(
    "q22_canonical",
    r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(user_message), '[\t\n\r ]+', ' ', 'g')), 'e-?mail', 'email', 'g'), 'web ?site', 'website', 'g'), 'log ?in', 'login', 'g'), 'log ?out', 'logout', 'g') AS text FROM chat_turns""",
)
def canonical(d):
    return turns(d).select("id", Q.canonical(F.col("text")).alias("text"))


@query("q26_variants")
def variants(d):
    return Q.explode_variants(turns(d))


@query("q15_split_questions")
def split_questions(d):
    return Q.split_questions(turns(d))


@query("q15_split_search_merge")
def split_search_merge(d):
    """Long questions in parts, BM25 hits of each part, the best of them per question."""
    parts = Q.split_questions(turns(d)).withColumn("query_id", F.concat_ws("#", "id", "part_no"))
    chunks = chunks_of(d)
    hits = R.bm25(R.keywords_of(parts.select("query_id", F.col("part").alias("text"))), chunks, 10)
    return Q.merge_parts(hits, parts)


@query("q26_expand_and_search")
def expand_and_search(d):
    """Questions in all their ways against the chunks; the best way for each hit."""
    ways = Q.explode_variants(d.benchmark.select(F.col("item_id").cast("string").alias("id"), "text")).withColumn("query_id", F.concat_ws("#", "id", "variant_no"))
    hits = R.bm25(R.keywords_of(ways.select("query_id", F.col("variant").alias("text"))), chunks_of(d), 10)
    found = hits.join(ways.select("query_id", "id", "variant_no"), "query_id")
    best = found.groupBy("id", "chunk_id").agg(F.max("score").alias("score"), F.max_by("variant_no", F.struct("score", -F.col("variant_no"))).alias("variant_no"))
    return R.top_k(best, 10, by=["id"])


TIERS = r"""qw AS (SELECT CAST(item_id AS VARCHAR) AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 2)) AS w FROM benchmark),
 tok AS (SELECT DISTINCT chunk_id, unnest(list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 2)) AS word FROM chunks),
 qt AS (SELECT query_id, len(w) AS words, unnest(w) AS word FROM qw), m AS (SELECT query_id, chunk_id, any_value(words) AS words, count(*) AS matched FROM qt JOIN tok ON tok.word = qt.word GROUP BY 1, 2),
 tier AS (SELECT query_id, chunk_id, matched, CASE WHEN matched = words THEN 4.0 WHEN matched * 2 >= words THEN 3.5 ELSE 3.0 END AS score FROM m)"""


def words(text):
    """Distinct words of two letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) >= 2))


def asked_words(d):
    return d.benchmark.select(F.col("item_id").cast("string").alias("query_id"), words(F.col("text")).alias("items"))


def tiers(d, chunks, k):
    """Of each question and kind the k best chunks (chunk_id, content, kind), by whether they hold all, half or any of its words."""
    texts = in_order(chunks).select("chunk_id", words(F.col("content")).alias("words"), "kind", F.lit(0).cast("long").alias("carried"))
    best = best_matched(asked_words(d), texts, k)
    score = F.when(F.col("matched") == F.col("size"), 4.0).when(F.col("matched") * 2 >= F.col("size"), 3.5).otherwise(3.0)
    return best.select("query_id", "chunk_id", "kind", "matched", score.alias("score"))


@query(
    "r9_tiered_search",
    CHUNKS + ", " + TIERS + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, matched DESC, chunk_id) AS rank FROM tier) SELECT query_id, chunk_id, matched, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 10",
)
def tiered_search(d):
    rows = tiers(d, chunks_of(d).select("chunk_id", "content", F.lit("").alias("kind")), 10).drop("kind")
    return R.top_k(rows, 10, order=[F.desc("score"), F.desc("matched"), F.col("chunk_id")])


@query(
    "r10_balanced_search",
    CHUNKS
    + ", "
    + TIERS
    + """, ty AS (SELECT t.*, s.type FROM tier t JOIN chunks c ON c.chunk_id = t.chunk_id JOIN document_sources s ON s.id = CAST(c.doc_id AS VARCHAR)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY score DESC, matched DESC, chunk_id) AS rank FROM ty) SELECT query_id, chunk_id, type, rank FROM r WHERE rank <= 3""",
)
def balanced_search(d):
    types = d.document_sources.select(F.col("id").cast("long").alias("doc_id"), F.col("type").alias("kind"))
    rows = tiers(d, chunks_of(d).join(types, "doc_id").select("chunk_id", "content", "kind"), 3).withColumnRenamed("kind", "type")
    return R.top_k(rows, 3, by=["query_id", "type"], order=[F.desc("score"), F.desc("matched"), F.col("chunk_id")]).select("query_id", "chunk_id", "type", "rank")


@query(
    "a52_hit_statistics",
    CHUNKS + ", " + TIERS + " SELECT query_id, count(*) AS found, count(*) FILTER (score >= 3.5) AS kept, round(CAST(count(*) FILTER (score >= 3.5) AS DOUBLE) / count(*), 6) AS rate FROM tier GROUP BY 1",
)
def hit_statistics(d):
    counts = matched_counts(asked_words(d), chunks_of(d).select(words(F.col("content")).alias("words")), 0.5)
    return counts.select("query_id", "found", "kept", F.round(F.col("kept") / F.col("found"), 6).alias("rate"))


@query(
    "r27_adaptive_routes",
    """SELECT CASE WHEN length(user_message) > 100 OR len(string_split(user_message, ' ')) > 15 THEN 'parallel' WHEN regexp_matches(user_message, '[ぁ-んァ-ヶ一-龯]') AND len(string_split(user_message, ' ')) <= 5 THEN 'enhanced' ELSE 'basic' END AS route, count(*) AS n FROM chat_turns GROUP BY 1""",
)
def adaptive_routes(d):
    words = F.size(F.split("text", " "))
    route = F.when((F.char_length("text") > 100) | (words > 15), "parallel").when(F.col("text").rlike("[ぁ-んァ-ヶ一-龯]") & (words <= 5), "enhanced").otherwise("basic")
    return turns(d).groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("k2_question_sample")
def question_sample(d):
    """A repeatable sample of 50 questions: by a hash of the id."""
    return turns(d).orderBy(F.xxhash64("id", F.lit(42)), "id").limit(50)
