"""Searches over posting lists, with their DuckDB twins that compare everything with everything."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quotas as K
from ..operators import textindex as I
from ..operators.retrieval import vector_topk
from .queries_corpus import CHUNKS, WORDS, chunks_of
from .registry import query

#: Words of every twentieth document; patterns and phrases are made of them.
TWENTIETH = f", own AS (SELECT CAST(doc_id AS VARCHAR) AS query_id, doc_id, {WORDS.format(t='text', n=1)} AS w FROM documents WHERE doc_id % 20 = 0)"


def twentieth(d):
    return d.documents.where("doc_id % 20 = 0").select(F.col("doc_id").cast("string").alias("query_id"), "doc_id", I.words_of(F.col("text")).alias("w"))


def word(i: int):
    return F.get("w", F.lit(i - 1))


@query(
    "j16_substring_chunks",
    CHUNKS
    + TWENTIETH
    + """, p AS (SELECT DISTINCT substr(w[2], 2) || ' ' || left(w[3], 3) AS pattern FROM own WHERE w[3] IS NOT NULL UNION SELECT DISTINCT substr(w[4], 2, 5) FROM own WHERE w[4] IS NOT NULL)
 SELECT pattern, chunk_id FROM p JOIN chunks ON contains(lower(content), lower(pattern)) WHERE pattern <> ''""",
)
def substring_chunks(d):
    own = twentieth(d)
    across = own.select(F.concat(F.substr(word(2), F.lit(2)), F.lit(" "), F.left(word(3), F.lit(3))).alias("pattern"))
    return I.substring_hits(across.union(own.select(F.substr(word(4), F.lit(2), F.lit(5)))), chunks_of(d))


@query(
    "r6_smart_search",
    CHUNKS
    + TWENTIETH
    + """, need AS (SELECT query_id, unnest([w[2], w[3]]) AS word FROM own WHERE doc_id % 60 <> 0), syn AS (SELECT query_id, 1 AS g, unnest([w[4], left(w[5], 4)]) AS word FROM own UNION ALL SELECT query_id, 2, unnest([w[6], w[7]]) FROM own WHERE doc_id % 40 = 0),
 n AS (SELECT * FROM need WHERE word <> ''), s AS (SELECT * FROM syn WHERE word <> ''), asked AS (SELECT query_id FROM n UNION SELECT query_id FROM s)
 SELECT a.query_id, chunk_id FROM asked a, chunks c WHERE (a.query_id NOT IN (SELECT query_id FROM n) OR EXISTS (SELECT 1 FROM n WHERE n.query_id = a.query_id AND contains(lower(c.content), n.word)))
 AND (SELECT count(DISTINCT g) FROM s WHERE s.query_id = a.query_id) = (SELECT count(DISTINCT g) FROM s WHERE s.query_id = a.query_id AND contains(lower(c.content), s.word))""",
)
def smart_search(d):
    own = twentieth(d)
    required = own.where("doc_id % 60 <> 0").select("query_id", F.explode(F.array(word(2), word(3))).alias("word"))
    groups = own.select("query_id", F.lit(1).alias("group_no"), F.explode(F.array(word(4), F.left(word(5), F.lit(4)))).alias("word"))
    more = own.where("doc_id % 40 = 0").select("query_id", F.lit(2).alias("group_no"), F.explode(F.array(word(6), word(7))).alias("word"))
    return I.smart_search(chunks_of(d), required, groups.union(more))


@query(
    "r26_wildcard",
    CHUNKS
    + TWENTIETH
    + """, p AS (SELECT DISTINCT left(w[2], 4) || '*' || right(w[4], 3) || '?' || w[5] AS pattern FROM own WHERE w[5] IS NOT NULL UNION SELECT DISTINCT '*' || upper(w[3]) || '*' FROM own WHERE w[3] IS NOT NULL)
 SELECT pattern, chunk_id FROM p JOIN chunks ON lower(content) LIKE '%' || replace(replace(lower(pattern), '*', '%'), '?', '_') || '%'""",
)
def wildcard(d):
    own = twentieth(d)
    first = F.concat(F.left(word(2), F.lit(4)), F.lit("*"), F.right(word(4), F.lit(3)), F.lit("?"), word(5))
    return I.wildcard_hits(own.select(first.alias("pattern")).union(own.select(F.concat(F.lit("*"), F.upper(word(3)), F.lit("*")))), chunks_of(d))


@query(
    "r26_regex",
    CHUNKS
    + TWENTIETH
    + r""", p AS (SELECT DISTINCT w[2] || '[,.]? [a-z]+[,.]? ' || w[4] AS pattern FROM own WHERE w[4] IS NOT NULL UNION SELECT DISTINCT '(' || w[3] || '|' || w[5] || ') ' || w[6] FROM own WHERE doc_id % 100 = 0 AND w[6] IS NOT NULL UNION SELECT '[0-9]{3}-[0-9]{2}')
 SELECT pattern, chunk_id FROM p JOIN chunks ON regexp_matches(content, pattern, 'i')""",
)
def regex(d):
    own = twentieth(d)
    plain = own.select(F.concat(word(2), F.lit("[,.]? [a-z]+[,.]? "), word(4)).alias("pattern"))
    either = own.where("doc_id % 100 = 0").select(F.concat(F.lit("("), word(3), F.lit("|"), word(5), F.lit(") "), word(6)))
    numbers = d.spark.createDataFrame([("[0-9]{3}-[0-9]{2}",)], "pattern string")
    return I.regex_hits(plain.union(either).union(numbers), chunks_of(d))


#: Phrases of two to five words, and the chunks that hold them.
PHRASES = f""", q AS (SELECT query_id, list_slice(w, 2, 3 + (doc_id // 20) % 3) AS w FROM own WHERE len(w) >= 2), qp AS (SELECT query_id, len(w) AS size, unnest(range(0, len(w))) AS number, unnest(w) AS word FROM q),
 cw AS (SELECT chunk_id, {WORDS.format(t="content", n=1)} AS w FROM chunks), cp AS (SELECT chunk_id, unnest(range(0, len(w))) AS position, unnest(w) AS word FROM cw),
 m AS (SELECT query_id, size, number, qp.word, chunk_id, position, position - number - o AS start, o FROM qp JOIN cp ON cp.word = qp.word, range(0, 3) AS r(o)),
 e AS (SELECT query_id, size, chunk_id, start, word, number, min(o) AS o FROM m GROUP BY ALL), f AS (SELECT query_id, chunk_id, start, word, count(DISTINCT position) AS places FROM m GROUP BY ALL),
 g AS (SELECT query_id, size, chunk_id, start, word, count(*) AS numbers, max(o) AS o FROM e GROUP BY ALL),
 h AS (SELECT query_id, chunk_id, start, size, sum(numbers) AS numbers, max(o) AS slack FROM g JOIN f USING (query_id, chunk_id, start, word) WHERE places >= numbers GROUP BY ALL),
 b AS (SELECT query_id, chunk_id, min(slack) AS slack FROM h WHERE numbers = size GROUP BY ALL)"""


@query(
    "r26_phrase_slop",
    CHUNKS
    + TWENTIETH
    + PHRASES
    + " SELECT query_id, chunk_id, slack, round(1.0::DOUBLE / (1 + slack), 6) AS score FROM b",
)
def phrase_slop(d):
    return I.phrase_hits(phrases(d), chunks_of(d))


def phrases(d):
    phrase = F.array_join(F.slice("w", F.lit(2), (2 + F.floor(F.col("doc_id") / 20) % 3).cast("int")), " ")
    return twentieth(d).where(F.size("w") >= 2).select("query_id", phrase.alias("text"))


#: Tiers of the phrases' chunks, of active documents and with their type.
TYPED = """, aw AS (SELECT query_id, array_to_string(w, ' ') AS t, list_distinct(list_filter(w, lambda x: length(x) > 1)) AS ws FROM q),
 tm AS (SELECT query_id, chunk_id, doc_id, contains(lower(content), t) AS whole, len(list_filter(ws, lambda x: contains(lower(content), x))) AS n, len(ws) AS size FROM aw, chunks WHERE length(content) > 10),
 tier AS (SELECT query_id, chunk_id, doc_id, CASE WHEN whole THEN 2 WHEN n = size THEN 1 ELSE 0 END AS level FROM tm WHERE n > 0),
 typed AS (SELECT query_id, chunk_id, s.type, level FROM tier JOIN document_sources s ON s.id = CAST(doc_id AS VARCHAR) WHERE s.active)"""


def active_chunks(d):
    chunks = chunks_of(d).where(F.char_length("content") > 10)
    kinds = d.document_sources.where("active").select(F.col("id").cast("long").alias("doc_id"), "type")
    return chunks.join(kinds, "doc_id").select("chunk_id", "content", "type")


@query(
    "r9_type_focused",
    CHUNKS
    + TWENTIETH
    + PHRASES
    + TYPED
    + """ SELECT * FROM (SELECT query_id, chunk_id, type, CAST(level + 3 AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY level DESC, chunk_id) AS rank FROM typed WHERE type = 'excel') AS r WHERE rank <= 10""",
)
def type_focused(d):
    hits = K.tiered_best(phrases(d), active_chunks(d).where("type = 'excel'"), 5, 4, 3, 10)
    return K.type_focused(hits, "excel", 10).select("query_id", "chunk_id", "type", "score", "rank")


SHARED = """, own_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY level DESC, chunk_id) AS own FROM typed),
 shared AS (SELECT query_id, chunk_id, type, CAST(level + 2 AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY level DESC, chunk_id) AS rank FROM own_rank WHERE own <= CASE type WHEN 'pdf' THEN 3 WHEN 'excel' THEN 3 ELSE 2 END)"""


@query("r10_type_quotas", CHUNKS + TWENTIETH + PHRASES + TYPED + SHARED + " SELECT * FROM shared WHERE rank <= 10")
def type_quotas(d):
    hits = K.tiered_best(phrases(d), active_chunks(d), 4, 3, 2, max(K.places_by_type(10, K.TYPES).values()))
    return K.share_by_type(hits, 10)


@query(
    "r36_staged_fallback",
    CHUNKS
    + TWENTIETH
    + PHRASES
    + TYPED
    + SHARED
    + f""", act AS (SELECT c.chunk_id, c.content, s.type FROM chunks c JOIN document_sources s ON s.id = CAST(c.doc_id AS VARCHAR) WHERE s.active AND length(content) > 10),
 qq AS (SELECT DISTINCT query_id, word FROM qp), aww AS (SELECT chunk_id, word, count(*) AS n FROM (SELECT chunk_id, unnest({WORDS.format(t="content", n=1)}) AS word FROM act) GROUP BY ALL),
 qs AS (SELECT query_id, count(*) AS size FROM qq GROUP BY 1),
 every AS (SELECT query_id, chunk_id, round(sum(n / (n + 1.0::DOUBLE)) / any_value(size), 6) AS score FROM qq JOIN aww ON aww.word = qq.word JOIN qs USING (query_id) GROUP BY 1, 2 HAVING count(*) = any_value(size)),
 un AS (SELECT b.query_id, b.chunk_id, round(1.0::DOUBLE / (1 + slack), 6) AS score, 0 AS no, 'phrase' AS stage, 3 AS least FROM b JOIN act USING (chunk_id) UNION ALL SELECT query_id, chunk_id, score, 1, 'words', 2 FROM every
 UNION ALL SELECT query_id, chunk_id, score, 2, 'balanced', 1 FROM shared WHERE rank <= 10),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, no ORDER BY score DESC, chunk_id) AS rank FROM un), cn AS (SELECT *, count(*) OVER (PARTITION BY query_id, no) AS have FROM rk WHERE rank <= 10),
 ch AS (SELECT *, min(no) OVER (PARTITION BY query_id) AS first FROM cn WHERE have >= least), hit AS (SELECT ch.*, act.type FROM ch JOIN act USING (chunk_id) WHERE no = first),
 short AS (SELECT query_id FROM hit GROUP BY 1 HAVING count(*) FILTER (type = 'pdf') < 2 AND min(no) = 0),
 more AS (SELECT query_id, chunk_id, CAST(level + 3 AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY level DESC, chunk_id) AS rank FROM typed WHERE type = 'pdf'),
 two AS (SELECT query_id, chunk_id, score, rank, 0 AS part, stage FROM hit UNION ALL SELECT query_id, chunk_id, score, rank, 1, 'top-up' FROM more JOIN short USING (query_id) WHERE rank <= 5),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY part) AS r FROM two) AS t WHERE r = 1),
 out AS (SELECT query_id, chunk_id, score, stage, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS rank FROM one) SELECT * FROM out WHERE rank <= 10""",
)
def staged_fallback(d):
    chunks, asked = I.written(active_chunks(d), "fallback-chunks"), phrases(d)  # cut once for all searches
    kinds = chunks.select("chunk_id", "type")
    tiers = I.written(K.tiered_best(asked, chunks, 2, 1, 0, 5), "fallback-tiers")  # five of a type are the most that is taken below
    balanced = K.share_by_type(tiers.withColumn("score", F.col("score") + 2), 10)
    chosen = K.first_sufficient([("phrase", I.phrase_hits(asked, chunks, first=10), 3), ("words", I.all_words_rank(asked, chunks, first=10), 2), ("balanced", balanced, 1)], 10)
    more = K.type_focused(tiers.withColumn("score", F.col("score") + 3), "pdf", 5)
    return K.top_up(chosen.join(kinds, "chunk_id"), more, "pdf", 2, "phrase", 5, 10)


GRAM_SET = r"""list_distinct(flatten(list_transform(list_filter(string_split_regex({t}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""
NORMAL = r"trim(regexp_replace(lower({t}), '[\t\n\r ]+', ' ', 'g'))"


@query(
    "r4_fuzzy_union",
    f"""WITH q AS (SELECT id AS query_id, user_message AS t FROM chat_turns WHERE conv_id % 20 = 0), c AS (SELECT id AS chunk_id, user_message AS t FROM chat_turns),
 qg AS (SELECT query_id, {GRAM_SET.format(t=NORMAL.format(t="t"))} AS g FROM q), cg AS (SELECT chunk_id, {GRAM_SET.format(t=NORMAL.format(t="t"))} AS g FROM c),
 sim AS (SELECT query_id, chunk_id, round(CAST(len(list_intersect(qg.g, cg.g)) AS DOUBLE) / len(list_distinct(list_concat(qg.g, cg.g))), 6) AS score FROM qg, cg),
 qw AS (SELECT DISTINCT query_id, unnest({WORDS.format(t="t", n=1)}) AS word FROM q), cw AS (SELECT chunk_id, word, count(*) AS n FROM (SELECT chunk_id, unnest({WORDS.format(t="t", n=1)}) AS word FROM c) GROUP BY ALL),
 size AS (SELECT query_id, count(*) AS size FROM qw GROUP BY 1),
 text AS (SELECT query_id, chunk_id, round(sum(n / (n + 1.0::DOUBLE)) / any_value(size), 6) AS score FROM qw JOIN cw ON cw.word = qw.word JOIN size USING (query_id) GROUP BY 1, 2 HAVING count(*) = any_value(size)),
 un AS (SELECT query_id, chunk_id, score, 'trigram' AS method FROM sim WHERE score > 0.2 UNION ALL SELECT query_id, chunk_id, score, 'fulltext' FROM text
 UNION ALL SELECT query_id, chunk_id, CAST(0.5 AS DOUBLE), 'like' FROM q JOIN c ON contains(lower(c.t), lower(q.t)) WHERE q.t <> ''),
 best AS (SELECT query_id, chunk_id, max(score) AS score, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM un GROUP BY 1, 2)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best) AS r WHERE rank <= 25""",
)
def fuzzy_union(d):
    asked = d.chat_turns.where("conv_id % 20 = 0").select(F.col("id").alias("query_id"), F.col("user_message").alias("text"))
    return I.fuzzy_union(asked, d.chat_turns.select(F.col("id").alias("chunk_id"), F.col("user_message").alias("content")))


#: DuckDB counts edits in bytes: letters beyond ASCII are told apart by letters that lower-cased words don't have.
ASCII = "translate({t}, 'àâäáçéèêëîïíôöóùûüúßñœæ', 'ABCDEFGHIJKLMNOPQRSTUVW')"


@query(
    "r25_ngram_multi_field",
    CHUNKS
    + f""", named AS (SELECT chunk_id, content, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS name FROM chunks c JOIN documents d ON d.doc_id = c.doc_id),
 cut AS (SELECT chunk_id, {WORDS.format(t="content", n=1)} AS words, {WORDS.format(t="name", n=1)} AS names FROM named),
 lists AS (SELECT chunk_id, 'content' AS field, words AS items FROM cut UNION ALL SELECT chunk_id, 'name', names FROM cut
 UNION ALL SELECT chunk_id, 'grams', flatten(list_transform(words, lambda w: list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))))) FROM cut),
 post AS (SELECT chunk_id, field, match, count(*) AS n, any_value(length) AS length FROM (SELECT chunk_id, field, len(items) AS length, unnest(items) AS match FROM lists) GROUP BY 1, 2, 3),
 mean AS (SELECT field, avg(length) AS mean FROM (SELECT DISTINCT field, chunk_id, length FROM post) GROUP BY 1), df AS (SELECT field, match, count(*) AS df FROM post GROUP BY 1, 2), total AS (SELECT count(*) AS total FROM chunks),
 qw AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {WORDS.format(t="text", n=1)} AS words FROM benchmark WHERE item_id % 20 = 0),
 asked AS (SELECT DISTINCT query_id, 'word' AS kind, unnest(words) AS term FROM qw
 UNION SELECT query_id, 'gram', unnest(flatten(list_transform(words, lambda w: list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))))) FROM qw),
 term AS (SELECT DISTINCT term FROM asked WHERE kind = 'word'), vocabulary AS (SELECT DISTINCT match FROM post WHERE field <> 'grams'),
 dist AS (SELECT term, match, levenshtein({ASCII.format(t="term")}, {ASCII.format(t="match")}) AS d FROM term, vocabulary WHERE abs(length(term) - length(match)) <= 2),
 ways AS (SELECT 'word' AS kind, term, match, 1.0::DOUBLE - d / length(term)::DOUBLE AS share FROM dist WHERE d <= CASE WHEN length(term) >= 6 THEN 2 WHEN length(term) >= 3 THEN 1 ELSE 0 END
 UNION ALL SELECT DISTINCT 'gram', term, term, 1.0::DOUBLE FROM asked WHERE kind = 'gram'),
 bits AS (SELECT query_id, chunk_id, p.field, a.term, max(share * ln(1 + (total - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (1 - 0.75 + 0.75 * length / mean))) AS part FROM asked a JOIN ways w ON w.kind = a.kind AND w.term = a.term
 JOIN post p ON p.match = w.match AND (p.field = 'grams') = (a.kind = 'gram') JOIN df ON df.field = p.field AND df.match = p.match JOIN mean ON mean.field = p.field, total GROUP BY 1, 2, 3, 4),
 scored AS (SELECT query_id, chunk_id, field, CASE field WHEN 'content' THEN 3 WHEN 'name' THEN 2 ELSE 1 END * sum(part) AS score FROM bits GROUP BY 1, 2, 3),
 top AS (SELECT query_id, chunk_id, round(max(score), 6) AS score, arg_max(field, score) AS field FROM scored GROUP BY 1, 2)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM top) AS r WHERE rank <= 20""",
)
def ngram_multi_field(d):
    title = F.array_join(F.slice(F.split("text", " ", 4), 1, 3), " ")
    asked = d.benchmark.where("item_id % 20 = 0").select(F.col("item_id").cast("string").alias("query_id"), "text")
    return I.ngram_multi_field(asked, chunks_of(d, title).where("doc_id IS NOT NULL"))


@query(
    "r19_type_backfill",
    """WITH v AS (SELECT q.chunk_id AS query_id, c.chunk_id, round(CAST(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
 / sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) AS DOUBLE), 5) AS score FROM chunk_vectors q, chunk_vectors c WHERE CAST(q.chunk_id AS INT) % 20 = 0),
 h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM v) AS t WHERE r <= 20 AND score >= 0.3), q AS (SELECT DISTINCT query_id FROM v),
 miss AS (SELECT id AS chunk_id FROM document_sources WHERE type = 'excel' AND active AND page_count > 1 ORDER BY id LIMIT 10), new AS (SELECT id AS chunk_id FROM document_sources WHERE active ORDER BY CAST(id AS BIGINT) DESC, id LIMIT 15),
 n0 AS (SELECT query_id, count(h.chunk_id) AS own FROM q LEFT JOIN h USING (query_id) GROUP BY 1),
 a AS (SELECT query_id, chunk_id, score, 'vector' AS source, 0 AS part FROM h UNION ALL SELECT query_id, chunk_id, 0.5, 'type', 1 FROM n0, miss WHERE own < 20 UNION ALL SELECT query_id, chunk_id, 0.4, 'newest', 2 FROM q, new),
 o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY part) AS r FROM a) AS t WHERE r = 1), g AS (SELECT *, count(*) FILTER (part < 2) OVER (PARTITION BY query_id) AS n FROM o),
 k AS (SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, source FROM g WHERE part < 2 OR n < 15)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k) AS t WHERE rank <= 20""",
)
def type_backfill(d):
    asked = d.chunk_vectors.where("CAST(chunk_id AS INT) % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    hits = vector_topk(asked, d.chunk_vectors, 20).where("score >= 0.3").drop("rank")
    missing = d.document_sources.where("type = 'excel' AND active AND page_count > 1").select(F.col("id").alias("chunk_id"))
    newest = d.document_sources.where("active").select(F.col("id").alias("chunk_id"), F.col("id").cast("long").alias("at"))
    return K.vector_with_type_backfill(asked.select("query_id"), hits, missing, newest)
