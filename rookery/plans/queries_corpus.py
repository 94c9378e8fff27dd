"""Ingestion and retrieval queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import retrieval as R
from ..operators import textindex as I
from .registry import query

CUT = """CASE WHEN {s} + 700 >= length(text) THEN length(text)
 WHEN strpos(reverse(substr(text, {s} + 651, 50)), chr(10)) > 0 THEN {s} + 700 - strpos(reverse(substr(text, {s} + 651, 50)), chr(10)) + 1
 WHEN strpos(reverse(substr(text, {s} + 651, 50)), ' ') > 0 THEN {s} + 700 - strpos(reverse(substr(text, {s} + 651, 50)), ' ') + 1 ELSE {s} + 700 END"""
CHUNKS = f"""WITH RECURSIVE cuts AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS s, {CUT.format(s="0")} AS e FROM documents
 UNION ALL SELECT doc_id, text, greatest(s + 600, e - 50), {CUT.format(s="greatest(s + 600, e - 50)")} FROM cuts WHERE e < length(text)),
 parts AS (SELECT doc_id, s, trim(substr(text, s + 1, e - s), ' ' || chr(9) || chr(10) || chr(13)) AS content FROM cuts),
 chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, content,
 CAST(doc_id AS VARCHAR) || '-' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS VARCHAR) AS chunk_id FROM parts WHERE content <> '')"""


def chunks_of(d, name=None):
    out = C.chunk_documents(d.documents, name=name)
    return out.withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index"))


def questions(d):
    return d.benchmark.select(F.col("item_id").cast("string").alias("query_id"), "text")


@query("t1_chunk_documents", CHUNKS + " SELECT doc_id, chunk_index, content, length(content) AS char_count FROM chunks")
def chunk_documents(d):
    return C.chunk_documents(d.documents).select("doc_id", "chunk_index", "content", "char_count")


@query(
    "a36_chunk_report",
    CHUNKS
    + """ SELECT doc_id, count(*) AS chunks, round(avg(length(content)), 6) AS mean_chars, min(length(content)) AS least_chars, max(length(content)) AS most_chars,
 round(var_pop(length(content)), 4) AS variance, count(*) FILTER (length(content) > 800) AS oversize, count(*) FILTER (length(content) < 600) AS undersize FROM chunks GROUP BY 1""",
)
def chunk_report(d):
    return C.chunk_report(C.chunk_documents(d.documents))


@query("r32_reassemble", CHUNKS + " SELECT doc_id, string_agg(content, chr(10) ORDER BY chunk_index) AS text, count(*) AS chunks FROM chunks GROUP BY 1")
def reassemble(d):
    return R.reassemble(C.chunk_documents(d.documents))


@query(
    "s7_page_text",
    r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', chr(10), 'g') AS t FROM pages),
 l AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)) AS text FROM b)
 SELECT page_id, CASE WHEN length(text) >= 10 THEN text END AS text FROM l""",
)
def page_text(d):
    return d.pages.select("page_id", C.html_text(F.col("html")).alias("text"))


@query(
    "s9_url_routes",
    r"""SELECT CASE WHEN regexp_matches(lower(url), 'youtube\.com|youtu\.be|vimeo\.com') THEN 'video' WHEN regexp_matches(lower(url), '\.pdf($|[?#])') THEN 'pdf' ELSE 'html' END AS route, count(*) AS n FROM pages GROUP BY 1""",
)
def url_routes(d):
    return d.pages.groupBy(C.url_route(F.col("url")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "t6_corpus_quality",
    r"""WITH f AS (SELECT lang, source, coalesce(text, '') AS t FROM documents),
 m AS (SELECT lang, source, t, length(t) - length(regexp_replace(t, '[$%&*#@^~]', '', 'g')) AS marks, greatest(length(t), 1) AS n, string_split(t, chr(10)) AS lines FROM f),
 q AS (SELECT lang, source, (50 * (CAST(length(regexp_replace(t, '[^A-Za-z0-9À-ÿ .,;:!?\n]', '', 'g')) AS DOUBLE) / n) + 30 * (CAST(len(list_filter(lines, lambda x: length(trim(x)) >= 10)) AS DOUBLE) / len(lines)) + 20 * least(CAST(length(t) AS DOUBLE) / 1000, 1.0)) AS quality,
 marks > 30 AS a, CAST(marks AS DOUBLE) / n > 0.05 AS b, contains(t, chr(65533)) AS c, regexp_matches(t, '[^ ]{40}') AS e, regexp_matches(t, '[\x00-\x08\x0e-\x1f]') AS g FROM m)
 SELECT lang, source, count(*) AS n, round(avg(quality), 5) AS quality, count(*) FILTER (a) AS many_marks, count(*) FILTER (b) AS share_of_marks, count(*) FILTER (c) AS replacement,
 count(*) FILTER (e) AS long_runs, count(*) FILTER (g) AS control FROM q GROUP BY 1, 2""",
)
def corpus_quality(d):
    return C.corpus_quality(d.documents)


LINES = "lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


@query(
    "t14_sections",
    rf"""WITH {LINES}, h AS (SELECT *, regexp_matches(line, '^[^|]{{1,30}}\.$') AS head FROM lines),
 s AS (SELECT *, CAST(sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS section FROM h)
 SELECT doc_id, section, max(line) FILTER (head) AS heading, count(*) FILTER (NOT head) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), '') AS content FROM s GROUP BY 1, 2""",
)
def sections(d):
    return C.sections(d.documents)


GRID = rf"""WITH {LINES}, r AS (SELECT doc_id, i, line, list_transform(string_split(regexp_replace(line, '^\s*\|?|\|?\s*$', '', 'g'), '|'), lambda x: trim(x, ' ')) AS cells FROM lines),
 k AS (SELECT * FROM r WHERE len(cells) >= 3 AND NOT regexp_matches(line, '^[\s|:-]+$')),
 n AS (SELECT *, CASE WHEN coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 1, true) THEN 1 ELSE 0 END AS new FROM k),
 t AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS table_no FROM n),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_no ORDER BY i) AS row_no FROM t),
 grid AS (SELECT doc_id, table_no, row_no, unnest(range(1, len(cells) + 1)) AS col_no, unnest(cells) AS value FROM o)"""


@query("t18_pipe_tables", GRID + " SELECT * FROM grid")
def pipe_tables(d):
    return C.pipe_tables(d.documents)


@query(
    "t26_profile_columns",
    GRID
    + r""" , p AS (SELECT doc_id, table_no, col_no, count(*) AS cells, count(*) FILTER (value <> '') AS filled,
 round(avg(CAST(regexp_matches(value, '^[-+]?[0-9][0-9,.]*$') AS INT)), 6) AS numeric_share FROM grid GROUP BY 1, 2, 3)
 SELECT *, CASE WHEN numeric_share > 0.7 THEN 'numeric' ELSE 'text' END AS kind FROM p""",
)
def profile_columns(d):
    return C.profile_columns(C.pipe_tables(d.documents))


HEADERS = """, f AS (SELECT doc_id, table_no, col_no, coalesce(last_value(nullif(value, '') IGNORE NULLS) OVER (PARTITION BY doc_id, table_no ORDER BY col_no ROWS UNBOUNDED PRECEDING), 'C' || col_no) AS name
 FROM grid WHERE row_no = 1),
 g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_no, name ORDER BY col_no) - 1 AS again FROM f),
 headers AS (SELECT doc_id, table_no, col_no, CASE WHEN again > 0 THEN name || '_' || again ELSE name END AS name FROM g)"""


@query("t23_w5_w9_headers", GRID + HEADERS + " SELECT * FROM headers")
def headers(d):
    return C.fill_headers(C.pipe_tables(d.documents))


@query(
    "t20_record_text",
    GRID
    + HEADERS
    + """ SELECT g.doc_id, g.table_no, g.row_no, left(string_agg(h.name || ': ' || CASE WHEN g.value = '' THEN '-' ELSE g.value END, ', ' ORDER BY g.col_no), 800) AS record
 FROM grid g JOIN headers h ON h.doc_id = g.doc_id AND h.table_no = g.table_no AND h.col_no = g.col_no WHERE g.row_no > 1 GROUP BY 1, 2, 3""",
)
def record_text(d):
    grid = C.pipe_tables(d.documents)
    return C.record_text(grid, C.fill_headers(grid))


@query(
    "r1_vector_topk",
    """WITH s AS (SELECT q.chunk_id AS query_id, c.chunk_id, round(CAST(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
 / sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) AS DOUBLE), 5) AS score FROM chunk_vectors q, chunk_vectors c WHERE CAST(q.chunk_id AS INT) % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
)
def vector_topk(d):
    asked = d.chunk_vectors.where("CAST(chunk_id AS INT) % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return R.vector_topk(asked, d.chunk_vectors, 10)


@query(
    "r2_cosine_to_label_mean",
    """WITH e AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM chunk_vectors),
 m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS centre FROM m GROUP BY 1)
 SELECT v.chunk_id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), c.centre) / sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) / sqrt(list_dot_product(c.centre, c.centre)), 5) AS score
 FROM chunk_vectors v JOIN c ON c.label = v.label""",
)
def cosine_to_label_mean(d):
    means = d.chunk_vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    centres = means.groupBy("label").agg(centre.alias("centre"))
    return d.chunk_vectors.join(centres, "label").select("chunk_id", F.round(R.cosine(F.col("embedding"), F.col("centre")), 5).alias("score"))


@query("r35_ann_topk")
def ann_topk(d):
    asked = d.chunk_vectors.where("CAST(chunk_id AS INT) % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return R.ann_topk(asked, d.chunk_vectors, 10, lists=32, probes=24)


WORDS = r"list_filter(string_split_regex(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= {n})"
KEYWORDS = f""", kw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, unnest(list_slice(w, 1, 100000)) AS keyword FROM (SELECT item_id, {WORDS.format(t="text", n=4)} AS w FROM benchmark)),
 tok AS (SELECT chunk_id, unnest({WORDS.format(t="content", n=1)}) AS keyword FROM chunks), cnt AS (SELECT chunk_id, keyword, count(*) AS n FROM tok GROUP BY 1, 2),
 hits AS (SELECT query_id, kw.keyword, chunk_id, n FROM kw JOIN cnt ON cnt.keyword = kw.keyword)"""


#: The chunks that hold each keyword as a substring, twenty a keyword.
HELD = """, word AS (SELECT DISTINCT keyword FROM kw), part AS (SELECT keyword, chunk_id, row_number() OVER (PARTITION BY keyword ORDER BY chunk_id) AS r FROM word JOIN chunks ON contains(lower(content), keyword))"""


def keyword_table(d):
    return R.keywords_of(questions(d), most=100_000)


@query(
    "r5_keyword_search",
    CHUNKS
    + KEYWORDS
    + HELD
    + """ SELECT query_id, chunk_id, count(*) AS keywords, CAST(0.95 AS DOUBLE) AS score FROM kw JOIN part ON part.keyword = kw.keyword WHERE r <= 20 GROUP BY 1, 2""",
)
def keyword_search(d):
    return I.keyword_search(keyword_table(d), chunks_of(d))


@query(
    "r31_keyword_count_rank",
    CHUNKS
    + KEYWORDS
    + """, m AS (SELECT query_id, h.chunk_id, count(*) AS matched, any_value(length(content)) AS length FROM hits h JOIN chunks c ON c.chunk_id = h.chunk_id GROUP BY 1, 2),
 r AS (SELECT *, CAST(matched AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, length DESC, chunk_id) AS rank FROM m) SELECT * FROM r WHERE rank <= 20""",
)
def keyword_count_rank(d):
    return R.keyword_count_rank(keyword_table(d), chunks_of(d)).select("query_id", "chunk_id", "matched", "length", "score", "rank")


BM25 = f""", size AS (SELECT chunk_id, len({WORDS.format(t="content", n=1)}) AS length FROM chunks), whole AS (SELECT count(*) AS total, avg(length) AS mean FROM size),
 df AS (SELECT keyword, count(DISTINCT chunk_id) AS df FROM hits GROUP BY 1),
 s AS (SELECT query_id, h.chunk_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score
 FROM hits h JOIN df ON df.keyword = h.keyword JOIN size ON size.chunk_id = h.chunk_id, whole GROUP BY 1, 2),
 bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"""


@query("r25_bm25", CHUNKS + KEYWORDS + BM25 + " SELECT * FROM bm WHERE rank <= 10")
def bm25(d):
    return R.bm25(keyword_table(d), chunks_of(d))


@query(
    "r21_pack_context",
    CHUNKS
    + KEYWORDS
    + BM25
    + """, p AS (SELECT query_id, rank, '[#' || rank || ' ' || b.chunk_id || ']' || chr(10) || content AS part FROM bm b JOIN chunks c ON c.chunk_id = b.chunk_id WHERE rank <= 10 AND score >= 0.02),
 u AS (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM p)
 SELECT query_id, count(*) AS chunks, string_agg(part, chr(10) ORDER BY rank) AS context FROM u WHERE used <= 3000 GROUP BY 1""",
)
def pack_context(d):
    chunks = chunks_of(d)
    return R.pack_context(R.bm25(keyword_table(d), chunks), chunks, budget=3000)


GRAMS = r"""list_distinct(flatten(list_transform(list_filter(string_split_regex({t}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""
NORMAL = r"trim(regexp_replace(lower({t}), '[\t\n\r ]+', ' ', 'g'))"


@query(
    "r3_fuzzy_topk",
    f"""WITH q AS (SELECT id AS query_id, {NORMAL.format(t="user_message")} AS t FROM chat_turns WHERE conv_id % 20 = 0),
 c AS (SELECT id AS chunk_id, {NORMAL.format(t="user_message")} AS t FROM chat_turns),
 qg AS (SELECT query_id, t, {GRAMS.format(t="t")} AS g FROM q), cg AS (SELECT chunk_id, t, {GRAMS.format(t="t")} AS g FROM c),
 s AS (SELECT query_id, chunk_id, qg.t AS qt, cg.t AS ct, round(CAST(len(list_intersect(qg.g, cg.g)) AS DOUBLE) / len(list_distinct(list_concat(qg.g, cg.g))), 6) AS similarity FROM qg, cg),
 k AS (SELECT query_id, chunk_id, similarity, round(similarity - 0.012 * abs(length(ct) - length(qt)) + CASE WHEN ct = qt THEN 0.4 WHEN starts_with(ct, qt) THEN 0.2 ELSE 0 END, 6) AS score FROM s WHERE similarity >= 0.4),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k) SELECT * FROM r WHERE rank <= 40""",
)
def fuzzy_topk(d):
    asked = d.chat_turns.where("conv_id % 20 = 0").select(F.col("id").alias("query_id"), F.col("user_message").alias("text"))
    return I.fuzzy_topk(asked, d.chat_turns.select(F.col("id").alias("chunk_id"), F.col("user_message").alias("content")))


@query(
    "r13_hybrid_fusion",
    CHUNKS
    + KEYWORDS
    + BM25
    + HELD
    + """, kc AS (SELECT query_id, chunk_id, CAST(0.95 AS DOUBLE) AS score FROM kw JOIN part ON part.keyword = kw.keyword WHERE r <= 20 GROUP BY 1, 2),
 un AS (SELECT query_id, chunk_id, score * 0.9 AS score, 'bm25' AS method FROM bm WHERE rank <= 10 UNION ALL SELECT query_id, chunk_id, score * 1.0, 'keyword' FROM kc),
 b AS (SELECT query_id, chunk_id, round(max(score), 6) AS score, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM un GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b) SELECT * FROM r WHERE rank <= 25""",
)
def hybrid_fusion(d):
    chunks, keywords = chunks_of(d), keyword_table(d)
    return R.fuse([("bm25", 0.9, R.bm25(keywords, chunks)), ("keyword", 1.0, I.keyword_search(keywords, chunks))])


@query(
    "r30_queries_without_hits",
    CHUNKS + KEYWORDS + " SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark WHERE CAST(item_id AS VARCHAR) NOT IN (SELECT query_id FROM hits WHERE n >= 3)",
)
def queries_without_hits(d):
    return R.only_without_hits(questions(d), R.token_hits(keyword_table(d), chunks_of(d)).where("n >= 3"))


@query(
    "r26_phrase_search",
    CHUNKS
    + f""", qw AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {WORDS.format(t="text", n=1)} AS w FROM benchmark), cw AS (SELECT chunk_id, {WORDS.format(t="content", n=1)} AS w FROM chunks),
 qp AS (SELECT DISTINCT query_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM qw), cp AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM cw)
 SELECT query_id, chunk_id, CAST(count(*) AS DOUBLE) AS score FROM qp JOIN cp ON cp.pair = qp.pair GROUP BY 1, 2""",
)
def phrase_search(d):
    return R.phrase_search(questions(d), chunks_of(d))
