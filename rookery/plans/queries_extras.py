"""Further queries on chat, hits, chunks and table grids, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as P
from ..operators import corpus as C
from ..operators import extras as X
from ..operators import maintain as M
from ..operators import retrieval as R
from ..operators import usage as U
from .queries_corpus import BM25, CHUNKS, GRID, KEYWORDS, LINES, chunks_of, keyword_table, questions
from .registry import query


def hits_of(d, k=10):
    return R.bm25(keyword_table(d), chunks_of(d), k)


@query(
    "j10_templates_with_variables",
    "SELECT id, title, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN NULL ELSE 'brand,size' END AS variables FROM prompt_templates",
)
def templates_with_variables(d):
    names = F.explode(F.array(F.struct(F.lit(2).alias("display_order"), F.lit("size").alias("name")), F.struct(F.lit(1).alias("display_order"), F.lit("brand").alias("name"))))
    variables = d.prompt_templates.where("CAST(id AS BIGINT) % 3 <> 0").select(F.col("id").alias("template_id"), names.alias("v")).select("template_id", "v.display_order", "v.name")
    out = X.nested_variables(d.prompt_templates.select("id", "title"), variables)
    return out.withColumn("variables", F.array_join("variables", ","))


@query("j13_chats_by_document_type", "SELECT coalesce(s.type, 'text') AS type, h.sentiment, count(*) AS n FROM chat_history h LEFT JOIN document_sources s ON s.name = h.source_document GROUP BY 1, 2")
def chats_by_document_type(d):
    return X.with_document_type(d.chat_history, d.document_sources).groupBy("type", "sentiment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j14_active_user_company",
    """SELECT h.employee_id, coalesce(any_value(c.name), 'no company') AS company, count(*) AS chats FROM chat_history h LEFT JOIN users u ON u.id = h.employee_id LEFT JOIN companies c ON c.id = u.company_id GROUP BY 1""",
)
def active_user_company(d):
    per = d.chat_history.groupBy("employee_id").agg(F.count(F.lit(1)).alias("chats"))
    names = U.users_with_company(d.users, d.companies).select(F.col("id").alias("employee_id"), "company")
    return per.join(names, "employee_id", "left").select("employee_id", F.coalesce("company", F.lit("no company")).alias("company"), "chats")


@query(
    "j15_incremental_rollup",
    "SELECT employee_id AS user_id, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS n FROM chat_history GROUP BY 1",
)
def incremental_rollup(d):
    per = lambda df: df.groupBy(F.col("employee_id").alias("user_id")).agg(F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    old, new = d.chat_history.where("CAST(id AS BIGINT) % 4 <> 0"), d.chat_history.where("CAST(id AS BIGINT) % 4 = 0")
    return M.merge_rollup(per(old), per(new), ["user_id"])


@query(
    "a22_user_month_usage",
    "SELECT employee_id, strftime(timestamp, '%Y-%m') AS month, count(*) AS chats, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM chat_history WHERE strftime(timestamp, '%Y-%m') = '2024-01' GROUP BY 1, 2",
)
def user_month_usage(d):
    rows = d.chat_history.withColumn("month", F.date_format("timestamp", "yyyy-MM")).where("month = '2024-01'")
    return rows.groupBy("employee_id", "month").agg(F.count(F.lit(1)).alias("chats"), F.sum("total_tokens").alias("tokens"))


@query(
    "a26_usage_with_references",
    """SELECT company_id, count(*) AS chats, CAST(CASE WHEN max(prompt_references) IS NULL THEN 2 * count(*) ELSE sum(prompt_references) END AS BIGINT) AS references,
 round(CAST(sum(total_tokens) AS DOUBLE) / 1000 * 0.0025 * 150, 4) AS base_yen, round(CASE WHEN max(prompt_references) IS NULL THEN 2 * count(*) ELSE sum(prompt_references) END * CAST(0.5 AS DOUBLE), 4) AS prompt_yen FROM chat_history GROUP BY 1""",
)
def usage_with_references(d):
    return X.usage_with_references(d.chat_history)


@query(
    "a32_score_stats",
    CHUNKS + KEYWORDS + BM25 + " SELECT query_id, count(*) AS n, min(score) AS least, max(score) AS most, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS spread FROM bm WHERE rank <= 10 GROUP BY 1",
)
def score_stats(d):
    return X.score_stats(hits_of(d), "query_id")


@query("a37_index_lists", CHUNKS + " SELECT doc_id, count(*) AS chunks, string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY chunk_index) AS indexes FROM chunks GROUP BY 1")
def index_lists(d):
    return X.index_lists(C.chunk_documents(d.documents))


VECTORS = "v AS (SELECT chunk_id, doc_id, chunk_index, CASE WHEN CAST(chunk_id AS INT) % 3 = 0 THEN NULL ELSE embedding END AS embedding FROM chunk_vectors)"


def spoiled_vectors(d):
    return d.chunk_vectors.withColumn("embedding", F.when(F.col("chunk_id").cast("int") % 3 != 0, F.col("embedding")))


@query("a43_embedding_job_stats", f"WITH {VECTORS} SELECT count(*) AS total, count(*) FILTER (len(embedding) = 64) AS ok, count(*) FILTER (len(embedding) <> 64) AS wrong_size, count(*) FILTER (embedding IS NULL) AS pending FROM v")
def embedding_job_stats(d):
    return X.embedding_job_stats(spoiled_vectors(d), 64)


@query("t37_pending_batches", CHUNKS + " SELECT doc_id, chunk_index, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1) // 5 AS batch FROM chunks WHERE chunk_index % 2 = 0")
def pending_batches(d):
    rows = C.chunk_documents(d.documents).withColumn("embedding", F.when(F.col("chunk_index") % 2 == 1, F.array(F.lit(1.0))))
    return X.pending_batches(rows, 5)


@query("t39_embed_pending")
def embed_pending(d):
    rows = chunks_of(d).select("chunk_id", "content", F.lit(None).cast("array<float>").alias("embedding"))
    return X.embed_pending(rows).select("chunk_id", F.size("embedding").alias("size"), F.round(R.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


@query(
    "a50_display_sources",
    r"""WITH e AS (SELECT id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM (SELECT id, string_split(sources, ',') AS l FROM chat_history)),
 c AS (SELECT id, trim(regexp_replace(s, '\s*\(P\.[^)]*\)', '', 'g')) AS source, min(i) AS i FROM e GROUP BY 1, 2)
 SELECT id, string_agg(source, ', ' ORDER BY i) AS shown FROM c WHERE source <> '' AND source <> 'system' GROUP BY 1""",
)
def display_sources(d):
    return X.display_sources(d.chat_history)


@query("a53_numbered_specials", "WITH s AS (SELECT DISTINCT company_id, special FROM document_sources WHERE special IS NOT NULL) SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY special) AS number FROM s")
def numbered_specials(d):
    return X.numbered_specials(d.document_sources)


@query("a49_category_share", "SELECT coalesce(category, 'other') AS category, count(*) AS n, round(CAST(count(*) * 100 AS DOUBLE) / sum(count(*)) OVER (), 6) AS percent FROM chat_history GROUP BY 1")
def category_share(d):
    from ..operators.analytics import chat_summary

    return chat_summary(d.chat_history).where("section = 'category'").select(F.col("key").alias("category"), "n", "percent")


@query(
    "s17_export_analysis",
    """WITH c AS (SELECT 'category' AS section, coalesce(category, 'other') AS key, count(*) AS count FROM chat_history GROUP BY 2), s AS (SELECT 'sentiment', coalesce(sentiment, 'neutral') AS key, count(*) FROM chat_history GROUP BY 2)
 SELECT * FROM c UNION ALL SELECT * FROM s""",
)
def export_analysis(d):
    from ..operators.analytics import chat_summary

    return chat_summary(d.chat_history).where("section IN ('category', 'sentiment')").select("section", "key", F.col("n").alias("count"))


@query("w4_first_change", "SELECT user_id, arg_min(id, (changed_at, id)) AS id, min(changed_at) AS changed_at FROM plan_history GROUP BY 1")
def first_change(d):
    return d.plan_history.groupBy("user_id").agg(F.min_by("id", F.struct("changed_at", "id")).alias("id"), F.min("changed_at").alias("changed_at"))


@query(
    "w7_last_three_chats",
    "WITH r AS (SELECT employee_id, id, row_number() OVER (PARTITION BY employee_id ORDER BY timestamp DESC, id) AS rank FROM chat_history) SELECT * FROM r WHERE rank <= 3",
)
def last_three_chats(d):
    return R.top_k(d.chat_history.select("employee_id", "id", "timestamp"), 3, by=["employee_id"], order=[F.desc("timestamp"), F.col("id")]).drop("timestamp")


@query(
    "w11_consecutive_orders",
    """WITH g AS (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders)
 SELECT o_custkey, round(avg(CAST(gap = 1 AS INT)), 6) AS share, avg(CAST(gap = 1 AS INT)) >= 0.7 AS is_index FROM g WHERE gap IS NOT NULL GROUP BY 1""",
)
def consecutive_orders(d):
    return X.consecutive_share(d.orders, "o_custkey", "o_orderkey")


@query("k3_newest_chats", "SELECT id, timestamp FROM chat_history ORDER BY timestamp DESC, id LIMIT 30")
def newest_chats(d):
    return d.chat_history.select("id", "timestamp").orderBy(F.desc("timestamp"), "id").limit(30)


@query("u3_system_and_company_types", "SELECT DISTINCT type AS category, 'system' AS scope FROM document_sources UNION ALL SELECT DISTINCT company_id, 'company' FROM document_sources")
def system_and_company_types(d):
    system = d.document_sources.select(F.col("type").alias("category")).distinct().withColumn("scope", F.lit("system"))
    return system.unionByName(d.document_sources.select(F.col("company_id").alias("category")).distinct().withColumn("scope", F.lit("company")))


@query("p1_p3_tenant_chunks", CHUNKS + " SELECT c.chunk_id FROM chunks c JOIN document_sources s ON s.id = CAST(c.doc_id AS VARCHAR) WHERE s.active AND s.company_id = '3' AND length(c.content) > 10")
def tenant_chunks(d):
    docs = d.document_sources.where("active AND company_id = '3'").select("id")
    return chunks_of(d).where(F.char_length("content") > 10).join(docs, F.col("doc_id").cast("string") == docs["id"], "left_semi").select("chunk_id")


@query(
    "p7_null_words",
    r"""SELECT id, CASE WHEN sentiment IS NULL THEN '' ELSE sentiment END AS sentiment, trim(regexp_replace(regexp_replace(replace(bot_response, 'not', 'null'), '(?i)(^|[^A-Za-z0-9_])(nan|none|null)', '\1', 'g'), ' +', ' ', 'g')) AS answer FROM chat_history""",
)
def null_words(d):
    answer = P.strip_null_words(F.replace("bot_response", F.lit("not"), F.lit("null")))
    return d.chat_history.select("id", P.blank_null_words(F.col("sentiment")).alias("sentiment"), answer.alias("answer"))


@query("p22_similarity_bands", CHUNKS + KEYWORDS + BM25 + " SELECT CASE WHEN score / 20 >= 0.8 THEN 'very high' WHEN score / 20 >= 0.6 THEN 'high' WHEN score / 20 >= 0.4 THEN 'medium' WHEN score / 20 >= 0.2 THEN 'low' ELSE 'very low' END AS band, count(*) AS n FROM bm WHERE rank <= 10 GROUP BY 1")
def similarity_bands(d):
    return hits_of(d).groupBy(P.similarity_band(F.col("score") / 20).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "r16_merge_expanded",
    CHUNKS
    + KEYWORDS
    + BM25
    + """, o AS (SELECT query_id, chunk_id, score, 0 AS priority FROM bm WHERE rank <= 5 UNION ALL SELECT query_id, chunk_id, score * 0.9, 1 FROM bm WHERE rank <= 10),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY priority, score DESC) AS r FROM o) SELECT query_id, chunk_id, round(score, 8) AS score, CAST(priority AS BIGINT) AS priority FROM r WHERE r = 1""",
)
def merge_expanded(d):
    hits = hits_of(d)
    return X.merge_expanded(hits.where("rank <= 5"), hits).withColumn("score", F.round("score", 8))


@query(
    "r23_attribute_chunks",
    CHUNKS
    + KEYWORDS
    + BM25
    + r""", e AS (SELECT CAST(item_id AS VARCHAR) AS query_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS w FROM (SELECT item_id, regexp_extract_all(lower(text), '([\p{L}\p{N}]{3,})', 1) AS l FROM benchmark)),
 f AS (SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) AS n FROM e GROUP BY 1, 2), h AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(content), '([\p{L}\p{N}]{3,})', 1)) AS w FROM chunks)
 SELECT b.query_id, b.chunk_id, count(h.w) AS matches, count(h.w) >= 1 AS used FROM bm b JOIN f ON f.query_id = b.query_id AND f.n <= 20 LEFT JOIN h ON h.chunk_id = b.chunk_id AND h.w = f.w WHERE rank <= 10 GROUP BY 1, 2""",
)
def attribute_chunks(d):
    return X.attribute_chunks(questions(d).select("query_id", F.col("text").alias("answer")), hits_of(d), chunks_of(d))


@query(
    "r24_highlight",
    CHUNKS + " SELECT chunk_id, replace(replace(content, 'the', '<mark>the</mark>'), 'der', '<mark>der</mark>') AS content FROM chunks",
)
def highlight(d):
    return chunks_of(d).select("chunk_id", X.highlight(F.col("content"), ["the", "der"]).alias("content"))


@query("r22_previews")
def previews(d):
    return X.preview(hits_of(d), chunks_of(d))


@query("r18_contextual_rerank")
def contextual_rerank(d):
    return X.contextual_rerank(hits_of(d), chunks_of(d), questions(d).select("query_id", F.col("text").alias("context")))


@query("r33_structured_lines")
def structured_lines(d):
    return X.structured_lines(hits_of(d), chunks_of(d), keyword_table(d)).select("query_id", "line", "n")


@query("r12_synonym_search")
def synonym_search(d):
    synonyms = d.spark.createDataFrame([("with", "by"), ("that", "this"), ("from", "of")], "term string, synonym string")
    return X.synonym_search(keyword_table(d).select("query_id", F.col("keyword").alias("term")), synonyms, chunks_of(d))


@query(
    "r36_fallback_chain",
    CHUNKS
    + KEYWORDS
    + BM25
    + """, strong AS (SELECT query_id, chunk_id, score FROM bm WHERE rank <= 10 AND score >= 20), q1 AS (SELECT query_id FROM strong GROUP BY 1 HAVING count(*) >= 3)
 SELECT query_id, chunk_id, score, 'strong' AS stage FROM strong WHERE query_id IN (SELECT query_id FROM q1)
 UNION ALL SELECT query_id, chunk_id, score, 'any' FROM bm WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM q1)""",
)
def fallback_chain(d):
    hits = hits_of(d).select("query_id", "chunk_id", "score")
    return X.fallback_chain(questions(d), [("strong", 3, hits.where("score >= 20")), ("any", 1, hits)])


@query(
    "t17_page_sections",
    f"""WITH {LINES.replace("coalesce(text, '')", "coalesce(replace(text, 'Es.', '--- Page 2 ---'), '')")}, p AS (SELECT *, regexp_extract(line, '^--- Page ([0-9]+) ---$', 1) AS pg FROM lines),
 f AS (SELECT doc_id, i, line, pg, CAST(coalesce(last_value(nullif(pg, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), '0') AS BIGINT) AS page FROM p)
 SELECT doc_id, page, string_agg(line, chr(10) ORDER BY i) AS text FROM f WHERE pg = '' GROUP BY 1, 2""",
)
def page_sections(d):
    return X.page_sections(d.documents.select("doc_id", F.replace("text", F.lit("Es."), F.lit("--- Page 2 ---")).alias("text")))


@query(
    "t30_drop_empty",
    GRID
    + """, rr AS (SELECT DISTINCT doc_id, table_no, row_no FROM grid WHERE value <> ''), cc AS (SELECT DISTINCT doc_id, table_no, col_no FROM grid WHERE value <> ''),
 kept AS (SELECT g.* FROM grid g JOIN rr USING (doc_id, table_no, row_no) JOIN cc USING (doc_id, table_no, col_no)),
 whole AS (SELECT doc_id, table_no, row_no, string_agg(value, chr(1) ORDER BY col_no) AS t FROM kept GROUP BY 1, 2, 3), first AS (SELECT doc_id, table_no, t, min(row_no) AS row_no FROM whole GROUP BY 1, 2, 3)
 SELECT k.* FROM kept k JOIN first f ON f.doc_id = k.doc_id AND f.table_no = k.table_no AND f.row_no = k.row_no""",
)
def drop_empty(d):
    return X.drop_empty(C.pipe_tables(d.documents))


@query(
    "a46_column_samples",
    GRID
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_no, col_no ORDER BY row_no) AS r FROM grid WHERE value <> '')
 SELECT doc_id, table_no, col_no, count(*) AS filled, string_agg(value, ' / ' ORDER BY r) FILTER (r <= 5) AS samples FROM ranked GROUP BY 1, 2, 3""",
)
def column_samples(d):
    return X.column_samples(C.pipe_tables(d.documents))


@query("t22_header_scores")
def header_scores(d):
    return X.header_scores(C.pipe_tables(d.documents), ["name", "date", "the"])


@query("t27_suggest_names")
def suggest_names(d):
    return X.suggest_names(C.pipe_tables(d.documents))


@query(
    "t33_expand_merged",
    GRID + " SELECT doc_id, table_no, row_no, col_no, CASE WHEN row_no = 1 AND col_no IN (1, 2) THEN first_value(value) OVER (PARTITION BY doc_id, table_no, row_no ORDER BY col_no) ELSE value END AS value FROM grid",
)
def expand_merged(d):
    grid = C.pipe_tables(d.documents)
    ranges = grid.select("doc_id", "table_no").distinct().select("*", F.lit(1).alias("top"), F.lit(1).alias("bottom"), F.lit(1).alias("left"), F.lit(2).alias("right"))
    return X.expand_merged(grid, ranges)


@query(
    "t4_token_estimates",
    CHUNKS + " SELECT chunk_id, CAST(ceil(length(content) * 0.25) AS BIGINT) AS tokens, greatest(1, CAST(ceil(ceil(length(content) * 0.25) / 500) AS BIGINT)) AS pages FROM chunks",
)
def token_estimates(d):
    rows = chunks_of(d).select("chunk_id", "token_count")
    return rows.select("chunk_id", F.col("token_count").alias("tokens"), F.greatest(F.lit(1), F.ceil(F.col("token_count") / 500)).alias("pages"))


@query("m13_notifications", "SELECT id, title FROM notifications ORDER BY id DESC LIMIT 3")
def notifications(d):
    return M.scan(d.notifications, ["id", "title"], None, "id", True, 3)


@query("m8_append_plan_change", "SELECT user_id, CASE WHEN to_plan = 'unlimited' THEN 'production' ELSE to_plan END AS to_plan FROM plan_history UNION ALL SELECT id, 'production' FROM users WHERE role = 'user'")
def append_plan_change(d):
    new = d.users.where("role = 'user'").select(F.col("id").alias("user_id"), F.lit("unlimited").alias("to_plan"))
    rows = d.plan_history.select("user_id", "to_plan").unionByName(new)
    return rows.withColumn("to_plan", P.plan_name(F.col("to_plan")))


@query("m12_application_status", "SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'approved' ELSE 'pending' END AS status FROM users WHERE company_id = '4'")
def application_status(d):
    rows = d.users.where("company_id = '4'").select("id", F.lit("pending").alias("status"))
    return M.update_where(rows, F.col("id").cast("long") % 2 == 0, {"status": F.lit("approved")})


@query("st7_expired_cache", "SELECT id FROM search_performance_log WHERE created_at + INTERVAL 1 DAY <= (SELECT max(created_at) FROM search_performance_log)")
def expired_cache(d):
    now = d.search_performance_log.agg(F.max("created_at")).first()[0]
    return d.search_performance_log.where(F.col("created_at") + F.expr("INTERVAL 1 DAYS") <= F.lit(now)).select("id")
