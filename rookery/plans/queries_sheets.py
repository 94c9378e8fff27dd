"""Sheet and text repair queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import questions as Q
from ..operators import refine as X
from ..operators import sheets as S
from ..operators.usage import usage_alerts
from .queries_corpus import CHUNKS, GRID, HEADERS, chunks_of
from .queries_questions import turns
from .registry import query


def grid_of(d):
    return C.pipe_tables(d.documents)


@query("s12_sheet_records", GRID + " SELECT doc_id, table_no, row_no, string_agg(value, ' | ' ORDER BY col_no) AS record FROM grid WHERE value <> '' AND row_no <= 5000 GROUP BY 1, 2, 3")
def sheet_records(d):
    return S.sheet_records(grid_of(d))


@query("s13_sheet_content", GRID + " SELECT doc_id, table_no, coalesce(string_agg(value, ' ' ORDER BY row_no, col_no) FILTER (value <> ''), '') AS content, 'sheet ' || table_no AS section, 'doc-' || doc_id AS source FROM grid GROUP BY 1, 2")
def sheet_content(d):
    return S.sheet_content(grid_of(d))


@query("a45_sheet_profile", GRID + " SELECT doc_id, table_no, max(row_no) AS rows, max(col_no) AS columns, round(avg(CAST(value <> '' AS INT)), 6) AS fill_rate FROM grid GROUP BY 1, 2")
def sheet_profile(d):
    return S.sheet_profile(grid_of(d))


@query("t40_sheet_metadata")
def sheet_metadata(d):
    grid = grid_of(d)
    return S.sheet_metadata(grid, C.fill_headers(grid))


@query("t21_clean_names", GRID + HEADERS + r""" SELECT doc_id, table_no, col_no, CASE WHEN trim(regexp_replace(name, '[*#:]+', '', 'g')) = '' THEN 'C' || col_no ELSE trim(regexp_replace(name, '[*#:]+', '', 'g')) END AS name FROM headers""")
def clean_names(d):
    return S.clean_names(C.fill_headers(grid_of(d)))


@query("t24_placeholder_columns", GRID + HEADERS + r""" SELECT * FROM headers WHERE regexp_matches(name, '^(|C[0-9]+|Unnamed.*|Column ?[0-9]+|[0-9]+|nan|None|col_[0-9]+|Field[0-9]+)$')""")
def placeholder_columns(d):
    return S.placeholder_columns(C.fill_headers(grid_of(d)))


@query("t31_render_sheet", GRID + HEADERS + """, hd AS (SELECT doc_id, table_no, string_agg('- ' || name, chr(10) ORDER BY col_no) AS head FROM headers GROUP BY 1, 2),
 rec AS (SELECT doc_id, table_no, row_no, string_agg(value, ' | ' ORDER BY col_no) AS record FROM grid WHERE value <> '' AND row_no > 1 AND row_no <= 5000 GROUP BY 1, 2, 3),
 bd AS (SELECT doc_id, table_no, string_agg(record, chr(10) ORDER BY row_no) AS body, count(*) AS n FROM rec GROUP BY 1, 2)
 SELECT hd.doc_id, hd.table_no, concat_ws(chr(10), head, body, 'rows: ' || coalesce(n, 0)) AS text FROM hd LEFT JOIN bd ON bd.doc_id = hd.doc_id AND bd.table_no = hd.table_no""")
def render_sheet(d):
    grid = grid_of(d)
    return S.render_sheet(grid, C.fill_headers(grid))


@query("t32_header_keywords", GRID + " , x AS (SELECT doc_id, table_no, row_no, string_agg(lower(value), ' ' ORDER BY col_no) AS text FROM grid GROUP BY 1, 2, 3) SELECT doc_id, table_no, row_no FROM x WHERE regexp_matches(text, 'tion|keit')")
def header_keywords(d):
    return S.header_keywords(grid_of(d), ["tion", "keit"])


@query("t34_rewrite_placeholders")
def rewrite_placeholders(d):
    return d.documents.where("text LIKE '%|%'").select("doc_id", S.rewrite_placeholders(F.replace("text", F.lit("| the |"), F.lit("| nan |"))).alias("text"))


@query("t11_repair_text", r"""SELECT doc_id, trim(regexp_replace(translate(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)all rights reserved\.?', '', 'g'), '(?i)confidential', '', 'g'), '“”‘’–—…', '""''''--.'), '[ \t]+', ' ', 'g'), ' ') AS text FROM documents""")
def repair_text(d):
    return d.documents.select("doc_id", S.repair_text(F.coalesce("text", F.lit(""))).alias("text"))


@query("t38_extraction_scores", "SELECT CAST(doc_id AS VARCHAR) AS id, round(40 + CASE WHEN n_chars > 0 THEN 30 ELSE 0 END + CASE WHEN doc_id % 7 <> 0 THEN 20 ELSE 0 END + least(10.0, CAST(n_chars AS DOUBLE) / 1000 / 10), 6) AS score FROM documents")
def extraction_scores(d):
    jobs = d.documents.select(F.col("doc_id").cast("string").alias("id"), F.lit(True).alias("done"), F.col("n_chars").alias("chars"), (F.col("doc_id") % 7 == 0).alias("damaged"), (F.col("n_chars") / 1000).alias("sections"))
    return S.extraction_score(jobs)


@query("t3_optimal_sizes", "SELECT doc_id, least(greatest(length(coalesce(text, '')) // greatest(length(coalesce(text, '')) // 700, 1), 600), 800) AS size FROM documents")
def optimal_sizes(d):
    n = F.char_length(F.coalesce("text", F.lit("")))
    return d.documents.select("doc_id", F.least(F.greatest(F.floor(n / F.greatest(F.floor(n / 700), F.lit(1))), F.lit(600)), F.lit(800)).alias("size"))


@query("t36_vector_checks", "SELECT chunk_id, embedding IS NOT NULL AS present, len(embedding) = 64 AS right_size FROM chunk_vectors")
def vector_checks(d):
    return d.chunk_vectors.select("chunk_id", F.col("embedding").isNotNull().alias("present"), (F.size("embedding") == 64).alias("right_size"))


@query("t1_parts_by_document", CHUNKS + " SELECT doc_id, count(*) AS parts, CAST(sum(length(content)) AS BIGINT) AS chars FROM chunks GROUP BY 1")
def parts_by_document(d):
    return chunks_of(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("char_count").alias("chars"))


@query("q13_split_flags", r"""SELECT id, CAST(len(regexp_extract_all(user_message, '[.!?。！？]')) >= 3 AS INT) + CAST(len(regexp_extract_all(user_message, '[,;、]')) >= 4 AS INT) + CAST(len(regexp_extract_all(user_message, '(^|\n) *([0-9]+[.)]|[-*])')) >= 2 AS INT)
 + CAST(len(regexp_extract_all(user_message, '[?？]')) >= 2 AS INT) + CAST(length(user_message) > 300 AS INT) >= 2 AS split FROM chat_turns""")
def split_flags(d):
    return turns(d).select("id", Q.should_split(F.col("text")).alias("split"))


@query("q20_kana", "SELECT id, user_message || 'カナ' AS kana FROM chat_turns")
def kana(d):
    return turns(d).select("id", X.to_katakana(F.concat("text", F.lit("かな"))).alias("kana"))


@query("q23_legal_forms", "SELECT CAST(c_custkey AS VARCHAR) AS id, trim(regexp_replace(replace(c_name || 'GmbH', 'GmbH', ' GmbH '), ' +', ' ', 'g')) AS name FROM customer")
def legal_forms(d):
    spaced = F.replace(F.concat("c_name", F.lit("GmbH")), F.lit("GmbH"), F.lit(" GmbH "))
    return d.customer.select(F.col("c_custkey").cast("string").alias("id"), F.trim(F.regexp_replace(spaced, " +", " ")).alias("name"))


@query("p16_warning_levels", "SELECT user_id, CASE WHEN questions_used * 100.0 / 10 >= 95 THEN 'critical' WHEN questions_used * 100.0 / 10 >= 80 THEN 'warning' ELSE 'safe' END AS level FROM usage_limits WHERE NOT is_unlimited")
def warning_levels(d):
    from ..operators.usage import warning_level

    return d.usage_limits.where("NOT is_unlimited").select("user_id", warning_level(F.col("questions_used") * 100.0 / 10).alias("level"))


@query("p23_visible_templates", "SELECT id FROM prompt_templates WHERE CAST(id AS BIGINT) % 5 = 0 OR category_id LIKE 'S%'")
def visible_templates(d):
    return d.prompt_templates.where((F.col("id").cast("long") % 5 == 0) | F.col("category_id").startswith("S")).select("id")


@query("st8_alerts_by_level", """WITH t AS (SELECT id, company_id, timestamp, sum(total_tokens) OVER (PARTITION BY company_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS total FROM chat_history WHERE company_id IS NOT NULL),
 l AS (SELECT *, CASE WHEN total * 100.0 / 50000 >= 95 THEN 'critical' WHEN total * 100.0 / 50000 >= 80 THEN 'warning' ELSE 'safe' END AS level FROM t),
 b AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY company_id ORDER BY timestamp, id), 'safe') AS before FROM l) SELECT level, count(*) AS n FROM b WHERE level <> before GROUP BY 1""")
def alerts_by_level(d):
    return usage_alerts(d.chat_history, 50_000).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
