"""Domain views over the stored tables, as one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_K = "CAST(regexp_extract(props,'([0-9]+)',1) AS INT)"
_PLAN = "CASE o_orderstatus WHEN 'O' THEN 'demo' WHEN 'F' THEN 'production' ELSE 'unlimited' END"

VIEWS = {
    "companies": "SELECT CAST(n_nationkey AS STRING) AS id, n_name AS name FROM nation",
    "users": """SELECT CAST(c.c_custkey AS STRING) AS id, c.c_name AS name,
 concat('u', CAST(c.c_custkey AS STRING), '@c', CAST(c.c_nationkey AS STRING), '.example.com') AS email,
 CASE WHEN c.c_custkey % 50 = 49 THEN NULL ELSE CAST(c.c_nationkey AS STRING) END AS company_id,
 CASE WHEN c.c_custkey % 10 = 0 THEN 'admin_user' WHEN c.c_custkey % 10 = 1 THEN 'user' ELSE 'employee' END AS role,
 COALESCE(MIN(o.o_orderdate), TIMESTAMP '1995-01-01 00:00:00') AS created_at,
 CASE WHEN c.c_custkey = 0 THEN NULL ELSE CAST(CAST(floor(c.c_custkey / 8) AS BIGINT) AS STRING) END AS created_by
 FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_name, c.c_nationkey""",
    "usage_limits": """SELECT CAST(c.c_custkey AS STRING) AS user_id, c.c_mktsegment = 'BUILDING' AS is_unlimited,
 COUNT(o.o_orderkey) AS questions_used, CASE WHEN c.c_mktsegment = 'BUILDING' THEN 999999 ELSE 10 END AS questions_limit,
 c.c_custkey % 3 AS document_uploads_used, CASE WHEN c.c_mktsegment = 'BUILDING' THEN 999999 ELSE 2 END AS document_uploads_limit
 FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_custkey % 20 <> 19 GROUP BY c.c_custkey, c.c_mktsegment""",
    "chat_history": f"""SELECT CAST(event_id AS STRING) AS id, concat('question ', event_type, ' ', CAST({_K} % 25 AS STRING)) AS user_message,
 CASE WHEN {_K} % 11 = 0 THEN 'sorry, not known' ELSE concat('answer ', repeat('x', {_K})) END AS bot_response, ts AS timestamp,
 CASE event_type WHEN 'click' THEN 'procedure' WHEN 'view' THEN 'general' WHEN 'purchase' THEN 'finance' WHEN 'error' THEN 'technical' END AS category,
 CASE WHEN event_id % 97 = 0 THEN NULL WHEN value >= 60 THEN 'positive' WHEN value < 15 THEN 'negative' ELSE 'neutral' END AS sentiment,
 CAST(e.user_id AS STRING) AS employee_id, u.name AS employee_name,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('doc-', CAST({_K} AS STRING)) END AS source_document,
 concat('doc-', CAST({_K} AS STRING), ' (P.', CAST({_K} % 9 AS STRING), '), doc-', CAST(({_K} + 1) % 100 AS STRING)) AS sources,
 {_K} + 20 AS input_tokens, 3 * ({_K} + 20) AS output_tokens, 4 * ({_K} + 20) AS total_tokens,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(e.user_id AS STRING) END AS user_id, u.company_id AS company_id, {_K} % 3 AS prompt_references
 FROM events e LEFT JOIN users u ON u.id = CAST(e.user_id AS STRING)""",
    "chat_turns": """SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, CAST(conv_id % 40 AS STRING) AS employee_id, conv_id, turn,
 text AS user_message, next_text AS bot_response FROM (SELECT conv_id, turn, role, text,
 LEAD(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, LEAD(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations) t
 WHERE role = 'user' AND next_role = 'assistant'""",
    "plan_history": f"""SELECT id, user_id, from_plan, to_plan, changed_at, prev_at FROM (SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS user_id,
 LAG({_PLAN}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_plan,
 {_PLAN} AS to_plan, o_orderdate AS changed_at,
 LAG(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_at FROM orders) t WHERE from_plan <> to_plan""",
    "document_sources": """SELECT CAST(d.doc_id AS STRING) AS id, concat('doc-', CAST(d.doc_id AS STRING)) AS name,
 CASE d.doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'excel' WHEN 2 THEN 'word' ELSE 'text' END AS type,
 CAST(1 + floor(d.n_chars / 2000) AS BIGINT) AS page_count, CAST(d.doc_id % 100 AS STRING) AS uploaded_by, CAST(d.doc_id % 25 AS STRING) AS company_id,
 COALESCE(l.toxic, 0) = 0 AS active, CASE WHEN l.quality = 0 THEN 'low quality' END AS special FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "chunk_vectors": "SELECT CAST(vec_id AS STRING) AS chunk_id, CAST(vec_id AS STRING) AS doc_id, 0 AS chunk_index, embedding, label FROM embeddings",
    "search_performance_log": f"""SELECT CAST(event_id AS STRING) AS id, concat(event_type, ' ', CAST({_K} % 25 AS STRING)) AS query_text, value AS execution_time_ms, {_K} AS result_count,
 split(CASE {_K} % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'vector,trigram' ELSE 'trigram,like' END, ',') AS search_types, CAST(e.user_id AS STRING) AS user_id,
 u.company_id AS company_id, ts AS created_at FROM events e LEFT JOIN users u ON u.id = CAST(e.user_id AS STRING)""",
    "prompt_templates": """SELECT CAST(p_partkey AS STRING) AS id, p_name AS title, p_type AS category_id, concat('{{brand}} in size {{size}}: ', p_name) AS template_content,
 p_brand AS brand, CAST(p_size AS STRING) AS size FROM part""",
    "template_usage_history": """SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id, CAST(l_partkey AS STRING) AS template_id,
 CAST(l_suppkey AS STRING) AS user_id, l_returnflag <> 'R' AS success, l_shipdate AS used_at FROM lineitem""",
    "usage_logs": "SELECT employee_id AS user_id, total_tokens AS tokens_used, timestamp FROM chat_history",
    "company_settings": """SELECT id AS company_id, 25000000 AS monthly_token_limit, 80 AS warning_threshold_percentage, 95 AS critical_threshold_percentage
 FROM companies WHERE CAST(id AS INT) % 2 = 0""",
    "notifications": "SELECT CAST(r_regionkey AS STRING) AS id, r_name AS title, r_regionkey % 2 = 0 AS is_read FROM region",
    "favorites": "SELECT DISTINCT CAST(l_suppkey AS STRING) AS user_id, CAST(l_partkey AS STRING) AS template_id FROM lineitem WHERE l_quantity > 45",
}

_TABLE = re.compile(r"\b(FROM|JOIN) (" + "|".join([*BASE, *VIEWS]) + r")\b")


def parts_of(sql: str) -> list[str]:
    return list(dict.fromkeys(m[2] for m in _TABLE.finditer(sql)))


class Domain:
    """The stored tables and the views over them, as DataFrames of one session."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in BASE:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                self._known[name] = self.sql(VIEWS[name])
            else:
                raise AttributeError(name)
        return self._known[name]

    def sql(self, text: str) -> DataFrame:
        """Run `text`, whose tables may be stored ones or views."""
        names = parts_of(text)
        text = _TABLE.sub(r"\1 {\2}", text.replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def oracle(text: str) -> str:
    """`text` with the views it needs in front, for DuckDB."""
    order: list[str] = []

    def need(sql: str) -> None:
        for name in parts_of(sql):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(text)
    views = [f"{n} AS ({VIEWS[n]})" for n in order]
    text = text.strip()
    if text[:5].upper() == "WITH ":
        keyword = "WITH RECURSIVE " if text[:15].upper() == "WITH RECURSIVE " else "WITH "
        return keyword + ", ".join([*views, text[len(keyword) :]])
    return ("WITH " + ", ".join(views) + "\n" if views else "") + text
