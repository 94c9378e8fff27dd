"""Streaming jobs run to their end over the chat log, against the DuckDB twins of their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..sources.shared import shared_path
from ..streaming import jobs, stateful
from .queries_corpus import CHUNKS
from .queries_usage import ROLLUP
from .registry import query


def log_stream(d, files: int):
    """The chat log written by day and read as a file stream."""
    path = shared_path(d.spark, "chat-log")
    jobs.write_by_day(d.chat_history, path)
    return jobs.read_stream(d.spark, path, d.spark.read.parquet(path).schema, files)


def finished(d, stream, name: str):
    """What a stream in append mode has put out when all input is worked off."""
    path = shared_path(d.spark, name)
    jobs.run_all(stream.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), f"{path}/checkpoint")
    return d.spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("st1_month_rollup_stream", f"WITH {ROLLUP} SELECT * FROM rollup_rows")
def month_rollup_stream(d):
    path = shared_path(d.spark, "rollup")
    return jobs.stream_rollup(log_stream(d, 10), f"{path}/table", f"{path}/checkpoint")


@query(
    "st2_rate_limit_stream",
    """WITH r AS (SELECT id, employee_id, count(*) OVER (PARTITION BY employee_id ORDER BY timestamp RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS requests FROM chat_history)
 SELECT *, requests <= 2 AS allowed FROM r""",
)
def rate_limit_stream(d):
    return finished(d, jobs.limit_requests(log_stream(d, 1000), 2), "limit")


@query(
    "st3_enrich_stream",
    """SELECT h.id, coalesce(c.name, 'unknown') AS company, CASE coalesce(h.category, 'other') WHEN 'general' THEN 'General' WHEN 'technical' THEN 'Technical' WHEN 'procedure' THEN 'Procedure'
 WHEN 'finance' THEN 'Finance' ELSE 'Other' END AS category, round(CAST(input_tokens AS DOUBLE) / 1000 * 0.0003 + CAST(output_tokens AS DOUBLE) / 1000 * 0.0025, 6) AS cost_usd
 FROM chat_history h LEFT JOIN companies c ON c.id = h.company_id""",
)
def enrich_stream(d):
    return finished(d, jobs.enrich(log_stream(d, 20), d.companies), "enrich")


@query(
    "st5_daily_activity_stream",
    """WITH du AS (SELECT CAST(timestamp AS DATE) AS day, user_id, count(*) AS n FROM chat_history GROUP BY 1, 2), days AS (SELECT DISTINCT day FROM du)
 SELECT days.day, count(DISTINCT CASE WHEN du.day = days.day THEN user_id END) AS users, CAST(sum(CASE WHEN du.day = days.day THEN n ELSE 0 END) AS BIGINT) AS messages,
 count(DISTINCT user_id) AS users_7d, CAST(sum(n) AS BIGINT) AS messages_7d FROM days JOIN du ON du.day BETWEEN days.day - 6 AND days.day GROUP BY 1""",
    dates=("day",),
)
def daily_activity_stream(d):
    path = shared_path(d.spark, "daily")
    stream = log_stream(d, 20)
    rows = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return jobs.activity_windows(jobs.stream_daily_users(rows, f"{path}/table", f"{path}/checkpoint"))


@query(
    "st6_quota_stream",
    "SELECT id, employee_id, count(*) OVER (PARTITION BY employee_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS used FROM chat_history",
)
def quota_stream(d):
    return finished(d, jobs.count_quota(log_stream(d, 1000)).select("id", "employee_id", F.col("used")), "quota")


@query(
    "st4_embedding_stream",
    CHUNKS
    + r""" SELECT doc_id, chunk_index, content, CASE WHEN regexp_matches(content, '[\p{L}\p{N}]') THEN 64 END AS size, CASE WHEN regexp_matches(content, '[\p{L}\p{N}]') THEN CAST(1 AS DOUBLE) END AS norm FROM chunks""",
)
def embedding_stream(d):
    path = shared_path(d.spark, "embedding-stream")
    d.documents.select("doc_id", "text").repartition(8).write.parquet(f"{path}/in")
    table = stateful.embedding_stream(jobs.read_stream(d.spark, f"{path}/in", d.documents.select("doc_id", "text").schema, 3), f"{path}/out", f"{path}/checkpoint")
    norm = F.round(R.dot(F.col("embedding"), F.col("embedding")), 4)
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return table.read().select("doc_id", "chunk_index", "content", size.alias("size"), norm.alias("norm"))


@query(
    "st8_alert_stream",
    """WITH t AS (SELECT id, company_id, timestamp, sum(total_tokens) OVER (PARTITION BY company_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS total FROM chat_history WHERE company_id IS NOT NULL),
 l AS (SELECT *, CASE WHEN total * 100.0 / 50000 >= 95 THEN 'critical' WHEN total * 100.0 / 50000 >= 80 THEN 'warning' ELSE 'safe' END AS level FROM t),
 b AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY company_id ORDER BY timestamp, id), 'safe') AS before FROM l) SELECT company_id, id, level, CAST(total AS BIGINT) AS total FROM b WHERE level <> before""",
)
def alert_stream(d):
    path = shared_path(d.spark, "alerts")
    return stateful.run_state(stateful.alert_stream(log_stream(d, 20), 50_000), f"{path}/out", f"{path}/checkpoint")


@query(
    "st7_expired_stream",
    """WITH e AS (SELECT concat(query_text, '|', user_id) AS cache_key, id, created_at AS t, lead(created_at) OVER (PARTITION BY query_text, user_id ORDER BY created_at, CAST(id AS VARCHAR)) AS next FROM search_performance_log WHERE user_id IS NOT NULL)
 SELECT cache_key, id FROM e WHERE CASE WHEN next IS NULL THEN t + INTERVAL 6 HOURS < (SELECT max(t) FROM e) ELSE next > t + INTERVAL 6 HOURS END""",
)
def expired_stream(d):
    path = shared_path(d.spark, "cache")
    entries = d.search_performance_log.where("user_id IS NOT NULL").select(F.concat_ws("|", "query_text", "user_id").alias("cache_key"), "id", F.col("created_at").alias("timestamp"))
    jobs.write_by_day(entries, f"{path}/in")
    stream = jobs.read_stream(d.spark, f"{path}/in", d.spark.read.parquet(f"{path}/in").schema, 20)
    return stateful.run_state(stateful.expired_stream(stream, 6), f"{path}/out", f"{path}/checkpoint")
