"""Joins, token usage, prices, search telemetry and stateful twins, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from ..operators.analytics import latest
from .registry import query

MONTH = "2024-01"
PLAN_TOKENS = 150_000
YEN = """round(150000.0 + greatest(least({t}, 50000000) - 25000000, 0) / 1000 * 15 + greatest(least({t}, 75000000) - 50000000, 0) / 1000 * 12
 + greatest({t} - 75000000, 0) / 1000 * 10, 2)"""


@query("j2_users_with_company", "SELECT u.id, u.name, u.role, u.created_at, coalesce(c.name, 'no company') AS company FROM users u LEFT JOIN companies c ON c.id = u.company_id")
def users_with_company(d):
    return U.users_with_company(d.users, d.companies)


@query(
    "j3_employee_roster",
    """WITH p AS (SELECT employee_id, count(*) AS messages, max(timestamp) AS last_activity FROM chat_history GROUP BY 1)
 SELECT u.id, u.name, coalesce(c.name, 'no company') AS company, coalesce(l.is_unlimited, false) AS is_unlimited, coalesce(l.questions_used, 0) AS questions_used,
 CAST(coalesce(l.questions_limit, 10) AS BIGINT) AS questions_limit, coalesce(p.messages, 0) AS messages, p.last_activity
 FROM users u LEFT JOIN companies c ON c.id = u.company_id LEFT JOIN usage_limits l ON l.user_id = u.id LEFT JOIN p ON p.employee_id = u.id""",
)
def employee_roster(d):
    return U.employee_roster(d.users, d.companies, d.usage_limits, d.chat_history)


@query("j4_users_without_quota", "SELECT u.id, u.name FROM users u WHERE NOT EXISTS (SELECT 1 FROM usage_limits l WHERE l.user_id = u.id)")
def users_without_quota(d):
    return U.without_quota(d.users, d.usage_limits)


@query(
    "j5_company_history",
    """SELECT DISTINCT h.id, h.employee_id, h.user_id, h.timestamp FROM chat_history h
 WHERE h.employee_id IN (SELECT id FROM users WHERE company_id = '3') OR h.user_id IN (SELECT id FROM users WHERE company_id = '3')""",
)
def company_history(d):
    return U.company_history(d.chat_history, d.users.where("company_id = '3'"))


@query(
    "w13_history_page",
    """SELECT id, employee_id, timestamp, (SELECT count(*) FROM chat_history) AS total FROM chat_history ORDER BY timestamp DESC, id LIMIT 20 OFFSET 40""",
)
def history_page(d):
    return U.page_of(d.chat_history.select("id", "employee_id", "timestamp"), [F.desc("timestamp"), F.col("id")], 3, 20)


ROLLUP = """rollup_rows AS (SELECT company_id, employee_id AS user_id, strftime(timestamp, '%Y-%m') AS year_month, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
 CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS conversations FROM chat_history GROUP BY 1, 2, 3)"""


@query("a23_month_rollup", f"WITH {ROLLUP} SELECT * FROM rollup_rows")
def month_rollup(d):
    return U.monthly_rollup(d.chat_history)


@query("a24_current_month", f"WITH {ROLLUP} SELECT * FROM rollup_rows WHERE year_month = (SELECT strftime(max(timestamp), '%Y-%m') FROM chat_history)")
def current_month(d):
    now = latest(d.chat_history, "timestamp")
    return U.monthly_rollup(d.chat_history).where(F.col("year_month") == F.date_format(F.lit(now), "yyyy-MM"))


@query(
    "j6_company_month_summary",
    f"""WITH {ROLLUP}, p AS (SELECT company_id, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(conversations) AS BIGINT) AS conversations, count(DISTINCT user_id) AS users
 FROM rollup_rows WHERE year_month = '{MONTH}' GROUP BY 1)
 SELECT c.id, c.name, coalesce(tokens, 0) AS tokens, coalesce(conversations, 0) AS conversations, coalesce(users, 0) AS users FROM companies c LEFT JOIN p ON p.company_id = c.id""",
)
def company_month_summary(d):
    return U.company_month_summary(d.companies, U.monthly_rollup(d.chat_history), MONTH)


@query(
    "j7_resource_list",
    """WITH p AS (SELECT source_document AS name, count(*) AS uses, max(timestamp) AS last_used FROM chat_history WHERE source_document IS NOT NULL GROUP BY 1)
 SELECT s.id, s.name, s.type, s.active, coalesce(u.name, 'unknown') AS uploader, coalesce(p.uses, 0) AS uses, p.last_used
 FROM document_sources s LEFT JOIN users u ON u.id = s.uploaded_by LEFT JOIN p ON p.name = s.name""",
)
def resource_list(d):
    return U.resource_list(d.document_sources, d.users, d.chat_history)


@query(
    "j8_account_tree",
    """WITH RECURSIVE tree AS (SELECT id, CAST(1 AS BIGINT) AS depth FROM users WHERE created_by = '0' AND id <> '0'
 UNION ALL SELECT u.id, t.depth + 1 FROM users u JOIN tree t ON u.created_by = t.id WHERE u.id <> u.created_by) SELECT * FROM tree""",
)
def account_tree(d):
    return U.account_tree(d.users, "0")


@query(
    "j12_plan_log",
    """SELECT p.id, p.user_id, p.from_plan, p.to_plan, p.changed_at, coalesce(u.name, 'unknown') AS name, coalesce(c.name, 'no company') AS company, date_diff('day', p.prev_at, p.changed_at) AS duration_days
 FROM plan_history p LEFT JOIN users u ON u.id = p.user_id LEFT JOIN companies c ON c.id = u.company_id""",
)
def plan_log(d):
    people = U.users_with_company(d.users, d.companies).select(F.col("id").alias("user_id"), "name", "company")
    rows = d.plan_history.join(people, "user_id", "left")
    days = F.datediff("changed_at", "prev_at").alias("duration_days")
    named = [F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("company", F.lit("no company")).alias("company")]
    return rows.select("id", "user_id", "from_plan", "to_plan", "changed_at", *named, days)


@query("a44_references_by_type", "SELECT coalesce(s.type, 'other') AS type, count(*) AS n FROM chat_history h LEFT JOIN document_sources s ON s.name = h.source_document WHERE h.source_document IS NOT NULL GROUP BY 1")
def references_by_type(d):
    types = d.document_sources.select(F.col("name").alias("source_document"), "type")
    rows = d.chat_history.where("source_document IS NOT NULL").join(types, "source_document", "left")
    return rows.groupBy(F.coalesce("type", F.lit("other")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


USAGE = """usage_rows AS (SELECT company_id, count(*) AS conversations, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
 CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(prompt_references) AS BIGINT) AS prompt_references, count(DISTINCT user_id) AS users FROM chat_history GROUP BY 1)"""


@query("a21_company_usage", f"WITH {USAGE} SELECT * FROM usage_rows")
def company_usage(d):
    return U.company_usage(d.chat_history)


@query(
    "a25_usage_dashboard",
    f"""WITH {USAGE}, l AS (SELECT u.company_id, total_tokens, coalesce(monthly_token_limit, 25000000) AS m, round(CAST(total_tokens * 100 AS DOUBLE) / coalesce(monthly_token_limit, 25000000), 6) AS percent
 FROM usage_rows u LEFT JOIN company_settings s ON s.company_id = u.company_id)
 SELECT company_id, total_tokens, percent, greatest(m - total_tokens, 0) AS remaining, CASE WHEN percent >= 95 THEN 'critical' WHEN percent >= 80 THEN 'warning' ELSE 'safe' END AS level,
 {YEN.format(t="total_tokens")} AS yen FROM l""",
)
def usage_dashboard(d):
    return U.usage_dashboard(U.company_usage(d.chat_history), d.company_settings)


@query(
    "a27_member_usage",
    """WITH p AS (SELECT employee_id AS id, count(*) AS conversations, sum(input_tokens) AS i, sum(output_tokens) AS o FROM chat_history GROUP BY 1),
 r AS (SELECT u.company_id, u.id, coalesce(conversations, 0) AS conversations, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM users u LEFT JOIN p ON p.id = u.id),
 s AS (SELECT company_id, id, CAST(sum(conversations) AS BIGINT) AS conversations, CAST(sum(i + o) AS BIGINT) AS tokens, sum(i) AS i, sum(o) AS o FROM r GROUP BY GROUPING SETS ((company_id, id), (company_id)))
 SELECT company_id, id, conversations, tokens, round(CAST(i AS DOUBLE) / 1000 * 0.0003 + CAST(o AS DOUBLE) / 1000 * 0.0025, 6) AS usd,
 round((CAST(i AS DOUBLE) / 1000 * 0.0003 + CAST(o AS DOUBLE) / 1000 * 0.0025) * 150, 6) AS yen,
 round(CASE WHEN conversations > 0 THEN CAST(tokens AS DOUBLE) / conversations ELSE 0 END, 6) AS mean_tokens FROM s""",
)
def member_usage(d):
    return U.member_usage(d.users, d.chat_history)


@query(
    "c6_what_if_prices",
    f"""WITH {USAGE}, p AS (SELECT company_id, total_tokens, unnest([{{'plan': 'fixed', 'yen': CAST(150000 AS DOUBLE)}}, {{'plan': 'tiered', 'yen': CAST({YEN.format(t="total_tokens")} AS DOUBLE)}},
 {{'plan': 'two_tier', 'yen': CAST(round(round(CAST(least(total_tokens, 200000) AS DOUBLE) / 1000 * 0.00125 + CAST(greatest(total_tokens - 200000, 0) AS DOUBLE) / 1000 * 0.0025, 6) * 150, 6) AS DOUBLE)}},
 {{'plan': 'standard', 'yen': CAST(round((CAST(input_tokens AS DOUBLE) / 1000 * 0.0003 + CAST(output_tokens AS DOUBLE) / 1000 * 0.0025 + CAST(prompt_references AS DOUBLE) * 0.5 / 150) * 150, 6) AS DOUBLE)}}]) AS p FROM usage_rows)
 SELECT company_id, total_tokens, p.plan AS plan, p.yen AS yen, round(p.yen * 1000000 / greatest(total_tokens, 1), 4) AS yen_per_million FROM p""",
)
def what_if_prices(d):
    return U.what_if_prices(U.company_usage(d.chat_history))


@query(
    "c1_c5_price_usage",
    f"""SELECT id, round(CAST(input_tokens AS DOUBLE) / 1000 * 0.0003 + CAST(output_tokens AS DOUBLE) / 1000 * 0.0025, 6) AS cost_usd, round(CAST(prompt_references AS DOUBLE) * 0.5 / 150, 6) AS reference_usd,
 round(CAST(least(total_tokens * 1000, 200000) AS DOUBLE) / 1000 * 0.00125 + CAST(greatest(total_tokens * 1000 - 200000, 0) AS DOUBLE) / 1000 * 0.0025, 6) AS two_tier_usd,
 CAST({YEN.format(t="(CAST(total_tokens AS BIGINT) * 200000)")} AS DOUBLE) AS yen FROM chat_history""",
)
def price_usage(d):
    rates = d.spark.createDataFrame(U.RATES, "model string, input_rate double, output_rate double")
    rows = d.chat_history.select("id", F.lit("unlisted").alias("model"), "input_tokens", "output_tokens", "total_tokens", "prompt_references")
    priced = U.price_by_model(rows, rates)
    tokens = F.col("total_tokens").cast("long")
    return priced.select(
        "id", "cost_usd", U.reference_cost(F.col("prompt_references")).alias("reference_usd"), U.two_tier_cost(tokens * 1000).alias("two_tier_usd"), U.yen_plan(tokens * 200_000).alias("yen")
    )


@query(
    "c7_backfill_tokens",
    """SELECT id, CASE WHEN total_tokens < 200 THEN CAST(floor((length(user_message) + length(bot_response)) * 13 / 10) AS BIGINT) ELSE CAST(total_tokens AS BIGINT) END AS tokens FROM chat_history""",
)
def backfill_tokens(d):
    guess = F.floor((F.length("user_message") + F.length("bot_response")) * 13 / 10)
    return d.chat_history.select("id", F.when(F.col("total_tokens") < 200, guess).otherwise(F.col("total_tokens")).cast("long").alias("tokens"))


@query("a28_search_basics", "SELECT count(*) AS n, round(avg(execution_time_ms), 6) AS mean_ms, round(avg(result_count), 6) AS mean_results, count(DISTINCT user_id) AS users FROM search_performance_log")
def search_basics(d):
    return U.search_basics(d.search_performance_log)


@query(
    "a29_search_by_type",
    """WITH e AS (SELECT unnest(search_types) AS search_type, execution_time_ms, result_count FROM search_performance_log)
 SELECT search_type, count(*) AS n, round(avg(execution_time_ms), 6) AS mean_ms, round(avg(result_count), 6) AS mean_results FROM e GROUP BY 1""",
)
def search_by_type(d):
    return U.search_by_type(d.search_performance_log)


@query(
    "a30_search_latency",
    """SELECT min(execution_time_ms) AS least_ms, max(execution_time_ms) AS most_ms, round(quantile_cont(execution_time_ms, 0.5), 6) AS median_ms, round(quantile_cont(execution_time_ms, 0.95), 6) AS p95_ms,
 CAST(min(result_count) AS BIGINT) AS least_results, CAST(max(result_count) AS BIGINT) AS most_results FROM search_performance_log""",
)
def search_latency(d):
    return U.search_latency(d.search_performance_log)


@query("a31_popular_queries", "SELECT query_text, count(*) AS n, round(avg(result_count), 6) AS mean_results FROM search_performance_log WHERE trim(query_text) <> '' GROUP BY 1 ORDER BY n DESC, query_text LIMIT 10")
def popular_queries(d):
    return U.popular_queries(d.search_performance_log)


@query(
    "a33_cache_stats",
    """SELECT count(*) AS entries, count(DISTINCT company_id) AS companies, count(DISTINCT search_types[1]) AS types, min(created_at) AS oldest, max(created_at) AS newest
 FROM search_performance_log WHERE created_at + INTERVAL 1 DAY > (SELECT max(created_at) FROM search_performance_log)""",
)
def cache_stats(d):
    return U.cache_stats(d.search_performance_log, latest(d.search_performance_log, "created_at"))


@query(
    "a35_cited_sources",
    """WITH e AS (SELECT trim(regexp_replace(unnest(string_split(sources, ',')), '\\s*\\(P\\.[^)]*\\)', '')) AS source FROM chat_history) SELECT source, count(*) AS n FROM e WHERE source <> '' GROUP BY 1""",
)
def cited_sources(d):
    return U.cited_sources(d.chat_history)


@query("a39_hourly_counts", "SELECT hour(timestamp) AS hour, count(*) AS n FROM chat_history GROUP BY 1")
def hourly_counts(d):
    return U.hourly_counts(d.chat_history)


@query(
    "a40_conversation_quality",
    """SELECT round(avg(length(user_message)), 6) AS mean_question, round(avg(length(bot_response)), 6) AS mean_answer, round(1 - CAST(count(DISTINCT lower(user_message)) AS DOUBLE) / count(*), 6) AS repeat_rate,
 round(CAST(count(*) FILTER (regexp_matches(lower(bot_response), 'sorry|not known|error')) AS DOUBLE) / count(*), 6) AS failure_rate,
 round(CAST(count(*) FILTER (NOT regexp_matches(lower(bot_response), 'sorry|not known|error')) AS DOUBLE) / count(*), 6) AS resolution_rate FROM chat_history""",
)
def conversation_quality(d):
    return U.conversation_quality(d.chat_history)


@query(
    "a41_requests_now",
    """WITH n AS (SELECT max(timestamp) AS m FROM usage_logs) SELECT count(*) FILTER (CAST(timestamp AS DATE) = CAST(m AS DATE)) AS requests_today,
 CAST(sum(tokens_used) FILTER (CAST(timestamp AS DATE) = CAST(m AS DATE)) AS BIGINT) AS tokens_today, count(*) FILTER (date_trunc('month', timestamp) = date_trunc('month', m)) AS requests_month,
 CAST(sum(tokens_used) FILTER (date_trunc('month', timestamp) = date_trunc('month', m)) AS BIGINT) AS tokens_month FROM usage_logs, n""",
)
def requests_now(d):
    return U.requests_now(d.usage_logs, latest(d.usage_logs, "timestamp"))


@query(
    "a42_template_usage",
    "SELECT template_id, count(*) AS uses, round(avg(CAST(success AS INT)), 6) AS success_rate, max(used_at) AS last_used FROM template_usage_history GROUP BY 1",
)
def template_usage(d):
    return U.template_usage(d.template_usage_history)


@query(
    "a47_majority_status",
    """SELECT u.company_id, count(*) FILTER (is_unlimited) AS unlimited, count(*) FILTER (NOT is_unlimited) AS limited, count(*) FILTER (is_unlimited) >= count(*) FILTER (NOT is_unlimited) AS majority_unlimited
 FROM users u JOIN usage_limits l ON l.user_id = u.id WHERE u.company_id IS NOT NULL GROUP BY 1""",
)
def majority_status(d):
    return U.majority_status(d.users, d.usage_limits)


@query(
    "a48_company_groups",
    """SELECT coalesce(company_id, split_part(email, '@', 2)) AS company, count(*) AS users, arg_min(id, (CASE role WHEN 'admin_user' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, id)) AS primary_id FROM users GROUP BY 1""",
)
def company_groups(d):
    return U.company_groups(d.users)


@query("a51_unread_notifications", "SELECT id, title FROM notifications WHERE NOT is_read")
def unread_notifications(d):
    return U.unread(d.notifications)


@query(
    "a54_knowledge_summary",
    """WITH p AS (SELECT source_document AS name, count(*) AS refs FROM chat_history WHERE source_document IS NOT NULL GROUP BY 1)
 SELECT type, count(*) AS sources, count(*) FILTER (active) AS active_sources, CAST(sum(page_count) AS BIGINT) AS pages, CAST(coalesce(sum(refs), 0) AS BIGINT) AS refs
 FROM document_sources s LEFT JOIN p ON p.name = s.name GROUP BY 1""",
)
def knowledge_summary(d):
    return U.knowledge_summary(d.document_sources, d.chat_history)


@query(
    "st2_rate_limit_batch",
    """WITH r AS (SELECT id, employee_id, count(*) OVER (PARTITION BY employee_id ORDER BY timestamp RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS requests FROM chat_history)
 SELECT *, requests <= 2 AS allowed FROM r""",
)
def rate_limit_batch(d):
    return U.rate_limited(d.chat_history, 2)


@query(
    "st6_quota_counters_batch",
    """WITH r AS (SELECT id, employee_id, count(*) OVER (PARTITION BY employee_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS used FROM chat_history)
 SELECT r.id, r.employee_id, used, CAST(questions_limit AS BIGINT) AS questions_limit, coalesce(used = questions_limit, false) AS reached FROM r LEFT JOIN usage_limits l ON l.user_id = r.employee_id""",
)
def quota_counters_batch(d):
    return U.quota_counters(d.chat_history, d.usage_limits)


@query(
    "st8_usage_alerts_batch",
    f"""WITH t AS (SELECT id, company_id, timestamp, CAST(sum(total_tokens) OVER (PARTITION BY company_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM chat_history WHERE company_id IS NOT NULL),
 l AS (SELECT *, CASE WHEN total * 100.0 / {PLAN_TOKENS} >= 95 THEN 'critical' WHEN total * 100.0 / {PLAN_TOKENS} >= 80 THEN 'warning' ELSE 'safe' END AS level FROM t),
 b AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY company_id ORDER BY timestamp, id), 'safe') AS before FROM l)
 SELECT company_id, id, level, total FROM b WHERE level <> before""",
)
def usage_alerts_batch(d):
    return U.usage_alerts(d.chat_history, PLAN_TOKENS)
