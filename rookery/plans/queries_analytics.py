"""Chat analytics, plan and window queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from .registry import query

LABEL = """CASE raw WHEN 'general' THEN 'General' WHEN 'technical' THEN 'Technical' WHEN 'procedure' THEN 'Procedure' WHEN 'finance' THEN 'Finance'
 WHEN 'hr' THEN 'Personnel' WHEN 'policy' THEN 'Policy' WHEN 'meeting' THEN 'Meetings' WHEN 'other' THEN 'Other' ELSE concat('* ', raw) END"""


@query(
    "a1_company_periods",
    """SELECT coalesce(c.name, 'unknown') AS company, count(*) AS user_count, min(u.created_at) AS start_at,
 date_diff('day', min(u.created_at), (SELECT max(timestamp) FROM chat_history)) AS usage_days,
 round(date_diff('day', min(u.created_at), (SELECT max(timestamp) FROM chat_history)) / 30.44, 1) AS usage_months
 FROM users u LEFT JOIN companies c ON c.id = u.company_id GROUP BY 1""",
)
def company_periods(d):
    return A.company_periods(d.users, d.companies, A.latest(d.chat_history, "timestamp"))


@query(
    "a2_user_periods",
    """SELECT u.id, coalesce(c.name, 'unknown') AS company,
 date_diff('day', u.created_at, (SELECT max(timestamp) FROM chat_history)) AS usage_days,
 round(date_diff('day', u.created_at, (SELECT max(timestamp) FROM chat_history)) / 30.44, 1) AS usage_months
 FROM users u LEFT JOIN companies c ON c.id = u.company_id""",
)
def user_periods(d):
    return A.user_periods(d.users, d.companies, A.latest(d.chat_history, "timestamp"))


@query(
    "a3_active_users",
    """WITH recent AS (SELECT company_id, employee_id, count(*) AS n FROM chat_history
 WHERE timestamp >= (SELECT max(timestamp) FROM chat_history) - INTERVAL 7 DAY GROUP BY 1, 2)
 SELECT company_id, employee_id, CAST(GROUPING(company_id, employee_id) AS BIGINT) AS level, CAST(sum(n) AS BIGINT) AS chats, count(*) AS users
 FROM recent GROUP BY GROUPING SETS ((company_id, employee_id), (company_id), ())""",
)
def active_users(d):
    return A.active_users(d.chat_history, A.latest(d.chat_history, "timestamp"))


CONTINUITY = """per AS (SELECT user_id, count(*) AS changes, arg_min({'a': from_plan, 'b': to_plan}, (changed_at, id)) AS first,
 arg_max(to_plan, (changed_at, id)) AS current_plan, avg(date_diff('day', prev_at, changed_at)) AS mean_days FROM plan_history GROUP BY 1),
 cont AS (SELECT user_id, changes, CASE WHEN changes = 1 THEN 'once' ELSE 'multiple' END AS kind, current_plan,
 first.a = 'demo' AND first.b = 'production' AND current_plan = 'production' AS stayed,
 first.a = 'production' AND first.b = 'demo' AND current_plan = 'demo' AS returned, round(mean_days, 6) AS mean_days FROM per)"""


@query("a4_plan_continuity", f"WITH {CONTINUITY} SELECT * FROM cont")
def plan_continuity(d):
    return A.plan_continuity(d.plan_history)


@query(
    "a4_plan_continuity_totals",
    f"""WITH {CONTINUITY} SELECT count(*) FILTER (kind IS NULL) AS never, count(*) FILTER (kind = 'once') AS once, count(*) FILTER (kind = 'multiple') AS multiple,
 count(*) FILTER (stayed) AS stayed, count(*) FILTER (returned) AS returned FROM users u LEFT JOIN cont ON cont.user_id = u.id""",
)
def plan_continuity_totals(d):
    return A.plan_continuity_totals(d.plan_history, d.users)


@query(
    "a5_latest_transition",
    """WITH per AS (SELECT user_id, count(*) AS n, arg_max({'f': from_plan, 't': to_plan, 'p': prev_at, 'c': changed_at}, (changed_at, id)) AS last
 FROM plan_history GROUP BY 1 HAVING count(*) >= 2)
 SELECT last.f AS from_plan, last.t AS to_plan, count(*) AS users, round(avg(date_diff('day', last.p, last.c)), 6) AS mean_days FROM per GROUP BY 1, 2""",
)
def latest_transition(d):
    return A.latest_transition(d.plan_history)


@query(
    "a6_plan_transitions",
    """SELECT from_plan, to_plan, count(*) AS changes, round(avg(date_diff('day', prev_at, changed_at)), 1) AS mean_days,
 CAST(sum(date_diff('day', prev_at, changed_at)) AS BIGINT) AS total_days FROM plan_history GROUP BY 1, 2""",
)
def plan_transitions(d):
    return A.plan_transitions(d.plan_history)


@query(
    "a7_resource_references",
    """SELECT source_document, count(*) AS refs, count(DISTINCT user_id) AS users, count(DISTINCT CAST(timestamp AS DATE)) AS days, max(timestamp) AS last_referenced,
 round(sum(CASE sentiment WHEN 'positive' THEN 3 WHEN 'neutral' THEN 2 WHEN 'negative' THEN 1 ELSE 0 END) / count(*), 6) AS satisfaction,
 round(count(*) / greatest(count(DISTINCT user_id), 1), 6) AS intensity
 FROM chat_history WHERE source_document IS NOT NULL AND trim(source_document) <> '' GROUP BY 1""",
)
def resource_references(d):
    return A.resource_references(d.chat_history)


@query(
    "a8_category_distribution",
    f"""WITH l AS (SELECT *, CASE WHEN category IS NULL OR trim(category) = '' OR category = 'None' THEN 'other' ELSE trim(category) END AS raw FROM chat_history),
 g AS (SELECT {LABEL} AS category, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT CAST(timestamp AS DATE)) AS days,
 count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative
 FROM l GROUP BY 1),
 s AS (SELECT *, round((3 * positive + 2 * neutral + negative) / n, 6) AS score, round(CAST(n * 100 AS DOUBLE) / sum(n) OVER (), 6) AS share,
 round(CAST(n * 100 AS DOUBLE) / sum(n) OVER () - CAST(100 AS DOUBLE) / count(*) OVER (), 6) AS bias FROM g)
 SELECT *, bias > 10 AS over, bias < -10 AS under, CASE WHEN score > 2.3 THEN 'positive' WHEN score < 1.7 THEN 'negative' ELSE 'balanced' END AS mood,
 row_number() OVER (ORDER BY n DESC, category) AS top_rank, row_number() OVER (ORDER BY n, category) AS bottom_rank FROM s""",
)
def category_distribution(d):
    return A.category_distribution(d.chat_history)


DAILY = """daily AS (SELECT CAST(timestamp AS DATE) AS day, count(DISTINCT user_id) AS users, count(*) AS messages, count(DISTINCT employee_name) AS names,
 round(CAST(count(*) FILTER (sentiment = 'positive') AS DOUBLE) / count(*), 6) AS positive_ratio FROM chat_history GROUP BY 1)"""


@query("a9_daily_activity", f"WITH {DAILY} SELECT * FROM daily", dates=("day",))
def daily_activity(d):
    return A.daily_activity(d.chat_history)


@query(
    "a10_active_day_weeks",
    f"""WITH {DAILY}, b AS (SELECT *, (row_number() OVER (ORDER BY day) - 1) // 7 AS bucket FROM daily)
 SELECT bucket, min(day) AS first_day, max(day) AS last_day, round(avg(users), 1) AS mean_users, CAST(sum(messages) AS BIGINT) AS messages, count(*) AS active_days FROM b GROUP BY 1""",
    dates=("first_day", "last_day"),
)
def active_day_weeks(d):
    return A.active_day_weeks(A.daily_activity(d.chat_history))


@query("a11_calendar_weeks", "SELECT CAST(date_trunc('week', timestamp) AS DATE) AS week, count(DISTINCT user_id) AS users, count(*) AS messages FROM chat_history GROUP BY 1", dates=("week",))
def calendar_weeks(d):
    return A.calendar_weeks(d.chat_history)


@query(
    "a12_activity_trend",
    f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS r FROM daily),
 t AS (SELECT avg(users) FILTER (r <= 7) AS recent, avg(users) FILTER (r > 7 AND r <= 14) AS previous, arg_max(day, (users, day)) AS peak_day FROM r)
 SELECT round(recent, 6) AS recent, round(previous, 6) AS previous, round((recent - previous) * 100.0 / previous, 6) AS percent,
 CASE WHEN recent > previous THEN 'up' WHEN recent < previous THEN 'down' ELSE 'flat' END AS direction, peak_day,
 (SELECT count(DISTINCT user_id) FROM chat_history) AS users FROM t""",
    dates=("peak_day",),
)
def activity_trend(d):
    return A.activity_trend(d.chat_history)


@query(
    "a14_sentiment_breakdown",
    """WITH r AS (SELECT coalesce(sentiment, 'neutral') AS sentiment, coalesce(category, 'other') AS category, CAST(timestamp AS DATE) AS day FROM chat_history)
 SELECT sentiment, category, day, count(*) AS n FROM r GROUP BY GROUPING SETS ((sentiment), (sentiment, category), (sentiment, day))""",
    dates=("day",),
)
def sentiment_breakdown(d):
    return A.sentiment_breakdown(d.chat_history)


@query(
    "a15_overall_sentiment",
    "SELECT count(*) AS n, round(avg(CASE sentiment WHEN 'positive' THEN 1.0 WHEN 'neutral' THEN 0.5 ELSE 0.0 END), 3) AS score FROM chat_history",
)
def overall_sentiment(d):
    return A.overall_sentiment(d.chat_history)


SUMMARY = """r AS (SELECT coalesce(sentiment, 'neutral') AS sentiment, coalesce(category, 'other') AS category, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day FROM chat_history),
 g AS (SELECT category, sentiment, day, count(*) AS n FROM r GROUP BY GROUPING SETS ((), (category), (sentiment), (day))),
 parts AS (SELECT CASE WHEN category IS NOT NULL THEN 'category' WHEN sentiment IS NOT NULL THEN 'sentiment' WHEN day IS NOT NULL THEN 'day' ELSE 'total' END AS section,
 coalesce(category, sentiment, day, 'all') AS key, n FROM g),
 summary AS (SELECT *, round(CAST(n * 100 AS DOUBLE) / sum(n) OVER (PARTITION BY section), 6) AS percent FROM parts)"""


@query("a16_chat_summary", f"WITH {SUMMARY} SELECT * FROM summary")
def chat_summary(d):
    return A.chat_summary(d.chat_history)


@query("a17_common_questions", "SELECT user_message, count(*) AS n FROM chat_history GROUP BY 1 ORDER BY n DESC, user_message LIMIT 10")
def common_questions(d):
    return A.common_questions(d.chat_history)


@query(
    "a18_insight_facts",
    f"""WITH {SUMMARY}, k AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, key) AS r FROM summary WHERE section <> 'total')
 SELECT section, key, CASE WHEN section = 'sentiment' THEN percent ELSE CAST(n AS DOUBLE) END AS value FROM k
 WHERE (section = 'category' AND r <= 3) OR section = 'sentiment' OR (section = 'day' AND r <= 2)
 UNION ALL SELECT 'flag', 'negative_over_20', CAST(coalesce(max(percent) FILTER (section = 'sentiment' AND key = 'negative') > 20, false) AS DOUBLE) FROM k""",
)
def insight_facts(d):
    return A.insight_facts(d.chat_history)


@query(
    "a19_employee_usage",
    """WITH p AS (SELECT employee_id, coalesce(category, 'other') AS category, count(*) AS n, max(timestamp) AS latest FROM chat_history GROUP BY 1, 2),
 s AS (SELECT employee_id, CAST(sum(n) AS BIGINT) AS messages, max(latest) AS last_activity, string_agg(concat(category, '=', n), ',' ORDER BY concat(category, '=', n)) AS categories FROM p GROUP BY 1),
 q AS (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY timestamp DESC, id DESC) AS r FROM chat_history)
 SELECT s.*, (SELECT string_agg(user_message, ' | ' ORDER BY r) FROM q WHERE q.employee_id = s.employee_id AND r <= 3) AS last_questions FROM s""",
)
def employee_usage(d):
    return A.employee_usage(d.chat_history)


@query(
    "a20_usage_overview",
    """SELECT 'users' AS metric, count(*) AS value FROM users UNION ALL
 SELECT 'active_users', count(DISTINCT employee_id) FROM chat_history WHERE timestamp >= (SELECT max(timestamp) FROM chat_history) - INTERVAL 7 DAY UNION ALL
 SELECT 'documents', count(*) FROM document_sources UNION ALL SELECT 'questions', count(*) FROM chat_history UNION ALL
 SELECT 'limit_reached', count(*) FROM usage_limits WHERE NOT is_unlimited AND questions_used >= questions_limit UNION ALL SELECT 'companies', count(*) FROM companies""",
)
def usage_overview(d):
    return A.usage_overview(d.users, d.chat_history, d.document_sources, d.usage_limits, d.companies, A.latest(d.chat_history, "timestamp"))


REPEATS = """t AS (SELECT id, employee_id, user_message, LEAD(id) OVER w AS next_id, LEAD(user_message) OVER w AS next_message FROM chat_turns
 WINDOW w AS (PARTITION BY employee_id ORDER BY conv_id, turn)),
 s AS (SELECT *, list_distinct(string_split(lower(user_message), ' ')) AS a, list_distinct(string_split(lower(next_message), ' ')) AS b FROM t WHERE next_id IS NOT NULL),
 repeats AS (SELECT employee_id, id, next_id, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / least(len(a), len(b)), 6) AS similarity FROM s WHERE len(a) > 2 AND len(b) > 2)"""


@query("w1_repeated_questions", f"WITH {REPEATS} SELECT * FROM repeats WHERE similarity > 0.3")
def repeated_questions(d):
    return A.repeated_questions(d.chat_turns, top=None)


UNRESOLVED = """n AS (SELECT *, LEAD(id) OVER (PARTITION BY employee_id ORDER BY timestamp, id) AS next_id FROM chat_history),
 k AS (SELECT id, employee_id, CASE WHEN lower(bot_response) LIKE '%sorry%' THEN 'apology' WHEN sentiment = 'negative' THEN 'negative'
 WHEN length(bot_response) < 50 THEN 'short_answer' END AS issue_type, timestamp FROM n WHERE next_id IS NOT NULL),
 unresolved AS (SELECT * FROM k WHERE issue_type IS NOT NULL)"""


@query("w2_unresolved_questions", f"WITH {UNRESOLVED} SELECT * FROM unresolved")
def unresolved_questions(d):
    return A.unresolved_questions(d.chat_history, top=None)


@query(
    "a13_repeat_and_unresolved_rates",
    f"""WITH {UNRESOLVED} SELECT (SELECT count(*) FROM chat_history) AS questions, count(*) AS unresolved,
 round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM chat_history), 6) AS unresolved_rate FROM unresolved""",
)
def unresolved_rates(d):
    n = d.chat_history.count()
    found = A.unresolved_questions(d.chat_history, top=None)
    return found.agg(F.lit(n).alias("questions"), F.count(F.lit(1)).alias("unresolved"), F.round(F.count(F.lit(1)) / F.lit(float(n)), 6).alias("unresolved_rate"))
