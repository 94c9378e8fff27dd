"""Scans, predicates, sorts, sets and maintenance with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as P
from ..operators import maintain as M
from .registry import query

LIMITS = "user_id, is_unlimited, questions_used, CAST(questions_limit AS BIGINT) AS questions_limit, document_uploads_used, CAST(document_uploads_limit AS BIGINT) AS document_uploads_limit"


@query("s1_scan_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 50 OFFSET 100")
def scan_page(d):
    return M.scan(d.orders, ["o_orderkey", "o_totalprice"], {"o_orderstatus": "F", "o_custkey": None}, "o_orderkey", True, 50, 100)


@query("s3_update_by_key", "SELECT id, name, CASE WHEN company_id = '3' THEN 'employee' ELSE role END AS role FROM users")
def update_by_key(d):
    return M.update_where(d.users, F.col("company_id") == "3", {"role": F.lit("employee")}).select("id", "name", "role")


@query("s4_delete_by_key", "SELECT id, name FROM users WHERE company_id IS NULL OR company_id <> '3'")
def delete_by_key(d):
    return M.delete_where(d.users, F.col("company_id") == "3").select("id", "name")


@query("s14_document_kinds", "SELECT 'x' || id || CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.xlsx' ELSE '' END AS file, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'excel' ELSE 'other' END AS kind FROM document_sources")
def document_kinds(d):
    n = F.col("id").cast("long") % 3
    rows = d.document_sources.select(F.concat(F.lit("x"), "id", F.when(n == 0, ".PDF").when(n == 1, ".xlsx").otherwise("")).alias("file"))
    return rows.withColumn("kind", P.file_kind(F.col("file")))


@query("s11_search_index", "SELECT c.id AS chunk_id, s.name, s.type, coalesce(s.special, '') AS special, c.company_id FROM document_sources c JOIN document_sources s ON s.id = c.id WHERE s.active")
def search_index(d):
    docs = d.document_sources.where("active").select("id", "name", "type", F.coalesce("special", F.lit("")).alias("special"))
    return d.document_sources.select(F.col("id").alias("chunk_id"), F.col("id"), "company_id").join(docs, "id").select("chunk_id", "name", "type", "special", "company_id")


@query("p4_trailing_window", "SELECT id, timestamp FROM chat_history WHERE timestamp >= (SELECT max(timestamp) FROM chat_history) - INTERVAL 3 DAY")
def trailing_window(d):
    now = d.chat_history.agg(F.max("timestamp")).first()[0]
    return d.chat_history.where(F.col("timestamp") >= F.lit(now) - F.expr("INTERVAL 3 DAYS")).select("id", "timestamp")


@query(
    "p5_p10_display_rows",
    """SELECT id, CASE WHEN length(bot_response) > 100 THEN left(bot_response, 100) || '...' ELSE bot_response END AS shown,
 strftime(timestamp + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') || ' JST' AS shown_at, coalesce(TRY_CAST(regexp_extract(user_message, '([0-9a-z]+)$', 1) AS BIGINT), -1) AS number FROM chat_history""",
)
def display_rows(d):
    number = P.safe_long(F.regexp_extract("user_message", "([0-9a-z]+)$", 1), -1)
    return d.chat_history.select("id", P.shorten(F.col("bot_response")).alias("shown"), P.tokyo_time(F.col("timestamp")).alias("shown_at"), number.alias("number"))


@query(
    "p14_validate_users",
    """WITH v AS (SELECT id, company_id, CASE WHEN CAST(id AS INT) % 7 = 0 THEN replace(email, '@', '@@') WHEN CAST(id AS INT) % 7 = 1 THEN replace(email, '.', '..') WHEN CAST(id AS INT) % 7 = 2 THEN 'a@b' ELSE email END AS email, name FROM users)
 SELECT id, CASE WHEN length(email) < 5 THEN 'too short' WHEN regexp_matches(email, '\\.\\.') THEN 'two dots' WHEN length(email) - length(replace(email, '@', '')) <> 1 THEN 'not one @' END AS email_problem,
 CASE WHEN length(name) > 50 THEN 'too long' END AS name_problem, count(*) OVER (PARTITION BY email) AS same_email FROM v""",
)
def validate_users(d):
    n, email = F.col("id").cast("int") % 7, F.col("email")
    spoiled = F.when(n == 0, F.replace(email, F.lit("@"), F.lit("@@"))).when(n == 1, F.replace(email, F.lit("."), F.lit(".."))).when(n == 2, "a@b").otherwise(email)
    rows = d.users.withColumn("email", spoiled)
    counts = rows.groupBy("email").agg(F.count(F.lit(1)).alias("same_email"))
    return rows.join(counts, "email").select("id", P.email_problem(email).alias("email_problem"), P.name_problem(F.col("name")).alias("name_problem"), "same_email")


@query(
    "p17_quota_decisions",
    "SELECT user_id, CASE WHEN is_unlimited THEN NULL ELSE questions_limit - questions_used END AS remaining, is_unlimited OR questions_limit - questions_used > 0 AS allowed FROM usage_limits",
)
def quota_decisions(d):
    rows = d.usage_limits.select("user_id", P.quota_allows(F.col("is_unlimited"), F.col("questions_used"), F.col("questions_limit")).alias("q"))
    return rows.select("user_id", F.col("q.remaining"), F.col("q.allowed"))


@query("p19_plan_names", "SELECT CASE WHEN to_plan = 'unlimited' THEN 'production' ELSE to_plan END AS plan, count(*) AS n FROM plan_history GROUP BY 1")
def plan_names(d):
    return d.plan_history.groupBy(P.plan_name(F.col("to_plan")).alias("plan")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p21_visible_chats",
    """WITH p AS (SELECT company_id, employee_id, count(*) AS n FROM chat_history GROUP BY 1, 2),
 v AS (SELECT u.id AS viewer, p.n FROM users u JOIN p ON u.role = 'admin_user' AND p.company_id = u.company_id UNION ALL SELECT u.id, p.n FROM users u JOIN p ON u.role <> 'admin_user' AND p.employee_id = u.id)
 SELECT viewer, CAST(sum(n) AS BIGINT) AS chats FROM v GROUP BY 1""",
)
def visible_chats(d):
    """What each viewer may see, as two equi joins: by company for admins, own rows for others."""
    viewers = d.users
    per = d.chat_history.groupBy("company_id", "employee_id").agg(F.count(F.lit(1)).alias("n"))
    admins = viewers.where("role = 'admin_user'").select(F.col("id").alias("viewer"), "company_id").join(per.drop("employee_id"), "company_id")
    others = viewers.where("role <> 'admin_user'").select(F.col("id").alias("viewer"), F.col("id").alias("employee_id")).join(per.drop("company_id"), "employee_id")
    return admins.select("viewer", "n").unionByName(others.select("viewer", "n")).groupBy("viewer").agg(F.sum("n").alias("chats"))


@query("w3_current_plan", "SELECT user_id, arg_max(to_plan, (changed_at, id)) AS plan, count(*) AS changes FROM plan_history GROUP BY 1")
def current_plan(d):
    return d.plan_history.groupBy("user_id").agg(F.max_by("to_plan", F.struct("changed_at", "id")).alias("plan"), F.count(F.lit(1)).alias("changes"))


@query("w12_plan_durations", "SELECT id, date_diff('day', lag(changed_at) OVER (PARTITION BY user_id ORDER BY changed_at, id), changed_at) AS days FROM plan_history")
def plan_durations(d):
    from pyspark.sql import Window

    return d.plan_history.select("id", F.datediff("changed_at", F.lag("changed_at").over(Window.partitionBy("user_id").orderBy("changed_at", "id"))).alias("days"))


@query("k4_template_order", "SELECT template_id, count(*) AS uses, max(used_at) AS last_used FROM template_usage_history GROUP BY 1 ORDER BY uses DESC, last_used DESC, template_id LIMIT 25")
def template_order(d):
    rows = d.template_usage_history.groupBy("template_id").agg(F.count(F.lit(1)).alias("uses"), F.max("used_at").alias("last_used"))
    return rows.orderBy(F.desc("uses"), F.desc("last_used"), "template_id").limit(25)


@query("u4_favorite_toggles", """WITH t AS (SELECT DISTINCT user_id, template_id FROM template_usage_history WHERE NOT success)
 (SELECT * FROM favorites EXCEPT SELECT * FROM t) UNION ALL (SELECT * FROM t EXCEPT SELECT * FROM favorites)""")
def favorite_toggles(d):
    return M.symmetric_difference(d.favorites, d.template_usage_history.where("NOT success").select("user_id", "template_id"))


@query("j9_favorites_with_template", "SELECT f.user_id, f.template_id, t.title FROM favorites f JOIN prompt_templates t ON t.id = f.template_id")
def favorites_with_template(d):
    return d.favorites.join(d.prompt_templates.select(F.col("id").alias("template_id"), "title"), "template_id").select("user_id", "template_id", "title")


@query("u6_read_still_existing", "SELECT id FROM notifications WHERE is_read INTERSECT SELECT id FROM notifications")
def read_still_existing(d):
    return d.notifications.where("is_read").select("id").intersect(d.notifications.select("id"))


@query("m1_delete_document", "SELECT s.id, s.name FROM document_sources s WHERE s.special IS NULL")
def delete_document(d):
    gone = d.document_sources.where("special IS NOT NULL").select("id")
    return M.delete_keys(d.document_sources, "id", gone).select("id", "name")


@query(
    "m2_delete_users",
    """WITH g AS (SELECT id FROM users WHERE role = 'user') SELECT 'users' AS tbl, count(*) AS n FROM users WHERE id NOT IN (SELECT id FROM g)
 UNION ALL SELECT 'limits', count(*) FROM usage_limits WHERE user_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'documents', count(*) FROM document_sources WHERE uploaded_by NOT IN (SELECT id FROM g)
 UNION ALL SELECT 'chats', count(*) FROM chat_history WHERE employee_id NOT IN (SELECT id FROM g)""",
)
def delete_users(d):
    tables = {"users": (d.users, "id"), "limits": (d.usage_limits, "user_id"), "documents": (d.document_sources, "uploaded_by"), "chats": (d.chat_history, "employee_id")}
    kept = M.delete_users(tables, d.users.where("role = 'user'").select("id"))
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in kept.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    "m3_missing_quota",
    f"SELECT {LIMITS} FROM usage_limits UNION ALL SELECT id, false, 0, 10, 0, 2 FROM users WHERE id NOT IN (SELECT user_id FROM usage_limits)",
)
def missing_quota(d):
    return M.with_missing_quota(d.users, d.usage_limits)


TREE = "WITH RECURSIVE tree AS (SELECT id FROM users WHERE created_by = '1' AND id <> '1' UNION ALL SELECT u.id FROM users u JOIN tree t ON u.created_by = t.id)"
SET_PLAN = "SELECT user_id, CASE WHEN {hit} THEN false ELSE is_unlimited END AS is_unlimited, CASE WHEN {hit} THEN least(questions_used, 10) ELSE questions_used END AS questions_used, CAST(CASE WHEN {hit} THEN 10 ELSE questions_limit END AS BIGINT) AS questions_limit FROM usage_limits"


@query("m4_plan_down_the_tree", TREE + " " + SET_PLAN.format(hit="user_id IN (SELECT id FROM tree)"))
def plan_down_the_tree(d):
    return M.propagate_down(d.users, d.usage_limits, "1", False).select("user_id", "is_unlimited", "questions_used", "questions_limit")


@query("m5_plan_across_company", SET_PLAN.format(hit="user_id IN (SELECT id FROM users WHERE company_id = (SELECT company_id FROM users WHERE id = '5'))"))
def plan_across_company(d):
    return M.propagate_company(d.users, d.usage_limits, "5", False).select("user_id", "is_unlimited", "questions_used", "questions_limit")


@query(
    "m6_unify_companies",
    """WITH m AS (SELECT u.company_id, count(*) FILTER (is_unlimited) >= count(*) FILTER (NOT is_unlimited) AS major FROM users u JOIN usage_limits l ON l.user_id = u.id WHERE u.company_id IS NOT NULL GROUP BY 1)
 SELECT l.user_id, coalesce(m.major, l.is_unlimited) AS is_unlimited FROM usage_limits l LEFT JOIN users u ON u.id = l.user_id LEFT JOIN m ON m.company_id = u.company_id""",
)
def unify_companies(d):
    return M.unify_companies(d.users, d.usage_limits).select("user_id", "is_unlimited")


@query("m7_toggle_active", "SELECT id, CASE WHEN type = 'pdf' THEN NOT active ELSE active END AS active FROM document_sources")
def toggle_active(d):
    return M.update_where(d.document_sources, F.col("type") == "pdf", {"active": ~F.col("active")}).select("id", "active")


@query(
    "m9_settings_upsert",
    """SELECT c.id AS company_id, CAST(coalesce(CASE WHEN CAST(c.id AS INT) % 3 = 0 THEN 30000000 END, monthly_token_limit, CASE WHEN s.company_id IS NULL THEN 25000000 END) AS BIGINT) AS monthly_token_limit
 FROM companies c LEFT JOIN company_settings s ON s.company_id = c.id""",
)
def settings_upsert(d):
    new = d.companies.select(F.col("id").alias("company_id"), F.when(F.col("id").cast("int") % 3 == 0, 30_000_000).alias("monthly_token_limit"))
    merged = M.upsert(d.company_settings, new, "company_id")
    return merged.select("company_id", F.coalesce("monthly_token_limit", F.lit(25_000_000)).alias("monthly_token_limit"))


@query(
    "m10_count_up",
    "SELECT l.user_id, l.questions_used + coalesce(n, 0) AS questions_used FROM usage_limits l LEFT JOIN (SELECT user_id, count(*) AS n FROM chat_history GROUP BY 1) h ON h.user_id = l.user_id",
)
def count_up(d):
    return M.count_up(d.usage_limits, "user_id", "questions_used", d.chat_history.select("user_id")).select("user_id", "questions_used")


@query(
    "m11_replace_children",
    """SELECT template_id, id FROM template_usage_history WHERE template_id NOT IN (SELECT id FROM prompt_templates WHERE size = '7') UNION ALL SELECT id, 'new-' || id FROM prompt_templates WHERE size = '7'""",
)
def replace_children(d):
    new = d.prompt_templates.where("size = '7'").select(F.col("id").alias("template_id"), F.concat(F.lit("new-"), "id").alias("id"))
    return M.replace_children(d.template_usage_history.select("template_id", "id"), "template_id", new)


@query("m14_soft_delete", "SELECT id, active AND company_id NOT IN ('1', '2') AS active FROM document_sources")
def soft_delete(d):
    owners = d.companies.where("id IN ('1', '2')").select("id")
    return M.owned_soft_delete(d.document_sources, "company_id", owners).select("id", "active")


@query(
    "q27_fill_templates",
    "SELECT t.id, replace(replace(t.template_content, '{{brand}}', t.brand), '{{size}}', t.size) AS prompt, coalesce(n, 0) AS uses FROM prompt_templates t LEFT JOIN (SELECT template_id, count(*) AS n FROM template_usage_history GROUP BY 1) u ON u.template_id = t.id",
)
def fill_templates(d):
    values = F.create_map(F.lit("brand"), F.col("brand"), F.lit("size"), F.col("size"))
    fill = F.aggregate(F.map_entries(values), F.col("template_content"), lambda text, e: F.replace(text, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))
    uses = d.template_usage_history.groupBy(F.col("template_id").alias("id")).agg(F.count(F.lit(1)).alias("uses"))
    return d.prompt_templates.select("id", fill.alias("prompt")).join(uses, "id", "left").na.fill(0, ["uses"])
