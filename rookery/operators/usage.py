"""Joins of users, companies, documents and chat; token usage and prices; search telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path

from .analytics import count_if

#: Dollars per 1,000 tokens by model (input, output), dollars per reference, yen a dollar.
RATES = [("standard", 0.0003, 0.0025), ("large", 0.00125, 0.01), ("small", 0.0001, 0.0004)]
DEFAULT_MODEL = "standard"
REFERENCE_YEN = 0.50
YEN_PER_USD = 150.0
#: The yen plan: base fee, tokens in it, and yen per 1,000 tokens beyond 25, 50 and 75 million.
BASE_FEE, BASE_TOKENS = 150_000, 25_000_000
TIERS = [(25_000_000, 15), (50_000_000, 12), (75_000_000, 10)]


def users_with_company(users: DataFrame, companies: DataFrame, none: str = "no company") -> DataFrame:
    named = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    return users.join(named, "company_id", "left").select("id", "name", "role", "created_at", F.coalesce("company", F.lit(none)).alias("company"))


def employee_roster(users: DataFrame, companies: DataFrame, limits: DataFrame, chat: DataFrame) -> DataFrame:
    """Users with company, quota (defaults when absent), message count and last activity; chat is aggregated before the join."""
    per = chat.groupBy(F.col("employee_id").alias("id")).agg(F.count(F.lit(1)).alias("messages"), F.max("timestamp").alias("last_activity"))
    quota = limits.select(F.col("user_id").alias("id"), "is_unlimited", "questions_used", "questions_limit")
    rows = users_with_company(users, companies).join(quota, "id", "left").join(per, "id", "left")
    return rows.select(
        "id",
        "name",
        "company",
        F.coalesce("is_unlimited", F.lit(False)).alias("is_unlimited"),
        F.coalesce("questions_used", F.lit(0)).alias("questions_used"),
        F.coalesce("questions_limit", F.lit(10)).alias("questions_limit"),
        F.coalesce("messages", F.lit(0)).alias("messages"),
        "last_activity",
    )


def without_quota(users: DataFrame, limits: DataFrame) -> DataFrame:
    return users.join(limits.select(F.col("user_id").alias("id")), "id", "left_anti").select("id", "name")


def company_history(chat: DataFrame, members: DataFrame) -> DataFrame:
    """Chats whose employee or user is a member: two semi joins and a dedupe, not an OR join."""
    ids = members.select("id").distinct()
    by_employee = chat.join(ids.withColumnRenamed("id", "employee_id"), "employee_id", "left_semi").select("id", "employee_id", "user_id", "timestamp")
    by_user = chat.join(ids.withColumnRenamed("id", "user_id"), "user_id", "left_semi").select("id", "employee_id", "user_id", "timestamp")
    return by_employee.unionByName(by_user).dropDuplicates(["id"])


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page in order, with the number of rows in all."""
    total = df.count()
    return df.orderBy(*order).offset((page - 1) * size).limit(size).withColumn("total", F.lit(total).cast("long"))


def monthly_rollup(chat: DataFrame) -> DataFrame:
    """Token sums by company, user and month."""
    month = F.date_format("timestamp", "yyyy-MM")
    return chat.groupBy("company_id", F.col("employee_id").alias("user_id"), month.alias("year_month")).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("conversations")
    )


def company_month_summary(companies: DataFrame, rollup: DataFrame, month: str) -> DataFrame:
    """Every company with its sums of the month; zero where it has none."""
    per = rollup.where(F.col("year_month") == month).groupBy("company_id").agg(
        F.sum("total_tokens").alias("tokens"), F.sum("conversations").alias("conversations"), F.countDistinct("user_id").alias("users")
    )
    rows = companies.join(per, companies["id"] == per["company_id"], "left")
    return rows.select("id", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "conversations", "users")))


def resource_list(docs: DataFrame, users: DataFrame, chat: DataFrame) -> DataFrame:
    """Documents with uploader, use count and last use."""
    used = chat.where("source_document IS NOT NULL").groupBy(F.col("source_document").alias("name")).agg(F.count(F.lit(1)).alias("uses"), F.max("timestamp").alias("last_used"))
    people = users.select(F.col("id").alias("uploaded_by"), F.col("name").alias("uploader"))
    rows = docs.select("id", "name", "type", "active", "uploaded_by").join(people, "uploaded_by", "left").join(used, "name", "left")
    return rows.select("id", "name", "type", "active", F.coalesce("uploader", F.lit("unknown")).alias("uploader"), F.coalesce("uses", F.lit(0)).alias("uses"), "last_used")


def account_tree(users: DataFrame, root: str) -> DataFrame:
    """id, depth of all accounts created below `root`; a level a join, until one adds nothing.

    Levels are written to the shared folder, so that each is computed once; a cycle doesn't return the root.
    """
    spark, path = users.sparkSession, shared_path(users.sparkSession, "account-tree")
    links = users.select("id", "created_by").where((F.col("created_by") != F.col("id")) & (F.col("id") != root))
    level, depth = links.where(F.col("created_by") == root).select("id"), 1
    schema = "id string, depth int"
    while True:
        level.write.parquet(f"{path}/depth={depth}")
        level = spark.read.schema("id string").parquet(f"{path}/depth={depth}")
        if level.isEmpty():
            return spark.read.schema(schema).parquet(path)
        found = spark.read.schema(schema).parquet(path).select("id")
        below = links.join(level.select(F.col("id").alias("created_by")), "created_by").select("id").distinct()
        level, depth = below.join(found, "id", "left_anti"), depth + 1


def price_by_model(tokens: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds cost_usd: tokens by rate per 1,000; unknown models are priced as the default one."""
    known = rates.select("model", "input_rate", "output_rate")
    fallback = known.where(F.col("model") == DEFAULT_MODEL).first()
    rows = tokens.join(known, "model", "left")
    cost = F.col("input_tokens") / 1000 * F.coalesce("input_rate", F.lit(fallback["input_rate"])) + F.col("output_tokens") / 1000 * F.coalesce("output_rate", F.lit(fallback["output_rate"]))
    return rows.withColumn("cost_usd", F.round(cost, 6)).drop("input_rate", "output_rate")


def reference_cost(references: Column) -> Column:
    """Dollars of prompt references."""
    return F.round(references * REFERENCE_YEN / YEN_PER_USD, 6)


def two_tier_cost(tokens: Column, limit: int = 200_000, low: float = 0.00125, high: float = 0.0025) -> Column:
    """Dollars of tokens at one rate per 1,000 up to a limit and another beyond."""
    return F.round(F.least(tokens, F.lit(limit)) / 1000 * low + F.greatest(tokens - limit, F.lit(0)) / 1000 * high, 6)


def yen_plan(tokens: Column) -> Column:
    """Yen of a month: the base fee up to its tokens, then by tiers."""
    out: Column = F.lit(BASE_FEE).cast("double")
    bounds = [t[0] for t in TIERS[1:]] + [None]
    for (start, rate), end in zip(TIERS, bounds, strict=True):
        upper = tokens if end is None else F.least(tokens, F.lit(end))
        out = out + F.greatest(upper - start, F.lit(0)) / 1000 * rate
    return F.round(out, 2)


def warning_level(percent: Column, warning: Column | None = None, critical: Column | None = None) -> Column:
    warning = F.lit(80) if warning is None else warning
    critical = F.lit(95) if critical is None else critical
    return F.when(percent >= critical, "critical").when(percent >= warning, "warning").otherwise("safe")


def company_usage(chat: DataFrame, month: str | None = None) -> DataFrame:
    """Tokens, conversations and users by company, of one month or all."""
    rows = chat if month is None else chat.where(F.date_format("timestamp", "yyyy-MM") == month)
    return rows.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("conversations"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"),
        F.sum("prompt_references").alias("prompt_references"),
        F.countDistinct("user_id").alias("users"),
    )


def usage_dashboard(usage: DataFrame, settings: DataFrame, default_limit: int = BASE_TOKENS) -> DataFrame:
    """Company usage against its limit: percent, what remains, level, yen."""
    rows = usage.join(settings, "company_id", "left")
    limit = F.coalesce("monthly_token_limit", F.lit(default_limit))
    percent = F.round(F.col("total_tokens") * 100.0 / limit, 6)
    level = warning_level(percent, F.coalesce("warning_threshold_percentage", F.lit(80)), F.coalesce("critical_threshold_percentage", F.lit(95)))
    return rows.select(
        "company_id", "total_tokens", percent.alias("percent"), F.greatest(limit - F.col("total_tokens"), F.lit(0)).alias("remaining"), level.alias("level"), yen_plan(F.col("total_tokens")).alias("yen")
    )


def member_usage(users: DataFrame, chat: DataFrame) -> DataFrame:
    """Tokens and cost by member and by company (null member), zero for those without chats."""
    per = chat.groupBy(F.col("employee_id").alias("id")).agg(F.count(F.lit(1)).alias("conversations"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    rows = users.select("id", "company_id").join(per, "id", "left").na.fill(0, ["conversations", "i", "o"])
    sums = rows.groupingSets([["company_id", "id"], ["company_id"]], "company_id", "id").agg(
        F.sum("conversations").alias("conversations"), F.sum(F.col("i") + F.col("o")).alias("tokens"), F.sum("i").alias("i"), F.sum("o").alias("o")
    )
    usd = F.col("i") / 1000 * RATES[0][1] + F.col("o") / 1000 * RATES[0][2]
    mean = F.when(F.col("conversations") > 0, F.col("tokens") / F.col("conversations")).otherwise(0.0)
    return sums.select("company_id", "id", "conversations", "tokens", F.round(usd, 6).alias("usd"), F.round(usd * YEN_PER_USD, 6).alias("yen"), F.round(mean, 6).alias("mean_tokens"))


def what_if_prices(usage: DataFrame) -> DataFrame:
    """Each company's tokens under each plan: dollars or yen turned to yen, and yen per million tokens."""
    tokens = F.col("total_tokens")
    standard = (F.col("input_tokens") / 1000 * RATES[0][1] + F.col("output_tokens") / 1000 * RATES[0][2] + F.col("prompt_references") * REFERENCE_YEN / YEN_PER_USD) * YEN_PER_USD
    plans = F.array(
        F.struct(F.lit("fixed").alias("plan"), F.lit(float(BASE_FEE)).alias("yen")),
        F.struct(F.lit("tiered").alias("plan"), yen_plan(tokens).alias("yen")),
        F.struct(F.lit("two_tier").alias("plan"), F.round(two_tier_cost(tokens) * YEN_PER_USD, 6).alias("yen")),
        F.struct(F.lit("standard").alias("plan"), F.round(standard, 6).alias("yen")),
    )
    rows = usage.select("company_id", "total_tokens", F.explode(plans).alias("p")).select("company_id", "total_tokens", "p.plan", "p.yen")
    return rows.withColumn("yen_per_million", F.round(F.col("yen") * 1e6 / F.greatest("total_tokens", F.lit(1)), 4))


def search_basics(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("execution_time_ms"), 6).alias("mean_ms"), F.round(F.avg("result_count"), 6).alias("mean_results"), F.countDistinct("user_id").alias("users")
    )


def search_by_type(log: DataFrame) -> DataFrame:
    """Searches by each of their types."""
    rows = log.select(F.explode("search_types").alias("search_type"), "execution_time_ms", "result_count")
    return rows.groupBy("search_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("execution_time_ms"), 6).alias("mean_ms"), F.round(F.avg("result_count"), 6).alias("mean_results"))


def search_latency(log: DataFrame) -> DataFrame:
    """Exact quantiles; use percentile_approx on tables of many billions of rows."""
    cont = lambda q: F.round(F.percentile("execution_time_ms", q), 6)
    return log.agg(
        F.min("execution_time_ms").alias("least_ms"),
        F.max("execution_time_ms").alias("most_ms"),
        cont(0.5).alias("median_ms"),
        cont(0.95).alias("p95_ms"),
        F.min("result_count").alias("least_results"),
        F.max("result_count").alias("most_results"),
    )


def popular_queries(log: DataFrame, n: int = 10) -> DataFrame:
    rows = log.where("query_text IS NOT NULL AND trim(query_text) <> ''")
    return rows.groupBy("query_text").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("result_count"), 6).alias("mean_results")).orderBy(F.desc("n"), "query_text").limit(n)


def cache_stats(log: DataFrame, as_of, keep_days: int = 1) -> DataFrame:
    """Live cache entries, companies, types, oldest and newest, where each search is kept for some days."""
    live = log.where(F.col("created_at") + F.expr(f"INTERVAL {keep_days} DAYS") > F.lit(as_of))
    return live.agg(
        F.count(F.lit(1)).alias("entries"),
        F.countDistinct("company_id").alias("companies"),
        F.countDistinct(F.col("search_types")[0]).alias("types"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


def cited_sources(chat: DataFrame) -> DataFrame:
    """Sources named in answers, page marks removed, by count."""
    each = chat.select(F.explode(F.split("sources", ",")).alias("s"))
    name = F.trim(F.regexp_replace("s", r"\s*\(P\.[^)]*\)", ""))
    return each.select(name.alias("source")).where("source <> ''").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def hourly_counts(chat: DataFrame, top: int | None = None) -> DataFrame:
    out = chat.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "hour").limit(top) if top else out


def conversation_quality(chat: DataFrame) -> DataFrame:
    """Mean lengths, share of exact repeats, share of failed and of answered questions."""
    failed = F.lower("bot_response").rlike("sorry|not known|error")
    return chat.agg(
        F.round(F.avg(F.length("user_message")), 6).alias("mean_question"),
        F.round(F.avg(F.length("bot_response")), 6).alias("mean_answer"),
        F.round(1 - F.countDistinct(F.lower("user_message")) / F.count(F.lit(1)), 6).alias("repeat_rate"),
        F.round(count_if(failed) / F.count(F.lit(1)), 6).alias("failure_rate"),
        F.round(count_if(~failed) / F.count(F.lit(1)), 6).alias("resolution_rate"),
    )


def requests_now(logs: DataFrame, as_of) -> DataFrame:
    """Requests and tokens of the day and of the month of `as_of`."""
    today = F.to_date("timestamp") == F.to_date(F.lit(as_of))
    month = F.date_trunc("month", "timestamp") == F.date_trunc("month", F.lit(as_of))
    return logs.agg(
        count_if(today).alias("requests_today"),
        F.sum(F.when(today, F.col("tokens_used")).otherwise(0)).alias("tokens_today"),
        count_if(month).alias("requests_month"),
        F.sum(F.when(month, F.col("tokens_used")).otherwise(0)).alias("tokens_month"),
    )


def template_usage(usage: DataFrame) -> DataFrame:
    """Uses, share of successes and last use of each template."""
    return usage.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("uses"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"), F.max("used_at").alias("last_used")
    )


def majority_status(users: DataFrame, limits: DataFrame) -> DataFrame:
    """Whether most of a company's users with a quota are unlimited; ties are."""
    rows = users.select(F.col("id").alias("user_id"), "company_id").join(limits.select("user_id", "is_unlimited"), "user_id").where("company_id IS NOT NULL")
    per = rows.groupBy("company_id").agg(count_if(F.col("is_unlimited")).alias("unlimited"), count_if(~F.col("is_unlimited")).alias("limited"))
    return per.withColumn("majority_unlimited", F.col("unlimited") >= F.col("limited"))


def company_groups(users: DataFrame) -> DataFrame:
    """Users by company id or else e-mail domain: count, and the primary account by role."""
    key = F.coalesce("company_id", F.split_part("email", F.lit("@"), F.lit(2)))
    rank = F.when(F.col("role") == "admin_user", 0).when(F.col("role") == "user", 1).otherwise(2)
    return users.groupBy(key.alias("company")).agg(F.count(F.lit(1)).alias("users"), F.min_by("id", F.struct(rank, F.col("id"))).alias("primary_id"))


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.join(notifications.where("is_read").select("id"), "id", "left_anti").select("id", "title")


def knowledge_summary(docs: DataFrame, chat: DataFrame) -> DataFrame:
    """Sources, active sources, pages and references by type."""
    used = chat.where("source_document IS NOT NULL").groupBy(F.col("source_document").alias("name")).agg(F.count(F.lit(1)).alias("refs"))
    return docs.join(used, "name", "left").groupBy("type").agg(
        F.count(F.lit(1)).alias("sources"), count_if(F.col("active")).alias("active_sources"), F.sum("page_count").alias("pages"), F.coalesce(F.sum("refs"), F.lit(0)).alias("refs")
    )


def rate_limited(chat: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """Requests of a user in the hour up to each request, and whether it was within the limit."""
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    order = Window.partitionBy("employee_id").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    rows = chat.select("id", "employee_id", at.alias("at")).withColumn("requests", F.count(F.lit(1)).over(order))
    return rows.select("id", "employee_id", "requests", (F.col("requests") <= limit).alias("allowed"))


def quota_counters(chat: DataFrame, limits: DataFrame) -> DataFrame:
    """Running count of each user's questions, and the one that reaches the limit."""
    order = Window.partitionBy("employee_id").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = chat.withColumn("used", F.count(F.lit(1)).over(order)).select("id", "employee_id", "used")
    quota = limits.select(F.col("user_id").alias("employee_id"), "questions_limit")
    return rows.join(quota, "employee_id", "left").withColumn("reached", F.coalesce(F.col("used") == F.col("questions_limit"), F.lit(False)))


def usage_alerts(chat: DataFrame, plan_tokens: int, warning: int = 80, critical: int = 95) -> DataFrame:
    """Chats at which a company's running tokens first cross a level of its plan."""
    order = Window.partitionBy("company_id").orderBy("timestamp", "id")
    total = F.sum("total_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = chat.where("company_id IS NOT NULL").withColumn("total", total)
    rows = rows.withColumn("level", warning_level(F.col("total") * 100.0 / plan_tokens, F.lit(warning), F.lit(critical)))
    before = F.coalesce(F.lag("level").over(order), F.lit("safe"))
    return rows.withColumn("before", before).where("level <> before").select("company_id", "id", "level", "total")
