"""Chat and usage analytics. Every operator takes DataFrames and returns one; "now" is an argument.

All are groupings with map-side partial aggregation; the only windows over a whole table are over
aggregated rows (days, categories), never over the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Display labels of the chat categories.
CATEGORY_LABELS = {
    "general": "General",
    "technical": "Technical",
    "procedure": "Procedure",
    "finance": "Finance",
    "hr": "Personnel",
    "policy": "Policy",
    "meeting": "Meetings",
    "other": "Other",
}



def whole():
    """One window over all rows; only for rows that are already aggregated."""
    return Window.partitionBy(F.lit(0))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def sentiment_score(c: Column) -> Column:
    return F.when(c == "positive", 3).when(c == "neutral", 2).when(c == "negative", 1)


def latest(df: DataFrame, column: str):
    """The largest value of a column: the default for "now"."""
    return df.agg(F.max(column)).first()[0]


def category_label(c: Column) -> Column:
    """Display label of a raw category: mapped, else marked raw; blank or "None" is other."""
    raw = F.when(c.isNull() | (F.trim(c) == "") | (c == "None"), "other").otherwise(F.trim(c))
    labels = F.create_map(*(F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair))
    return F.coalesce(F.element_at(labels, raw), F.concat(F.lit("* "), raw))


def company_periods(users: DataFrame, companies: DataFrame, as_of, unknown: str = "unknown") -> DataFrame:
    """Per company name: users, first sign-up, days and months (of 30.44 days) since."""
    named = users.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company")), "company_id", "left")
    grouped = named.groupBy(F.coalesce("company", F.lit(unknown)).alias("company")).agg(F.count(F.lit(1)).alias("user_count"), F.min("created_at").alias("start_at"))
    days = F.datediff(F.lit(as_of), "start_at")
    return grouped.select("company", "user_count", "start_at", days.alias("usage_days"), F.round(days / 30.44, 1).alias("usage_months"))


def user_periods(users: DataFrame, companies: DataFrame, as_of, unknown: str = "unknown") -> DataFrame:
    """Per user: days and months since sign-up, with the company's name."""
    named = users.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company")), "company_id", "left")
    days = F.datediff(F.lit(as_of), "created_at")
    return named.select("id", F.coalesce("company", F.lit(unknown)).alias("company"), days.alias("usage_days"), F.round(days / 30.44, 1).alias("usage_months"))


def active_users(chat: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Chats of the last `days` by (company, user), by company, and in all (both null)."""
    recent = chat.where(F.col("timestamp") >= F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS"))
    per_user = recent.groupBy("company_id", "employee_id").agg(F.count(F.lit(1)).alias("chats"))
    return per_user.groupingSets([["company_id", "employee_id"], ["company_id"], []], "company_id", "employee_id").agg(
        F.grouping_id("company_id", "employee_id").cast("int").alias("level"), F.sum("chats").alias("chats"), F.count(F.lit(1)).alias("users")
    )


def plan_continuity(plans: DataFrame) -> DataFrame:
    """Per user: changes, first change, current plan, and whether a demo stayed in production or came back."""
    first = F.min_by(F.struct("from_plan", "to_plan"), F.struct("changed_at", "id"))
    last = F.max_by("to_plan", F.struct("changed_at", "id"))
    per = plans.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("changes"),
        first.alias("first"),
        last.alias("current_plan"),
        F.avg(F.datediff("changed_at", "prev_at")).alias("mean_days"),
    )
    kind = F.when(F.col("changes") == 1, "once").otherwise("multiple")
    stayed = (F.col("first.from_plan") == "demo") & (F.col("first.to_plan") == "production") & (F.col("current_plan") == "production")
    returned = (F.col("first.from_plan") == "production") & (F.col("first.to_plan") == "demo") & (F.col("current_plan") == "demo")
    return per.select("user_id", "changes", kind.alias("kind"), "current_plan", stayed.alias("stayed"), returned.alias("returned"), F.round("mean_days", 6).alias("mean_days"))


def plan_continuity_totals(plans: DataFrame, users: DataFrame) -> DataFrame:
    """One row: users that never, once or often changed, and how many stayed or returned."""
    per = plan_continuity(plans)
    joined = users.select(F.col("id").alias("user_id")).join(per, "user_id", "left")
    return joined.agg(
        count_if(F.col("kind").isNull()).alias("never"),
        count_if(F.col("kind") == "once").alias("once"),
        count_if(F.col("kind") == "multiple").alias("multiple"),
        count_if(F.coalesce("stayed", F.lit(False))).alias("stayed"),
        count_if(F.coalesce("returned", F.lit(False))).alias("returned"),
    )


def latest_transition(plans: DataFrame) -> DataFrame:
    """Users with two changes or more by the plans of their latest one, with the mean days it took."""
    per = plans.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("from_plan", "to_plan", "prev_at", "changed_at"), F.struct("changed_at", "id")).alias("last"))
    per = per.where("n >= 2").select("last.*")
    days = F.avg(F.datediff("changed_at", "prev_at"))
    return per.groupBy("from_plan", "to_plan").agg(F.count(F.lit(1)).alias("users"), F.round(days, 6).alias("mean_days"))


def plan_transitions(plans: DataFrame) -> DataFrame:
    """Changes by direction: count, mean and total days."""
    days = F.datediff("changed_at", "prev_at")
    return plans.groupBy("from_plan", "to_plan").agg(F.count(F.lit(1)).alias("changes"), F.round(F.avg(days), 1).alias("mean_days"), F.sum(days).alias("total_days"))


def resource_references(chat: DataFrame) -> DataFrame:
    """Per cited document: references, users, days, last use, satisfaction and intensity."""
    cited = chat.where("source_document IS NOT NULL AND trim(source_document) <> ''")
    users = F.countDistinct("user_id")
    return cited.groupBy("source_document").agg(
        F.count(F.lit(1)).alias("refs"),
        users.alias("users"),
        F.countDistinct(F.to_date("timestamp")).alias("days"),
        F.max("timestamp").alias("last_referenced"),
        F.round(F.sum(F.coalesce(sentiment_score(F.col("sentiment")), F.lit(0))) / F.count(F.lit(1)), 6).alias("satisfaction"),
        F.round(F.count(F.lit(1)) / F.greatest(users, F.lit(1)), 6).alias("intensity"),
    )


def category_distribution(chat: DataFrame) -> DataFrame:
    """Per category: count, users, days, sentiments, share, bias against an even share, and ranks from both ends."""
    label = category_label(F.col("category"))
    grouped = chat.groupBy(label.alias("category")).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct(F.to_date("timestamp")).alias("days"),
        count_if(F.col("sentiment") == "positive").alias("positive"),
        count_if(F.col("sentiment") == "neutral").alias("neutral"),
        count_if(F.col("sentiment") == "negative").alias("negative"),
    )
    mean = (3 * F.col("positive") + 2 * F.col("neutral") + F.col("negative")) / F.col("n")
    share = F.col("n") * 100.0 / F.sum("n").over(whole())
    bias = share - 100.0 / F.count(F.lit(1)).over(whole())
    out = grouped.withColumns({"score": F.round(mean, 6), "share": F.round(share, 6), "bias": F.round(bias, 6)})
    return out.withColumns(
        {
            "over": F.col("bias") > 10,
            "under": F.col("bias") < -10,
            "mood": F.when(F.col("score") > 2.3, "positive").when(F.col("score") < 1.7, "negative").otherwise("balanced"),
            "top_rank": F.row_number().over(whole().orderBy(F.desc("n"), "category")),
            "bottom_rank": F.row_number().over(whole().orderBy("n", "category")),
        }
    )


def daily_activity(chat: DataFrame) -> DataFrame:
    """Per day: distinct users and names, messages, share of positive ones."""
    return chat.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.countDistinct("user_id").alias("users"),
        F.count(F.lit(1)).alias("messages"),
        F.countDistinct("employee_name").alias("names"),
        F.round(count_if(F.col("sentiment") == "positive") / F.count(F.lit(1)), 6).alias("positive_ratio"),
    )


def active_day_weeks(daily: DataFrame, size: int = 7) -> DataFrame:
    """Buckets of `size` active days in order: ends, mean users, messages, days."""
    bucket = F.floor((F.row_number().over(whole().orderBy("day")) - 1) / size)
    return daily.withColumn("bucket", bucket.cast("int")).groupBy("bucket").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.round(F.avg("users"), 1).alias("mean_users"), F.sum("messages").alias("messages"), F.count(F.lit(1)).alias("active_days")
    )


def calendar_weeks(chat: DataFrame) -> DataFrame:
    """Per calendar week from Monday: distinct users and messages."""
    week = F.to_date(F.date_trunc("week", "timestamp"))
    return chat.groupBy(week.alias("week")).agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("messages"))


def activity_trend(chat: DataFrame) -> DataFrame:
    """One row: mean users of the last seven active days against the seven before, the peak day, distinct users."""
    daily = daily_activity(chat).withColumn("r", F.row_number().over(whole().orderBy(F.desc("day"))))
    users = chat.agg(F.countDistinct("user_id").alias("n")).first()["n"]
    found = daily.agg(
        F.avg(F.when(F.col("r") <= 7, F.col("users"))).alias("recent"),
        F.avg(F.when((F.col("r") > 7) & (F.col("r") <= 14), F.col("users"))).alias("previous"),
        F.max_by("day", F.struct("users", "day")).alias("peak_day"),
    )
    change = (F.col("recent") - F.col("previous")) * 100.0 / F.col("previous")
    direction = F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    return found.select(
        F.round("recent", 6).alias("recent"), F.round("previous", 6).alias("previous"), F.round(change, 6).alias("percent"), direction.alias("direction"), "peak_day", F.lit(users).alias("users")
    )


def sentiment_breakdown(chat: DataFrame) -> DataFrame:
    """Counts by sentiment alone, with category, and with day, in one pass."""
    rows = chat.select(F.coalesce("sentiment", F.lit("neutral")).alias("sentiment"), F.coalesce("category", F.lit("other")).alias("category"), F.to_date("timestamp").alias("day"))
    return rows.groupingSets([["sentiment"], ["sentiment", "category"], ["sentiment", "day"]], "sentiment", "category", "day").agg(F.count(F.lit(1)).alias("n"))


def overall_sentiment(chat: DataFrame) -> DataFrame:
    """One row: rows, and positive as 1, neutral as a half, over all."""
    value = F.when(F.col("sentiment") == "positive", 1.0).when(F.col("sentiment") == "neutral", 0.5).otherwise(0.0)
    return chat.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 3).alias("score"))


def chat_summary(chat: DataFrame) -> DataFrame:
    """Total, by category, by sentiment and by day as (section, key, n, percent of the section)."""
    rows = chat.select(F.coalesce("category", F.lit("other")).alias("category"), F.coalesce("sentiment", F.lit("neutral")).alias("sentiment"), F.to_date("timestamp").cast("string").alias("day"))
    sets = rows.groupingSets([[], ["category"], ["sentiment"], ["day"]], "category", "sentiment", "day").agg(F.count(F.lit(1)).alias("n"))
    section = F.when(F.col("category").isNotNull(), "category").when(F.col("sentiment").isNotNull(), "sentiment").when(F.col("day").isNotNull(), "day").otherwise("total")
    out = sets.select(section.alias("section"), F.coalesce("category", "sentiment", "day", F.lit("all")).alias("key"), "n")
    return out.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("section")), 6))


def common_questions(chat: DataFrame, n: int = 10) -> DataFrame:
    """The n questions asked most."""
    return chat.groupBy("user_message").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_message").limit(n)


def insight_facts(chat: DataFrame) -> DataFrame:
    """(fact, key, value): three top categories, sentiment percents, the negative flag, two peak days."""
    parts = chat_summary(chat).where("section <> 'total'")
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "key"))
    ranked = parts.withColumn("r", rank)
    kept = ranked.where("(section = 'category' AND r <= 3) OR section = 'sentiment' OR (section = 'day' AND r <= 2)")
    facts = kept.select("section", "key", F.when(F.col("section") == "sentiment", F.col("percent")).otherwise(F.col("n").cast("double")).alias("value"))
    flag = ranked.where("section = 'sentiment'").agg((F.max(F.when(F.col("key") == "negative", F.col("percent"))) > 20).cast("double").alias("value"))
    return facts.unionByName(flag.select(F.lit("flag").alias("section"), F.lit("negative_over_20").alias("key"), F.coalesce("value", F.lit(0.0)).alias("value")))


def employee_usage(chat: DataFrame, last: int = 3) -> DataFrame:
    """Per employee: messages, last activity, counts by category, the last few questions."""
    per_category = chat.groupBy("employee_id", F.coalesce("category", F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("at"))
    counts = F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws("=", "category", "n"))))
    sums = per_category.groupBy("employee_id").agg(F.sum("n").alias("messages"), F.max("at").alias("last_activity"), counts.alias("categories"))
    order = Window.partitionBy("employee_id").orderBy(F.desc("timestamp"), F.desc("id"))
    recent = chat.withColumn("r", F.row_number().over(order)).where(F.col("r") <= last)
    asked = recent.groupBy("employee_id").agg(F.concat_ws(" | ", F.transform(F.sort_array(F.collect_list(F.struct("r", "user_message"))), lambda x: x["user_message"])).alias("last_questions"))
    return sums.join(asked, "employee_id")


def usage_overview(users: DataFrame, chat: DataFrame, docs: DataFrame, limits: DataFrame, companies: DataFrame, as_of) -> DataFrame:
    """(metric, value): users, users active in 7 days, documents, questions, users at their limit, companies."""
    recent = chat.where(F.col("timestamp") >= F.lit(as_of) - F.expr("INTERVAL 7 DAYS"))
    parts = [
        users.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("users")),
        recent.agg(F.countDistinct("employee_id").alias("value")).withColumn("metric", F.lit("active_users")),
        docs.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("documents")),
        chat.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("questions")),
        limits.where("NOT is_unlimited AND questions_used >= questions_limit").agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("limit_reached")),
        companies.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("companies")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("metric", "value")


def repeated_questions(turns: DataFrame, least: float = 0.3, top: int | None = 20) -> DataFrame:
    """A user's message that shares most words with the user's next one: overlap coefficient of word sets of over two words."""
    order = Window.partitionBy("employee_id").orderBy("conv_id", "turn")
    word_set = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    rows = turns.withColumns({"next_id": F.lead("id").over(order), "next_message": F.lead("user_message").over(order)}).where("next_id IS NOT NULL")
    rows = rows.withColumns({"a": word_set(F.col("user_message")), "b": word_set(F.col("next_message"))}).where("size(a) > 2 AND size(b) > 2")
    rows = rows.withColumn("similarity", F.round(F.size(F.array_intersect("a", "b")) / F.least(F.size("a"), F.size("b")), 6)).where(F.col("similarity") > least)
    out = rows.select("employee_id", "id", "next_id", "similarity")
    return out.orderBy(F.desc("similarity"), "id").limit(top) if top else out


def unresolved_questions(chat: DataFrame, top: int | None = 20) -> DataFrame:
    """Answers that were short, met badly or apologetic, of users that asked again; newest first."""
    order = Window.partitionBy("employee_id").orderBy("timestamp", "id")
    asked = chat.withColumn("next_id", F.lead("id").over(order)).where("next_id IS NOT NULL")
    kind = (
        F.when(F.lower("bot_response").contains("sorry"), "apology")
        .when(F.col("sentiment") == "negative", "negative")
        .when(F.length("bot_response") < 50, "short_answer")
    )
    out = asked.withColumn("issue_type", kind).where("issue_type IS NOT NULL").select("id", "employee_id", "issue_type", "timestamp")
    return out.orderBy(F.desc("timestamp"), "id").limit(top) if top else out
