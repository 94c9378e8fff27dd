"""Table maintenance as set-based rewrites: each returns the table's new snapshot, to be written beside the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .usage import account_tree, majority_status, without_quota


def scan(df: DataFrame, columns: list[str], equal: dict | None = None, order: str | None = None, descending: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Projection, equality filters (null values are skipped), one sort key, a page."""
    for name, value in (equal or {}).items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    if order:
        df = df.orderBy(F.desc(order) if descending else F.asc(order))
    if offset:
        df = df.offset(offset)
    return (df.limit(limit) if limit is not None else df).select(*columns)


def update_where(df: DataFrame, condition: Column, patch: dict[str, Column]) -> DataFrame:
    """Columns of `patch` overwritten where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in patch.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose `column` is not in the one column of `keys`; null keys stay."""
    return df.join(keys.toDF(column).distinct(), column, "left_anti").select(*df.columns)


def delete_users(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of some users: a cascade from one id set."""
    return {name: delete_keys(df, column, ids) for name, (df, column) in tables.items()}


def with_missing_quota(users: DataFrame, limits: DataFrame) -> DataFrame:
    """Quota rows, with defaults for the users that have none."""
    new = without_quota(users, limits).select(
        F.col("id").alias("user_id"),
        F.lit(False).alias("is_unlimited"),
        F.lit(0).cast("long").alias("questions_used"),
        F.lit(10).alias("questions_limit"),
        F.lit(0).cast("long").alias("document_uploads_used"),
        F.lit(2).alias("document_uploads_limit"),
    )
    return limits.unionByName(new)


def set_plan(limits: DataFrame, ids: DataFrame, unlimited: bool) -> DataFrame:
    """The plan of some users changed: unlimited, or the default limits with use clamped to them."""
    marked = limits.join(ids.toDF("user_id").distinct().withColumn("_hit", F.lit(True)), "user_id", "left")
    limit = F.lit(999_999 if unlimited else 10)
    patch = {"is_unlimited": F.lit(unlimited), "questions_limit": limit, "questions_used": F.least("questions_used", limit)}
    return update_where(marked, F.col("_hit"), patch).select(*limits.columns)


def propagate_down(users: DataFrame, limits: DataFrame, root: str, unlimited: bool) -> DataFrame:
    """The plan of an account given to all accounts below it."""
    return set_plan(limits, account_tree(users, root).select("id"), unlimited)


def propagate_company(users: DataFrame, limits: DataFrame, user_id: str, unlimited: bool) -> DataFrame:
    """The plan of a user given to everyone of the same company."""
    company = users.where(F.col("id") == user_id).select("company_id")
    return set_plan(limits, users.join(company, "company_id", "left_semi").select("id"), unlimited)


def unify_companies(users: DataFrame, limits: DataFrame) -> DataFrame:
    """Every user's unlimited flag set to the majority of their company."""
    major = users.join(majority_status(users, limits), "company_id").select(F.col("id").alias("user_id"), "majority_unlimited")
    rows = limits.join(major, "user_id", "left")
    return rows.withColumn("is_unlimited", F.coalesce("majority_unlimited", "is_unlimited")).select(*limits.columns)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`changes` over `table` by key; columns that `changes` leaves null keep their value."""
    both = table.alias("t").join(changes.alias("c"), key, "full_outer")
    other = [c for c in table.columns if c != key]
    return both.select(key, *(F.coalesce(F.col(f"c.{c}"), F.col(f"t.{c}")).alias(c) if c in changes.columns else F.col(f"t.{c}") for c in other))


def merge_rollup(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of `delta` added to those of `state`; new keys are added."""
    sums = [c for c in state.columns if c not in keys]
    return state.unionByName(delta.select(*state.columns)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def count_up(table: DataFrame, key: str, counter: str, events: DataFrame) -> DataFrame:
    """`counter` increased by the number of events of each key."""
    added = events.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return table.join(added, key, "left").withColumn(counter, F.col(counter) + F.coalesce("_n", F.lit(0))).select(*table.columns)


def replace_children(children: DataFrame, parent: str, new: DataFrame) -> DataFrame:
    """All children of the parents in `new` replaced by its rows."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").select(*children.columns).unionByName(new.select(*children.columns))


def symmetric_difference(table: DataFrame, toggles: DataFrame) -> DataFrame:
    """A batch of toggles: rows of both sides go, rows of one side stay."""
    keys = table.columns
    counts = table.withColumn("_n", F.lit(1)).unionByName(toggles.distinct().withColumn("_n", F.lit(1))).groupBy(*keys).agg(F.sum("_n").alias("_n"))
    return counts.where("_n = 1").select(*keys)


def owned_soft_delete(table: DataFrame, owner: str, owners: DataFrame, active: str = "active") -> DataFrame:
    """Rows of some owners made inactive; those of others stay as they are."""
    hit = owners.toDF(owner).distinct().withColumn("_own", F.lit(True))
    rows = table.join(hit, owner, "left")
    return update_where(rows, F.col("_own"), {active: F.lit(False)}).select(*table.columns)
