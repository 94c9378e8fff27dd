import pytest

from rookery.operators.usage import monthly_rollup, quota_counters, rate_limited
from rookery.plans.views import Domain
from rookery.streaming import jobs


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream")) + "/chat"
    chat = Domain(spark, "/root/testdata/sf0.001").chat_history
    jobs.write_by_day(chat, path)
    return spark.read.parquet(path), path


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


def collected(spark, stream, name, tmp_path):
    jobs.run_all(stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").outputMode("append"), f"{tmp_path}/{name}-check")
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_rollup_equals_batch(spark, log, tmp_path):
    chat, path = log
    found = jobs.stream_rollup(jobs.read_stream(spark, path, chat.schema), f"{tmp_path}/rollup", f"{tmp_path}/check")
    assert rows(found) == rows(monthly_rollup(chat).select(*found.columns))


def test_merge_replay_is_harmless(spark, log, tmp_path):
    chat, _ = log
    table = jobs.RollupTable(spark, f"{tmp_path}/rollup")
    parts = chat.randomSplit([0.5, 0.5], seed=3)
    for n, part in enumerate(parts):
        table.merge(part, n)
        table.merge(part, n)
    assert rows(table.read()) == rows(monthly_rollup(chat).select(*table.read().columns))


def test_request_limit_equals_window(spark, log, tmp_path):
    chat, path = log
    found = collected(spark, jobs.limit_requests(jobs.read_stream(spark, path, chat.schema, 100), 2), "limit", tmp_path)
    assert rows(found) == rows(rate_limited(chat, 2).select(*found.columns))


def test_quota_equals_window(spark, log, tmp_path):
    chat, path = log
    found = collected(spark, jobs.count_quota(jobs.read_stream(spark, path, chat.schema, 100)), "quota", tmp_path)
    limits = Domain(spark, "/root/testdata/sf0.001").usage_limits
    assert rows(found) == rows(quota_counters(chat, limits).select(*found.columns))


def test_enrich_and_daily(spark, log, tmp_path):
    chat, path = log
    companies = Domain(spark, "/root/testdata/sf0.001").companies
    found = collected(spark, jobs.enrich(jobs.read_stream(spark, path, chat.schema), companies), "rich", tmp_path)
    assert rows(found) == rows(jobs.enrich(chat, companies))
    days = collected(spark, jobs.daily_activity_stream(jobs.read_stream(spark, path, chat.schema, 100)), "days", tmp_path)
    counts = {str(r["day"]): r["count"] for r in chat.groupBy(chat["timestamp"].cast("date").alias("day")).count().collect()}
    got = {r.day: r.messages for r in days.collect()}
    assert len(got) >= len(counts) - 2 and all(counts[d] == n for d, n in got.items())
    assert jobs.late_rows(chat, chat.agg({"timestamp": "max"}).first()[0], 60) == 0
