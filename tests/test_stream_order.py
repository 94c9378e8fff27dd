from pyspark.sql import functions as F

from rookery.operators.usage import monthly_rollup, rate_limited
from rookery.streaming import jobs


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


def collected(stream, path):
    jobs.run_all(stream.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), f"{path}/check")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def log_of(spark, n, seconds):
    """n chats over time, dealt over 8 tasks out of order."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("i") * 7919, F.lit(n)) * seconds)
    long = spark.range(n).withColumnRenamed("id", "i").select(F.col("i").cast("string").alias("id"), at.alias("timestamp"), (F.col("i") % 7).alias("u"))
    text = F.col("u").cast("string")
    return long.select("id", "timestamp", text.alias("employee_id"), text.alias("user_id"), text.alias("company_id"), *(F.lit(k).alias(c) for k, c in enumerate(["input_tokens", "output_tokens", "total_tokens"], 1))).repartition(8)


def test_many_files_come_in_event_time_order(spark, tmp_path):
    jobs.write_by_day(log_of(spark, 6000, 1200), f"{tmp_path}/log", 100)
    log = spark.read.parquet(f"{tmp_path}/log")
    assert len(list((tmp_path / "log").glob("part-*.parquet"))) >= 50
    found = jobs.stream_rollup(jobs.read_stream(spark, f"{tmp_path}/log", log.schema, 10), f"{tmp_path}/rollup", f"{tmp_path}/rollup-check")
    assert rows(found) == rows(monthly_rollup(log).select(*found.columns))
    days = collected(jobs.daily_activity_stream(jobs.read_stream(spark, f"{tmp_path}/log", log.schema, 20)), f"{tmp_path}/days")
    counts = {str(r["day"]): r["count"] for r in log.groupBy(F.to_date("timestamp").alias("day")).count().collect()}
    got = {r.day: r.messages for r in days.collect()}
    assert len(got) >= len(counts) - 2 and all(counts[d] == n for d, n in got.items())


def test_hot_user_over_batches_and_triggers(spark, tmp_path):
    log = log_of(spark, 26_000, 3).withColumn("employee_id", F.lit("hot"))
    jobs.write_by_day(log, f"{tmp_path}/log", 500)
    stored = spark.read.parquet(f"{tmp_path}/log")
    stream = lambda: jobs.read_stream(spark, f"{tmp_path}/log", stored.schema, 30)
    found = collected(jobs.limit_requests(stream(), 2), f"{tmp_path}/limit")
    assert rows(found) == rows(rate_limited(stored, 2).select(*found.columns))
    used = {r.id: r.used for r in collected(jobs.count_quota(stream()), f"{tmp_path}/quota").collect()}
    order = [r.id for r in stored.select("id").collect()]
    assert [used[i] for i in sorted(order, key=lambda i: (int(i) * 7919 % 26_000, i))] == list(range(1, 26_001))


def test_long_logs_have_no_more_files(spark, tmp_path):
    jobs.write_by_day(log_of(spark, 6000, 60), f"{tmp_path}/log", 10, 40)
    log = spark.read.parquet(f"{tmp_path}/log")
    assert 20 <= len(list((tmp_path / "log").glob("part-*.parquet"))) <= 40
    found = jobs.stream_rollup(jobs.read_stream(spark, f"{tmp_path}/log", log.schema, 10), f"{tmp_path}/rollup", f"{tmp_path}/check")
    assert rows(found) == rows(monthly_rollup(log).select(*found.columns))
