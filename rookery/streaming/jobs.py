"""Structured Streaming jobs over the chat log. Each has a batch twin that its final state must equal.

Event time is UTC; rows later than the watermark are dropped from windowed state and are counted by
`late_rows`. Rollups are kept as snapshots: each micro batch writes the next one and the last two stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.analytics import category_label
from ..operators.maintain import merge_rollup
from ..operators.usage import monthly_rollup

ROLLUP_KEYS = ["company_id", "user_id", "year_month"]
#: Files that a log is written as at most: each micro batch has a cost of its own, whatever its rows.
FILES = 200


def write_by_day(chat: DataFrame, path: str, rows_per_file: int = 2000, most: int = FILES) -> None:
    """The log as one folder of files in event-time order, for file streams.

    Files have about `rows_per_file` rows, or more where that would make more than `most` files.
    Files hold ranges of time that don't overlap, an instant is in one file only. File streams take files by
    modification time, so that is set in the order of the ranges, whichever task was done first.
    """
    rows = chat.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    files = min(most, max(1, -(-rows.count() // rows_per_file)))
    rows.repartitionByRange(files, "timestamp").sortWithinPartitions("timestamp").write.parquet(path)
    spark = chat.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: sorted((int(f.getPath().getName().split("-")[1]), f.getModificationTime(), f.getPath()) for f in store.listStatus(folder) if f.getPath().getName().startswith("part-"))
    written = names()
    last = max(time for _, time, _ in written)
    for n, (_, _, file) in enumerate(written):
        store.setTimes(file, last - len(written) + n, -1)
    times = [time for _, time, _ in names()]
    if any(x >= y for x, y in zip(times, times[1:], strict=False)):
        raise ValueError(f"{path} is in a store that keeps no modification times: its files can't be read in order")


def read_stream(spark: SparkSession, path: str, schema: StructType, files: int = 2) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_all(writer, checkpoint: str) -> None:
    """Work off what is there, in micro batches, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


class RollupTable:
    """A month rollup as snapshots in numbered folders under one path; the batch number makes replays harmless."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _snapshots(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        names = [s.getPath().getName() for s in store.listStatus(root)]
        done = [n for n in names if n.startswith("v=") and store.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self._snapshots()[-1]}")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Add one micro batch to the rollup of the batches before it."""
        before = [v for v in self._snapshots() if v < batch_id]
        delta = monthly_rollup(batch)
        new = merge_rollup(self.spark.read.parquet(f"{self.path}/v={before[-1]}"), delta, ROLLUP_KEYS) if before else delta
        new.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        # a replay of this batch reads the last one before it
        jvm = self.spark.sparkContext._jvm
        for v in before[:-1]:
            old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}")
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def stream_rollup(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Token sums by company, user and month, merged batch by batch; chats that come again by id count once."""
    table = RollupTable(stream.sparkSession, path)
    once = stream.withWatermark("timestamp", "2 days").dropDuplicatesWithinWatermark(["id"])
    run_all(once.writeStream.outputMode("append").foreachBatch(table.merge), checkpoint)
    return table.read()


def stream_daily_users(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """day, user_id, messages: updates of each day and user written batch by batch, so that open days are there too.

    The watermark ends the state of days that are over; a replayed batch overwrites its own folder.
    """
    spark = stream.sparkSession
    per = stream.withWatermark("timestamp", "2 days").groupBy(F.window("timestamp", "1 day").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("messages"))
    rows = per.select(F.to_date("w.start").alias("day"), "user_id", "messages")

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_all(rows.writeStream.outputMode("update").foreachBatch(put), checkpoint)
    found = spark.read.schema("day date, user_id string, messages long, batch long").parquet(path)
    return found.groupBy("day", "user_id").agg(F.max("messages").alias("messages"))


def activity_windows(daily_users: DataFrame, days: int = 7) -> DataFrame:
    """day, users, messages of each day with messages, and of the `days` that end with it: a user counts once a window."""
    own = daily_users.groupBy("day").agg(F.count("user_id").alias("users"), F.sum("messages").alias("messages"))
    ends = F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("day")
    slid = daily_users.select(ends, "user_id", "messages").groupBy("day", "user_id").agg(F.sum("messages").alias("messages"))
    slid = slid.groupBy("day").agg(F.count("user_id").alias(f"users_{days}d"), F.sum("messages").alias(f"messages_{days}d"))
    return own.join(slid, "day")


def enrich(stream: DataFrame, companies: DataFrame) -> DataFrame:
    """Each chat with its company's name, category label and cost, as a stream-static join."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    cost = F.round(F.col("input_tokens") / 1000 * 0.0003 + F.col("output_tokens") / 1000 * 0.0025, 6)
    rows = stream.join(F.broadcast(names), "company_id", "left") if names.count() <= 10_000 else stream.join(names, "company_id", "left")
    return rows.select("id", F.coalesce("company", F.lit("unknown")).alias("company"), category_label(F.col("category")).alias("category"), cost.alias("cost_usd"))


def daily_activity_stream(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Messages and estimated users by day, final once the watermark has passed."""
    day = F.window("timestamp", "1 day")
    counts = stream.withWatermark("timestamp", delay).groupBy(day.alias("w")).agg(F.count(F.lit(1)).alias("messages"), F.approx_count_distinct("employee_id", 0.01).alias("users"))
    return counts.select(F.col("w.start").cast("date").cast("string").alias("day"), "messages", "users")


def limit_requests(stream: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """Requests of each user in the hour up to each request; state holds the times of the last hour.

    Files have to come in event-time order, an instant in one trigger (`write_by_day`). A task holds a
    user's rows of one trigger.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # a user's rows of a trigger come in several batches, unsorted between them
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        new = rows["at"].to_numpy(np.int64)
        held = np.array(state.get[0] if state.exists else [], np.int64)
        times = np.sort(np.concatenate([held, new]))
        window = seconds * 1_000_000
        # rows of one instant see each other, as in a range window
        counts = np.searchsorted(times, new, "right") - np.searchsorted(times, new - window, "left")
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "employee_id": key[0], "requests": counts, "allowed": counts <= limit})
        state.update((times[times >= times[-1] - window].tolist(),))

    rows = stream.select("id", "employee_id", F.unix_micros("timestamp").alias("at"))
    return rows.groupBy("employee_id").applyInPandasWithState(
        step, "id string, employee_id string, requests long, allowed boolean", "times array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def count_quota(stream: DataFrame) -> DataFrame:
    """Each user's running number of questions, kept in state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "employee_id": key[0], "used": range(used + 1, used + 1 + len(rows))})
        state.update((used + len(rows),))

    rows = stream.select("id", "employee_id", F.unix_micros("timestamp").alias("at"))
    return rows.groupBy("employee_id").applyInPandasWithState(step, "id string, employee_id string, used long", "used bigint", "append", GroupStateTimeout.NoTimeout)


def late_rows(batch: DataFrame, newest, delay_days: int) -> int:
    """How many rows of a micro batch came later than the watermark allows."""
    return batch.where(F.col("timestamp") < F.lit(newest) - F.expr(f"INTERVAL {delay_days} DAYS")).count()
