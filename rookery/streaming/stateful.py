"""Streams with state of their own: alerts, an expiring cache, and vectors for what is still without.

The processors keep one value a key in the RocksDB state store. Event-time timers end the state of keys that
have nothing more to say, so that state follows the keys that are live and not all that ever were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.corpus import chunk_documents
from ..operators.extras import hashed_vectors
from .jobs import run_all

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
DAY_MS = 86_400_000
#: Buckets that share the keys of an expiring cache.
BUCKETS = 512


@contextmanager
def rocks_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which timers need, in no more stores than there are cores.

    A store is opened, asked by a Python process of its own and written again in each trigger, whatever it holds.
    """
    few = min(spark.sparkContext.defaultParallelism, int(spark.conf.get(PARTITIONS)))
    before = {name: spark.conf.get(name, None) for name in (STORE, PARTITIONS)}
    for name, value in ((STORE, ROCKS), (PARTITIONS, few)):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def rows_in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one trigger, which come in several batches, by time and id."""
    return pd.concat(list(batches)).sort_values(["at", "id"])


class UsageAlerts(StatefulProcessor):
    """Running tokens of a company; a row for each change of level. A company idle for `idle_ms` is forgotten."""

    def __init__(self, plan_tokens: int, warning: int, critical: int, idle_ms: int) -> None:
        self.marks = np.array([warning, critical]) * plan_tokens / 100.0
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "total bigint, level int, last bigint")

    def _due(self, at: int) -> int:
        return at // 1000 + self.idle_ms + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        some = rows_in_order(rows)
        at, tokens = some["at"].to_numpy(np.int64), some["tokens"].to_numpy(np.int64)
        total, level, last = self.held.get() if self.held.exists() else (0, 0, int(at[0]))
        # after an idle time the sum starts again, whether or not the timer was first
        fresh = at - np.append(last, at[:-1]) > self.idle_ms * 1000
        sums = np.cumsum(tokens) + total
        base = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), -1))
        totals = np.where(base >= 0, sums - (sums - tokens)[np.maximum(base, 0)], sums)
        levels = np.searchsorted(self.marks, totals, "right")
        changed = levels != np.where(fresh, 0, np.append(level, levels[:-1]))
        if self.held.exists():
            self.handle.deleteTimer(self._due(last))
        self.held.update((int(totals[-1]), int(levels[-1]), int(at[-1])))
        self.handle.registerTimer(self._due(int(at[-1])))
        if changed.any():
            names = np.array(["safe", "warning", "critical"], object)
            yield pd.DataFrame({"company_id": key[0], "id": some["id"].to_numpy()[changed], "level": names[levels[changed]], "total": totals[changed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield from ()


def alert_stream(stream: DataFrame, plan_tokens: int, warning: int = 80, critical: int = 95, idle_days: int = 366) -> DataFrame:
    """company_id, id, level, total: the chats at which a company's running tokens change their level.

    Equals `usage_alerts` as long as no company is idle for longer than `idle_days`; one that was starts again
    from nothing. Files have to come in event-time order. Chats without a company alert nobody.
    """
    rows = stream.where("company_id IS NOT NULL").withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", "0 seconds")
    rows = rows.select("company_id", "id", "timestamp", F.coalesce("total_tokens", F.lit(0)).cast("long").alias("tokens"), F.unix_micros("timestamp").alias("at"))
    out = "company_id string, id string, level string, total long"
    return rows.groupBy("company_id").transformWithStateInPandas(UsageAlerts(plan_tokens, warning, critical, idle_days * DAY_MS), out, "update", "eventTime")


class ExpiringCache(StatefulProcessor):
    """The latest entries of a bucket of keys; a row when one has not been renewed in time, which also ends its state.

    A bucket's rows of a trigger are one call, and its live entries one value with one timer for the first that is
    due, so that the calls to the state store grow with the buckets and not with the keys.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "keys array<string>, ids array<string>, at array<bigint>, due bigint")

    def _hold(self, entries: pd.DataFrame, old: int | None) -> None:
        """Keep these entries and set the timer for the first that is due; `old` is the time of the timer before."""
        at = entries["at"].to_numpy(np.int64)
        due = int(at.min()) // 1000 + self.keep_ms + 1 if len(at) else None
        if due != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            self.entries.clear()
        else:
            self.entries.update((entries["cache_key"].tolist(), [str(x) for x in entries["id"]], at.tolist(), due))

    def _held(self) -> tuple[pd.DataFrame, int | None]:
        keys, ids, at, due = self.entries.get() if self.entries.exists() else ([], [], [], None)
        return pd.DataFrame({"cache_key": np.array(keys, object), "id": np.array(ids, object), "at": np.array(at, np.int64)}), due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, due = self._held()
        # a key's rows one after another, what is held of it in front
        some = pd.concat([held, rows_in_order(rows)[["cache_key", "id", "at"]]], ignore_index=True)
        numbers = pd.factorize(some["cache_key"])[0]
        order = np.argsort(numbers, kind="stable")
        some, numbers = some.iloc[order], numbers[order]
        last, at = np.append(numbers[1:] != numbers[:-1], True), some["at"].to_numpy(np.int64)
        late = ~last & np.append(at[1:] - at[:-1] > self.keep_ms * 1000, False)
        self._hold(some[last], due)
        if late.any():
            yield some.loc[late, ["cache_key", "id"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, _ = self._held()
        # timers up to the watermark have expired
        over = held["at"].to_numpy(np.int64) // 1000 + self.keep_ms + 1 <= timerValues.getCurrentWatermarkInMs()
        self._hold(held[~over], None)
        if over.any():
            yield held.loc[over, ["cache_key", "id"]]


def expired_stream(stream: DataFrame, keep_hours: int, buckets: int = BUCKETS) -> DataFrame:
    """cache_key, id: the entries (cache_key, id, timestamp) that no entry of their key has renewed within `keep_hours`.

    Entries that are still within their time at the end of the stream are not among them, and are its state.
    Keys share the state of one of `buckets`; a task holds a bucket's rows of one trigger.
    """
    rows = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", "0 seconds")
    rows = rows.select(F.pmod(F.xxhash64("cache_key"), F.lit(buckets)).alias("bucket"), "cache_key", "id", "timestamp", F.unix_micros("timestamp").alias("at"))
    return rows.groupBy("bucket").transformWithStateInPandas(ExpiringCache(keep_hours * 3_600_000), "cache_key string, id string", "update", "eventTime")


def run_state(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Work off a stream in update mode; each micro batch has its own folder, which a replay overwrites."""
    spark = stream.sparkSession

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    put(spark.createDataFrame([], stream.schema), -1)  # so that a stream without input has a result
    with rocks_state(spark):
        run_all(stream.writeStream.outputMode("update").foreachBatch(put), checkpoint)
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


Embed = Callable[[DataFrame], DataFrame]


class EmbeddingTable:
    """Chunks with vectors, a folder a micro batch: a replayed batch overwrites its own, a document that comes again replaces its chunks."""

    SCHEMA = "doc_id long, chunk_index int, content string, embedding array<float>, batch long"

    def __init__(self, spark: SparkSession, path: str, embed: Embed = hashed_vectors) -> None:
        self.spark, self.path, self.embed = spark, path, embed
        self.stats: dict[int, dict] = {}

    def put(self, documents: DataFrame, batch_id: int) -> None:
        """Cut a batch of documents (doc_id, text) and store its chunks with vectors; those that get none stay pending."""
        chunks = chunk_documents(documents.select("doc_id", "text")).withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index"))
        rows = chunks.join(self.embed(chunks.select("chunk_id", "content")), "chunk_id", "left")
        seen = Observation(f"embedded-{batch_id}")
        rows = rows.observe(seen, F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded"))
        rows.select("doc_id", "chunk_index", "content", "embedding").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        self.stats[batch_id] = seen.get

    def read(self) -> DataFrame:
        """doc_id, chunk_index, content, embedding: of each document the chunks of its last batch."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["doc_id", "batch"], "left_semi").drop("batch")

    def pending(self) -> DataFrame:
        return self.read().where("embedding IS NULL").drop("embedding")

    def retry(self, batch_id: int) -> None:
        """Try the pending chunks once more, under a batch number of its own; their documents' other chunks go along."""
        rows = self.read()
        open_docs = self.pending().select("doc_id").distinct()
        keyed = rows.join(open_docs, "doc_id", "left_semi").withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index"))
        made = self.embed(keyed.where("embedding IS NULL").select("chunk_id", "content")).withColumnRenamed("embedding", "made")
        out = keyed.join(made, "chunk_id", "left").select("doc_id", "chunk_index", "content", F.coalesce("embedding", "made").alias("embedding"))
        out.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def embedding_stream(stream: DataFrame, path: str, checkpoint: str, embed: Embed = hashed_vectors) -> EmbeddingTable:
    """Documents (doc_id, text) that arrive are cut and get their vectors, batch by batch."""
    table = EmbeddingTable(stream.sparkSession, path, embed)
    table.put(stream.sparkSession.createDataFrame([], "doc_id long, text string"), -1)
    run_all(stream.writeStream.outputMode("append").foreachBatch(table.put), checkpoint)
    return table
