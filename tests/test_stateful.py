"""Streams with state against their batch forms, over many small triggers."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rookery.operators.corpus import chunk_documents
from rookery.operators.usage import usage_alerts
from rookery.plans.views import Domain
from rookery.streaming import jobs, stateful

START = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


def stream_of(spark, df, path, files=1, per_file=50):
    jobs.write_by_day(df, path, per_file)
    return jobs.read_stream(spark, path, spark.read.parquet(path).schema, files)


def test_alerts_equal_batch(spark, tmp_path):
    chat = Domain(spark, "/root/testdata/sf0.001").chat_history
    found = stateful.run_state(stateful.alert_stream(stream_of(spark, chat, f"{tmp_path}/in", 3), 50_000), f"{tmp_path}/out", f"{tmp_path}/check")
    want = rows(usage_alerts(chat, 50_000).withColumn("total", F.col("total").cast("long")))
    assert want and rows(found) == want
    assert spark.conf.get(stateful.STORE, None) != stateful.ROCKS


def test_an_idle_company_is_forgotten(spark, tmp_path):
    days = [("a", 0, 90), ("b", 0, 10), ("b", 1, 10), ("b", 2, 10), ("b", 3, 10), ("a", 4, 90), ("b", 4, 10), ("a", 5, 90)]
    chat = spark.createDataFrame([(f"{c}{d}", c, START + timedelta(days=d), n) for c, d, n in days] + [("x", None, START, 999)], "id string, company_id string, timestamp timestamp, total_tokens long")
    forget = stateful.run_state(stateful.alert_stream(stream_of(spark, chat, f"{tmp_path}/in", 1, 2), 100, idle_days=2), f"{tmp_path}/out", f"{tmp_path}/check")
    # on day 4 company a starts again from nothing: 90 is a change from safe to warning once more
    assert [(r.id, r.level, r.total) for r in forget.orderBy("id").collect()] == [("a0", "warning", 90), ("a4", "warning", 90), ("a5", "critical", 180)]
    keep = stateful.run_state(stateful.alert_stream(stream_of(spark, chat, f"{tmp_path}/in2", 1, 2), 100), f"{tmp_path}/out2", f"{tmp_path}/check2")
    assert [(r.id, r.level) for r in keep.orderBy("id").collect()] == [("a0", "warning"), ("a4", "critical")]


@pytest.mark.parametrize("per_file", [1, 3, 100])
def test_expired_entries(spark, tmp_path, per_file):
    hours = {"renewed": [0, 5, 10, 15, 20], "late": [0, 7, 8], "once": [1], "open": [19], "same": [2, 2, 12]}
    entries = [(k, f"{k}{i}", START + timedelta(hours=h)) for k, hs in hours.items() for i, h in enumerate(hs)]
    df = spark.createDataFrame(entries, "cache_key string, id string, timestamp timestamp")
    out = stateful.run_state(stateful.expired_stream(stream_of(spark, df, f"{tmp_path}/in", 1, per_file), 6), f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted(r.id for r in out.collect()) == ["late0", "late2", "once0", "same1", "same2"]


def test_a_stream_without_rows_has_a_result(spark, tmp_path):
    df = spark.createDataFrame([("k", "i", START)], "cache_key string, id string, timestamp timestamp")
    df.limit(0).write.parquet(f"{tmp_path}/in")
    out = stateful.run_state(stateful.expired_stream(jobs.read_stream(spark, f"{tmp_path}/in", df.schema), 6), f"{tmp_path}/out", f"{tmp_path}/check")
    assert out.columns == ["cache_key", "id"] and out.collect() == []


def test_embedding_stream(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, "?!"), (-2, ""), (-3, None)], docs.schema))
    docs.repartition(6).write.parquet(f"{tmp_path}/in")
    stream = jobs.read_stream(spark, f"{tmp_path}/in", docs.schema, 2)
    table = stateful.embedding_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    want = rows(chunk_documents(docs).select("doc_id", "chunk_index", "content"))
    assert rows(table.read().drop("embedding")) == want
    assert [r.content for r in table.pending().collect()] == ["?!"]
    assert sum(s["chunks"] for s in table.stats.values()) == len(want) == sum(s["embedded"] for s in table.stats.values()) + 1
    before = rows(table.read())
    first = docs.where("doc_id % 2 = 0")
    # a batch that is replayed changes nothing, and neither does a restart of a finished stream
    last = max(table.stats)
    spark.read.parquet(f"{tmp_path}/out/batch={last}").select("doc_id").distinct().join(docs, "doc_id").write.parquet(f"{tmp_path}/again")
    table.put(spark.read.parquet(f"{tmp_path}/again"), last)
    assert rows(table.read()) == before
    again = stateful.embedding_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    assert again.stats.keys() <= {-1} and rows(again.read()) == before
    # a document that comes again replaces its chunks
    table.put(first.withColumn("text", F.lit("new text")), 100)
    renewed = {r.doc_id: r.content for r in table.read().join(first.select("doc_id"), "doc_id", "left_semi").collect()}
    assert set(renewed.values()) == {"new text"} and len(renewed) == first.count()


def test_pending_chunks_are_tried_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "good words"), (2, "bad words")], "doc_id long, text string")
    ready = []

    def embed(chunks):
        some = chunks if ready else chunks.where("content NOT LIKE 'bad%'")
        return some.select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding"))

    table = stateful.EmbeddingTable(spark, f"{tmp_path}/out", embed)
    table.put(docs, 0)
    assert table.stats[0] == {"chunks": 2, "embedded": 1} and [r.doc_id for r in table.pending().collect()] == [2]
    ready.append(True)
    table.retry(1)
    table.retry(2)
    assert table.pending().count() == 0 and table.read().count() == 2


def test_old_snapshots_go(spark, tmp_path):
    chat = Domain(spark, "/root/testdata/sf0.001").chat_history
    table = jobs.RollupTable(spark, f"{tmp_path}/rollup")
    for n in range(4):
        table.merge(chat.where(F.pmod(F.xxhash64("id"), F.lit(4)) == n), n)
    assert table._snapshots() == [2, 3]


def test_keys_of_a_bucket_share_calls_to_the_state_store(spark, tmp_path):
    class Handle:
        def __init__(self):
            self.value, self.calls, self.timers = None, 0, set()

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def registerTimer(self, at):  # noqa: N802
            self.calls += 1
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            self.calls += 1
            self.timers.remove(at)

    handle, cache = Handle(), stateful.ExpiringCache(1_000)
    cache.init(handle)
    keys = [f"k{i}" for i in range(500)]
    for trigger in range(3):
        some = pd.DataFrame({"cache_key": keys, "id": [f"{k}-{trigger}" for k in keys], "at": [trigger * 2_000_000 + i for i in range(500)]})
        out = pd.concat([pd.DataFrame(columns=["cache_key", "id"]), *cache.handleInputRows((0,), iter([some[:200], some[200:]]), None)])
        assert sorted(out["id"]) == sorted(f"{k}-{trigger - 1}" for k in keys if trigger)
    assert handle.calls <= 12 and len(handle.timers) == 1
    rows = [(f"k{i % 40}", f"e{i}", START + timedelta(minutes=37 * i)) for i in range(200)]
    df = spark.createDataFrame(rows, "cache_key string, id string, timestamp timestamp")
    jobs.write_by_day(df, f"{tmp_path}/in", 25)
    want = [f"e{i}" for i, (k, _, t) in enumerate(rows) if (rows[i + 40][2] if i + 40 < 200 else rows[-1][2]) > t + timedelta(hours=6)]
    for buckets in (1, 7):
        stream = jobs.read_stream(spark, f"{tmp_path}/in", df.schema, 1)
        out = stateful.run_state(stateful.expired_stream(stream, 6, buckets), f"{tmp_path}/out{buckets}", f"{tmp_path}/check{buckets}")
        assert sorted(r.id for r in out.collect()) == sorted(want)
