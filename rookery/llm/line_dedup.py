"""Line deduplication over levelled sorted runs of line hashes.

Every batch of documents becomes a run: one row a line key (128 bits of SHA-256) with the number of its
documents and the largest doc_id holding it, sorted by hash. A new batch merge-joins the runs that
exist (what it misses there is new) and adds its own run to level 0; when a level holds `fan_out`
runs they are merged into one run of the next level. Frequent keys then lose their lines in every
document but the last one.

Scale: runs hold one small row a distinct key; counting a key that a third of all documents hold is
a partial aggregate on the map side. Which lines a document loses is found by joining hashes, never
lines (AQE splits a hot hash), and gathered per document, so a group is no larger than the document.
Each text is shuffled once, to meet its own list; a document that loses lines looks each of them up in
a set, so that the work is linear in its lines, and all others pass unread.

Defined results: null or empty text is one empty line; a key is the line stripped of ASCII white
space with A-Z lower-cased and counts once a document however often it occurs; doc_id is taken as
unique, and rows that repeat it count as documents of their own of which all keep their lines when
theirs is the largest doc_id; a null doc_id counts and never is the largest, so that its document
loses the line if any document with an id holds it (lines that only null ids hold all stay); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, ascii_strip, delete_path, scratch_path

#: Bytes of SHA-256 that stand for a line.
HASH_BYTES = 16


def line_keys(text: Column) -> Column:
    return F.transform(F.split(ascii_lower(text), "\n", -1), ascii_strip)


def line_hash(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key, 256), 1, 2 * HASH_BYTES))


def hash_of(line: bytes) -> bytes:
    """`line_hash` of the key of a line in UTF-8."""
    return hashlib.sha256(line.strip(ASCII_SPACE.encode()).lower()).digest()[:HASH_BYTES]


class LineRuns:
    """Levelled sorted runs in the shared folder."""

    def __init__(self, spark, fan_out: int = 2) -> None:
        self.spark, self.fan_out = spark, fan_out
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        path = scratch_path(self.spark, "line-run")
        run.repartition("h").sortWithinPartitions("h").write.parquet(path)
        return path

    def runs(self) -> list[DataFrame]:
        return [self.spark.read.parquet(p) for level in self.levels for p in level]

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for more in runs[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("born").alias("born"))

    def add(self, lines: DataFrame) -> None:
        """`lines`: doc_id, h, a row for each key of each document of the batch."""
        run = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        known = self.runs()
        if known:
            seen = known[0].select("h")
            for more in known[1:]:
                seen = seen.unionByName(more.select("h"))
            # the merge anti join: `born` marks keys that no earlier run holds
            new = run.join(seen, "h", "left_anti").withColumn("born", F.lit(1))
            old = run.join(seen, "h", "left_semi").withColumn("born", F.lit(0))
            run = new.unionByName(old)
        else:
            run = run.withColumn("born", F.lit(1))
        self._put(self._write(run), 0)

    def _put(self, path: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fan_out:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self.merged([self.spark.read.parquet(p) for p in old]))
            for p in old:
                delete_path(self.spark, p)
            self._put(merged, level + 1)

    def counts(self) -> DataFrame:
        """h, n, last over all runs."""
        runs = self.runs()
        return runs[0] if len(runs) == 1 else self.merged(runs)


def other_id(doc_id: Column, text: Column) -> Column:
    """What tells documents without a doc_id apart: a hash of their text; 0 for the others."""
    return F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def hashed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, other, h: one row for each key of a document that is long enough."""
    keys = F.filter(F.array_distinct(line_keys(F.coalesce("text", F.lit("")))), lambda k: F.char_length(k) >= least_chars)
    other = other_id(F.col("doc_id"), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", other.alias("other"), F.explode(keys).alias("key")).select("doc_id", "other", line_hash(F.col("key")).alias("h"))


def _without_lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, lost = b.column("text").cast(pa.binary()), b.column("lost")
        n_lines = pc.add(pc.cast(pc.count_substring(texts, b"\n"), pa.int64()), 1)
        n_dropped = [0] * b.num_rows
        kept = texts
        if at := [i for i, some in enumerate(lost.is_valid().to_pylist()) if some]:
            new = texts.to_pylist()
            for i in at:
                gone, lines = set(lost[i].as_py()), new[i].split(b"\n")
                left = [line for line in lines if hash_of(line) not in gone]
                new[i], n_dropped[i] = b"\n".join(left), len(lines) - len(left)
            kept = pa.array(new, pa.binary())
        columns = [b.column("doc_id"), kept.cast(pa.string()), n_lines, pa.array(n_dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept_text", "n_lines", "n_dropped"])


def drop_frequent_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 2) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    path = scratch_path(spark, "lines")
    hashed_lines(docs, least_chars).write.parquet(path)
    lines = spark.read.parquet(path)
    store = LineRuns(spark)
    for i in range(batches):
        store.add(lines.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(batches)) == i))
    frequent = store.counts().where(F.col("n") >= least_docs).select("h", "last")
    losing = lines.join(frequent, "h").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    key = F.coalesce("doc_id", F.lit(0)).alias("id"), "other"
    # rows that repeat a document name its lines more than once
    lost = losing.select(*key, "h").groupBy("id", "other").agg(F.collect_set("h").alias("lost"))
    both = docs.select("*", other_id(F.col("doc_id"), F.col("text")).alias("other")).select("*", key[0])
    both = both.join(lost, ["id", "other"], "left").select("doc_id", "text", "lost")
    return both.mapInArrow(_without_lost, "doc_id long, kept_text string, n_lines long, n_dropped long")
