"""Exact deduplication against immutable snapshots screened by binary fuse filters.

A snapshot is written once and never changed: a table of digests first seen in it, and one static
3-wise binary fuse filter (8-bit fingerprints, about 9 bits a key) for each digest shard. A new
batch is first grouped by digest on its own (so its own duplicates need no filter), then screened
against each snapshot's filters shard by shard; only positives join that snapshot's digest table.
Texts of groups with more than one row are compared byte for byte.

Scale: what is shuffled is one small row a distinct digest; whole texts move only for the byte
check, where the repeated digests' own filters screen them on the map side (up to SCREENED digests,
whose filters have a known size and are broadcast; beyond that all texts are grouped). Filters are
sharded by digest, so the largest object in a task is one shard's filter and its share of the batch. A
hot text is counted by map-side partial aggregation, and its copies are compared before they move.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays
(null doc_ids rank lowest and stay only if all are null); rows that repeat both doc_id and text are
one document and share its decision; an empty table gives an empty result; other columns pass by.
Two different texts with one SHA-256 would raise an error rather than be merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import materialise

SHARD_KEYS = 65536
SCREENED = 1 << 24
FILTER_SCHEMA = "shard int, seed long, segment_length int, segment_count int, bits binary"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slots(h: np.ndarray, segment_length: int, segment_count: int) -> np.ndarray:
    """Three slots a key, in three consecutive segments."""
    segment = ((h >> np.uint64(32)) * np.uint64(segment_count)) >> np.uint64(32)
    base = segment.astype(np.int64) * segment_length
    mask = np.uint64(segment_length - 1)
    first = (h & mask).astype(np.int64)
    second = ((h >> np.uint64(18)) & mask).astype(np.int64)
    third = ((_mix(h, 0x9E37) >> np.uint64(7)) & mask).astype(np.int64)
    return np.stack([base + first, base + segment_length + second, base + 2 * segment_length + third])


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(41))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> dict:
    """Static filter of distinct 64-bit keys; every key answers true, others about 1 in 256."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 1)
    segment_length = 1 << max(2, int(np.log(n) / np.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    for seed in range(1, 200):
        segment_count = max(1, int(np.ceil(n * factor * (1.05 if seed > 20 else 1) / segment_length)) - 2)
        size = (segment_count + 2) * segment_length
        h = _mix(keys, seed)
        slots = _slots(h, segment_length, segment_count)
        count = np.zeros(size, np.int64)
        joined = np.zeros(size, np.uint64)
        ids = np.arange(len(keys), dtype=np.uint64)
        for s in slots:
            np.add.at(count, s, 1)
            np.bitwise_xor.at(joined, s, ids)
        rounds, left = [], len(keys)
        while left:
            lone = np.flatnonzero(count == 1)
            if not len(lone):
                break
            key, at = np.unique(joined[lone], return_index=True)
            key, lone = key.astype(np.int64), lone[at]
            rounds.append((key, lone))
            left -= len(key)
            for s in slots:
                np.subtract.at(count, s[key], 1)
                np.bitwise_xor.at(joined, s[key], key.astype(np.uint64))
        if left:
            continue
        bits, prints = np.zeros(size, np.uint8), _prints(h)
        for key, lone in reversed(rounds):
            bits[lone] = 0
            bits[lone] = prints[key] ^ bits[slots[0][key]] ^ bits[slots[1][key]] ^ bits[slots[2][key]]
        return {"seed": seed, "segment_length": segment_length, "segment_count": segment_count, "bits": bits.tobytes()}
    raise ValueError("no filter could be built")


def maybe_contains(row, keys: np.ndarray) -> np.ndarray:
    h = _mix(keys.astype(np.uint64), int(row["seed"]))
    bits = np.frombuffer(row["bits"], np.uint8)
    s = _slots(h, int(row["segment_length"]), int(row["segment_count"]))
    return bits[s[0]] ^ bits[s[1]] ^ bits[s[2]] == _prints(h)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 40), F.lit(shards)).cast("int")


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """A row of FILTER_SCHEMA for each shard of `keys` (key)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = build_filter(pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame([{"shard": pdf["shard"].iloc[0]} | made])

    keyed = keys.select(_shard(F.col("key"), shards).alias("shard"), "key")
    return materialise(keyed.groupBy("shard").applyInPandas(build, FILTER_SCHEMA), "dedup-filters")


class Snapshots:
    """Immutable snapshots of digests, grown batch by batch."""

    def __init__(self, shard_keys: int = SHARD_KEYS) -> None:
        self.shard_keys = shard_keys
        self.snapshots: list[tuple[DataFrame, DataFrame, int]] = []
        self.found: list[DataFrame] = []

    def ingest(self, batch: DataFrame) -> None:
        """`batch`: doc_id, digest. Adds a snapshot of the digests no earlier snapshot has."""
        groups = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        fresh = materialise(groups.withColumn("key", F.xxhash64("digest")), "dedup-batch")
        for digests, filters, shards in self.snapshots:
            screened = materialise(self._screen(fresh, filters, shards), "dedup-screened")
            seen = digests.select("digest", F.lit(True).alias("seen"))
            # a positive is settled by the exact bucket of its digest
            checked = screened.where("positive").join(seen, "digest", "left")
            checked = materialise(checked.drop("positive"), "dedup-checked")
            self.found.append(checked.where("seen").drop("seen", "key"))
            fresh = screened.where("NOT positive").drop("positive").unionByName(checked.where("seen IS NULL").drop("seen"))
        fresh = materialise(fresh, "dedup-snapshot")
        self.found.append(fresh.drop("key"))
        shards = max(1, -(-fresh.count() // self.shard_keys))
        self.snapshots.append((fresh, build_filters(fresh, shards), shards))

    @staticmethod
    def _screen(fresh: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
        def screen(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            rows = rows.drop(columns="shard")
            keys = rows["key"].to_numpy().view(np.uint64)
            return rows.assign(positive=maybe_contains(known.iloc[0], keys) if len(known) else np.zeros(len(rows), bool))

        sides = fresh.withColumn("shard", _shard(F.col("key"), shards)).groupBy("shard").cogroup(filters.groupBy("shard"))
        return sides.applyInPandas(screen, StructType([*fresh.schema.fields, StructField("positive", BooleanType())]))

    def groups(self) -> DataFrame:
        """digest, keep_id, group_size over all batches so far."""
        rows = self.found[0]
        for more in self.found[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs` (doc_id, text).

    `batches`: the documents arrive as so many batches, dealt by a hash of doc_id; the result is the
    same for any number.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digests = materialise(texts.select("doc_id", F.sha2("text", 256).alias("digest")), "dedup-digests")
    store = Snapshots()
    for i in range(batches):
        store.ingest(digests.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(batches)) == i))
    groups = materialise(store.groups(), "dedup-groups")
    checked = byte_check(texts, groups.where("group_size > 1").select("digest"))
    decided = groups.join(checked, "digest", "left").select(
        "digest",
        "keep_id",
        "group_size",
        F.when(F.coalesce("texts", F.lit(1)) > 1, F.raise_error(F.lit("two texts share one SHA-256"))).alias("clash"),
    )
    # written, so that the join's two sides are plain exchanges and a hot digest's rows can be split
    out = digests.join(materialise(decided, "dedup-decided"), "digest")
    return out.where("clash IS NULL").select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def byte_check(texts: DataFrame, repeated: DataFrame, screened: int = SCREENED, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """digest, texts: how many different texts each repeated digest has; grouping on the text compares its bytes.

    A text that the filters of `repeated` (digest) let through by chance is a group of its own.
    """
    keyed = texts.select(F.sha2("text", 256).alias("digest"), "text")
    n = repeated.count()
    if n <= screened:
        shards = max(1, -(-n // shard_keys))
        known = texts.sparkSession.sparkContext.broadcast(build_filters(repeated.select(F.xxhash64("digest").alias("key")), shards).toPandas())

        @F.pandas_udf("boolean")
        def may_repeat(key: pd.Series, shard: pd.Series) -> pd.Series:
            keys, own = key.to_numpy().view(np.uint64), shard.to_numpy()
            out = np.zeros(len(keys), bool)
            for row in known.value.to_dict("records"):
                at = np.flatnonzero(own == row["shard"])
                out[at] = maybe_contains(row, keys[at])
            return pd.Series(out)

        key = F.xxhash64("digest")
        keyed = keyed.where(may_repeat(key, _shard(key, shards)))
    alike = keyed.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("rows"))
    return alike.groupBy("digest").agg(F.count("rows").alias("texts"))
