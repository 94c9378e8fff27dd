"""Deterministic sharded WARC writer and reader.

Pages are dealt to shards by ranges of page_id and sorted, so that the shards in order are the table in
order. There is a shard for every `shard_bytes` of payload; the bounds are quantiles of the ids whose hash
falls into a fixed share, so they depend on the pages alone and not on how Spark has split the table. A shard is written as gzip members (one a record,
time stamp 0) to a temporary name and rolls to the next file when the compressed size reaches
`roll_bytes`; a finished file is renamed to a name made from shard and number, and reported with its
size and SHA-256 in the manifest. The
manifest is a Parquet table that Spark commits when all tasks are done; the reader reads only the
files it lists and checks size and digest. A retried or speculative task rewrites the same bytes
under the same names.

Headers and digests are regenerated from the payload: the first page_id of equal payloads is a
`response`, the others are `revisit` records without a payload that name it by page, URI and record.
Payloads shorter than `least_bytes` are all responses. A record's id is made from page, URI, payload and
the number of its repeat, so that it is its own.

Scale: equal payloads are found on (digest, page_id) rows only, grouped with partial aggregation;
whole pages move once, to be range-sorted, and meet their decisions there (a decision without its page
is an error). Shards hold about as many pages each. A task holds one page and
one file buffer; a reading task opens its files itself. Files are written through the file system that the shared
folder's URI names (local, hdfs, s3, gs).

Defined results: a null html is an empty payload; a null url becomes an empty target; a null
page_id is written without that header and read back as null (it revisits the first
that has an id; payloads that only null ids have are all responses); repeated rows become records of their own; an empty table gives an empty
manifest and an empty result; other columns are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path

MANIFEST = "file string, bytes long, records long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
MAX_SAMPLE = 1_000_000
SHARD_BYTES = 128 << 20
MOST_TASKS = 100_000
DATE = "1970-01-01T00:00:00Z"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file://" + uri)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, url: str, sha: str, repeat: int = 0) -> str:
    """`sha`: SHA-1 of the payload in hex; `repeat`: how many equal records are in front of this one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {sha} {repeat} {url}')}>"


def _one_line(url: str) -> str:
    return url.replace("\r", "").replace("\n", "")


def encode_record(page_id, url: str, payload: bytes, first: tuple | None, repeat: int = 0) -> bytes:
    """One WARC/1.1 record as a gzip member; `first`: page_id and url of the response with this payload, None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if first else http + payload
    sha = hashlib.sha1(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first else 'response'}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Record-ID: {record_id(page_id, url, sha.hexdigest(), repeat)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha.digest()).decode()}",
        f"WARC-Block-Digest: sha1:{sha1_base32(body)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if first:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(*first, sha.hexdigest())}")
        head.append(f"WARC-Refers-To-Target-URI: {_one_line(first[1])}")
        head.append(f"WARC-Refers-To-Date: {DATE}")
        head.append(f"WARC-Refers-To-Page-ID: {first[0]}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def decode_records(stream) -> Iterator[tuple]:
    """Rows of RECORD from an open gzip stream; raises if a length or digest doesn't hold."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("a record must begin with its version")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        body = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or head["WARC-Block-Digest"] != "sha1:" + sha1_base32(body):
            raise ValueError(f"damaged record {head.get('WARC-Record-ID')}")
        http, _, payload = body.partition(b"\r\n\r\n")
        length = int(http.rpartition(b"Content-Length: ")[2])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = head["WARC-Type"]
        if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
            raise ValueError(f"damaged payload {head['WARC-Record-ID']}")
        page, refers = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
        yield (page and int(page), head["WARC-Target-URI"], length, digest, kind, refers and int(refers), payload if kind == "response" else None)


def find_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, sha, refers_to, refers_url: the pages whose payload an earlier page_id has, by SHA-1, with that page. Null ids come after all others."""
    payload = F.coalesce("html", F.lit(""))
    url = F.coalesce("url", F.lit(""))
    keyed = pages.select("page_id", url.alias("url"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size"))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = keyed.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("n"))
    again = first.where("n > 1").drop("n")
    met = keyed.join(again, ["sha", "size"]).where("page_id > first.page_id OR (page_id IS NULL AND first.page_id IS NOT NULL)")
    return met.select("page_id", "sha", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")).distinct()


def shard_bounds(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """Ids that cut the table into ranges of about `shard_bytes` of payload, from at most about MAX_SAMPLE ids."""
    n, size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length("html"))).first()
    shards = max(1, -(-(size or 0) // shard_bytes))
    share = max(1, n // min(MAX_SAMPLE, 32 * shards))
    some = pages.select("page_id").where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(share)) == 0))
    ids = sorted(r[0] for r in some.collect())
    return sorted({ids[len(ids) * k // shards] for k in range(1, shards)}) if ids else []


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, roll_bytes: int = 16 << 20, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html) under `path`; returns the manifest, which is committed when this returns."""
    spark = pages.sparkSession
    data, manifest = f"{path}/data", f"{path}/manifest"
    found = np.array(shard_bounds(pages, shard_bytes), np.int64)
    bounds = spark.sparkContext.broadcast(found)

    @F.arrow_udf("int")
    def shard_of(page_id: pa.Array) -> pa.Array:
        # null ids, which would make doubles of the others, go first
        ids = page_id.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(bounds.value, ids, "right").astype(np.int32))

    none = {"sha": F.lit(None).cast("string"), "refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")}
    page_id = F.col("page_id").cast("long").alias("page_id")
    rows = pages.select(page_id, F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumns(none)
    # a decision travels as a row in front of its page, so that pages move once
    decided = find_revisits(pages, least_bytes).select(page_id, F.lit("").alias("url"), F.lit("").alias("html"), *none)
    placed = rows.unionByName(decided).withColumn("shard", shard_of(F.col("page_id")))
    order = ["shard", "page_id", F.col("sha").isNull(), "url", "html"]
    ordered = placed.repartitionById(len(found) + 1, F.col("shard")).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        store, root = _filesystem(data)
        buffer, shard, number, records = io.BytesIO(), -1, 0, 0
        page, firsts, met, last, repeat = None, {}, set(), None, 0

        def flush() -> pa.RecordBatch:
            nonlocal buffer, number, records
            content = buffer.getvalue()
            name = f"part-{shard:06d}-{number:05d}.warc.gz"
            temporary = f"{root}/_temporary-{attempt}-{name}"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(temporary, compression=None) as out:
                out.write(content)
            try:
                store.move(temporary, f"{root}/{name}")
            except OSError:
                # another attempt at this task has put the same bytes there
                if store.get_file_info(f"{root}/{name}").size != len(content):
                    raise
                store.delete_file(temporary)
            row = {"file": name, "bytes": len(content), "records": records, "sha256": hashlib.sha256(content).hexdigest()}
            buffer, number, records = io.BytesIO(), number + 1, 0
            return pa.RecordBatch.from_pylist([row])

        def all_met() -> None:
            if len(met) < len(firsts):
                raise ValueError(f"a decision about page {page} has found no such payload")

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "html", "sha", "refers_to", "refers_url", "shard"))
            for page_id, url, html, sha, refers_to, refers_url, own in zip(*columns, strict=True):
                if page_id.as_py() != page:
                    all_met()
                    page, firsts, met, last = page_id.as_py(), {}, set(), None
                if sha.is_valid:
                    firsts[sha.as_py()] = (refers_to.as_py(), refers_url.as_py())
                    continue
                if own.as_py() != shard:
                    if records:
                        yield flush()
                    shard, number = own.as_py(), 0
                payload, target = html.as_buffer().to_pybytes(), url.as_py()
                repeat = repeat + 1 if (target, payload) == last else 0
                last = (target, payload)
                key = hashlib.sha1(payload).hexdigest() if firsts else None
                if first := firsts.get(key):
                    met.add(key)
                buffer.write(encode_record(page, target, payload, first, repeat))
                records += 1
                if buffer.tell() >= roll_bytes:
                    yield flush()
        all_met()
        if records:
            yield flush()

    ordered.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.parquet(manifest)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files of the manifest under `path`, with payloads (null for revisits)."""
    manifest = spark.read.parquet(f"{path}/manifest")
    n = manifest.count()
    if not n:
        return spark.createDataFrame([], RECORD)
    data = f"{path}/data"
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(data)
        for batch in batches:
            for file, sha, size in zip(*(batch.column(c).to_pylist() for c in ("file", "sha256", "bytes")), strict=True):
                with store.open_input_file(f"{root}/{file}") as f:
                    content = f.read_buffer()
                if content.size != size or hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"{file} is damaged")
                rows, held = [], 0
                with gzip.GzipFile(fileobj=pa.BufferReader(content)) as stream:
                    for record in decode_records(stream):
                        rows.append(dict(zip(schema.names, record, strict=True)))
                        held += len(record[-1] or b"")
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # a task opens the files of its rows itself: archives are not shuffled
    return manifest.repartition(min(n, MOST_TASKS), "file").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0, roll_bytes: int = 16 << 20) -> DataFrame:
    """Write `pages` to a new folder in the shared folder and read all records back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, least_bytes, roll_bytes)
    return read_warc(pages.sparkSession, path)
