import base64
import gzip
import hashlib
from pathlib import Path

from rookery.llm import warc

PAGES = "page_id long, url string, html string, refers_to string, size long"


def plain(rows):
    out = []
    for p, _, html, *_ in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(same, default=None)
        refers = first if first is not None and (p is None or p > first) else None
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


def test_pages_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = pages.unionByName(pages.limit(20).withColumn("page_id", pages["page_id"] + 1_000_000))
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = warc.round_trip(pages.repartition(3), roll_bytes=100_000)
    assert found(got) == plain(rows)
    html = {r[0]: r[2] for r in rows}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in got.where("record_type = 'response'").collect())


def test_files_are_deterministic_and_plain_warc(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    names = []
    for k, frame in enumerate((pages, pages.repartition(7))):
        listed = warc.write_warc(frame, f"file://{tmp_path}/{k}", roll_bytes=10_000).collect()
        names.append(sorted((r.file, r.bytes, r.records, r.sha256) for r in listed))
        assert sum(r.records for r in listed) == pages.count()
        assert {p.name for p in Path(tmp_path, str(k), "data").iterdir() if not p.name.startswith(".")} == {r.file for r in listed}
    assert names[0] == names[1] and len(names[0]) > 4
    text = gzip.open(f"{tmp_path}/0/data/{names[0][0][0]}").read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ") and text.endswith(b"\r\n\r\n")


def test_edge_rows(spark):
    rows = [(5, "http://a/", "same", "x", 1), (3, None, "same", "x", 1), (3, None, "same", "x", 1), (None, "u", "same", "x", 1), (7, "a\r\nb: c", None, "x", 1)]
    rows += [(8, "http://b/", "", "x", 1), (9, "http://c/", "é" * 2_000_000, "x", 1), (10, "http://d/", "WARC/1.1\r\n\r\n\r\nContent-Length: 9\r\n\r\n", "x", 1)]
    frame = spark.createDataFrame(rows, PAGES)
    assert found(warc.round_trip(frame)) == plain(rows)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
    kinds = {(r.page_id, r.record_type) for r in warc.round_trip(frame, least_bytes=5).collect()}
    assert (5, "response") in kinds and (8, "response") in kinds


def test_large_ids_beside_null_ones(spark):
    rows = [(2**60 + i, f"http://h/{i}", "one payload", "x", 1) for i in range(400)] + [(None, "http://n/", "one payload", "x", 1)]
    frame = spark.createDataFrame(rows, PAGES).repartition(5)
    for size in (warc.SHARD_BYTES, 500):
        got = warc.read_warc(spark, _written(frame, size))
        assert found(got) == plain(rows)
        assert got.where("record_type = 'response'").count() == 1


def test_null_ids_revisit_and_alone_are_responses(spark):
    rows = [(None, "http://n/", "same", "x", 1), (3, "http://a/", "same", "x", 1), (5, "http://b/", "same", "x", 1), (None, "http://m/", "same", "x", 1)]
    rows += [(None, "http://k/", "only null", "x", 1), (None, "http://l/", "only null", "x", 1), (None, "http://k/", None, "x", 1)]
    frame = spark.createDataFrame(rows, PAGES).repartition(3)
    got = warc.round_trip(frame)
    assert found(got) == plain(rows)
    assert got.where("page_id IS NULL AND record_type = 'revisit' AND refers_to = 3").count() == 2


def _written(frame, shard_bytes):
    path = warc.scratch_path(frame.sparkSession, "warc")
    warc.write_warc(frame, path, shard_bytes=shard_bytes)
    return path


def test_shards_follow_the_size_and_revisits_name_their_record(spark):
    rows = [(i, f"http://h/{i % 4}", "same" if i % 3 else "x" * 100, "x", 1) for i in range(300)] + [(1, "http://h/1", "same", "x", 1)] * 2
    frame = spark.createDataFrame(rows, PAGES)
    path = _written(frame, 1000)
    assert spark.read.parquet(f"{path}/manifest").selectExpr("substring(file, 6, 6)").distinct().count() > 5
    heads = []
    for r in spark.read.parquet(f"{path}/manifest").collect():
        text = gzip.open(f"{path.removeprefix('file://')}/data/{r.file}").read().decode()
        for record in text.split("WARC/1.1\r\n")[1:]:
            heads.append(dict(line.split(": ", 1) for line in record.split("\r\n\r\n")[0].split("\r\n")))
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(ids) == len(set(ids)) == len(rows)
    uris = {h["WARC-Record-ID"]: h["WARC-Target-URI"] for h in heads if h["WARC-Type"] == "response"}
    again = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert again and all(uris[h["WARC-Refers-To"]] == h["WARC-Refers-To-Target-URI"] for h in again)
