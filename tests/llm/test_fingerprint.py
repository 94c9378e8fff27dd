import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rookery.llm import fingerprint

DOCS = "doc_id long, text string, rank long, block long, hashes string"


def edited(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = {}
    for k, (doc_id, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out[doc_id] = (len(text), text[: len(text) - half] + after[:half])
    return out


def ids(kind, n):
    if kind == "hashes":
        return [int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:8], "little", signed=True) for i in range(n)]
    if kind == "clusters":
        return [i * 3 + (i % 3) * 2**61 for i in range(n)]
    return [i * kind for i in range(n)]


@pytest.mark.parametrize("block", [fingerprint.BLOCK, 7])
@pytest.mark.parametrize("spread", [1, 1000, "hashes", "clusters"])
def test_edited_texts(spark, monkeypatch, spread, block):
    monkeypatch.setattr(fingerprint, "BLOCK", block)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(i, r.text) for i, r in zip(ids(spread, docs.count()), docs.collect(), strict=True)]
    got = fingerprint.compare_with_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_chars, r.edited) for r in got} == edited(rows)
    of = {r.text: set() for r in docs.collect()}
    texts = dict(rows)
    for r in got:
        of[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in of.values())
    assert sum(r.near_edited for r in got) > sum(r.near_next for r in got)


def test_containment_of_a_part(spark):
    words = [f"w{i}" for i in range(20000)]
    rows = [(1, " ".join(words), 1, 1, "x"), (2, " ".join(words[3000:5000]), 1, 1, "x"), (3, " ".join(words[::-1]), 1, 1, "x")]
    got = {r.doc_id: r for r in fingerprint.compare_with_edited(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].within_next == 1.0 and got[2].within_next == 0.0
    assert 0.08 < got[1].near_next < 0.12 and 0.4 < got[1].near_edited < 0.6
    assert 0.27 < got[3].near_edited < 0.4


def test_edge_rows(spark):
    rows = [(None, "a b c d e f", 1, 1, "x"), (5, None, 1, 1, "x"), (7, "", 1, 1, "x"), (9, "é", 1, 1, "x"), (9, "é", 1, 1, "x")]
    got = fingerprint.compare_with_edited(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == "" and by[5].near_next == 1.0 and by[7].near_next == 0.0
    assert by[None].edited == "a b c " + "" and by[9].near_edited == 1.0
    assert fingerprint.compare_with_edited(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("spread", [1, 10**12, "hashes", "clusters"])
def test_blocks_are_even_and_in_order(spark, spread):
    ranks = spark.createDataFrame([(i,) for i in ids(spread, 20_000)], "rank long")
    bounds = fingerprint.rank_bounds(ranks, 20_000)
    rows = ranks.select("rank", fingerprint.block_of(F.col("rank"), bounds, 20_000 // 50).alias("block")).orderBy("rank").collect()
    blocks = [r.block for r in rows]
    assert blocks == sorted(blocks) and 300 <= len(set(blocks)) <= 400
    assert max(Counter(blocks).values()) <= 200


def test_repeated_sparse_ids(spark):
    rows = [(d * 10**15, f"text {d} {k} of some words here") for d in range(-20, 20) for k in range(5)] + [(None, "none"), (None, "none")]
    got = fingerprint.compare_with_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for k, (d, text) in enumerate(ordered):
        half, after = len(text) // 2, ordered[(k + 1) % len(ordered)][1]
        want[d, text[: len(text) - half] + after[:half]] += 1
    assert Counter((r.doc_id, r.edited) for r in got) == want


def plain_sketch(text):
    """The real shingle set of a text."""
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_estimates_true_resemblance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = dict(tuple(r) for r in docs.collect())
    order = sorted(texts)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    errors = []
    for r in fingerprint.compare_with_edited(docs).collect():
        for near, other in ((r.near_edited, r.edited), (r.near_next, texts[after[r.doc_id]])):
            a, b = plain_sketch(texts[r.doc_id]), plain_sketch(other)
            if len(a | b) >= 400:
                errors.append(abs(near - len(a & b) / len(a | b)))
    assert len(errors) > 500 and sum(errors) / len(errors) < 0.03 and max(errors) < 0.25
