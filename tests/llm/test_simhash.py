import numpy as np
import pytest
import xxhash

from rookery.llm import simhash

DOCS = "doc_id long, text string, lang string, fp long, key long"


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    texts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(t, 42) for t in texts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    prints = [plain_print(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip(prints, plain_components([r.doc_id for r in rows], prints))))
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


@pytest.mark.parametrize("bucket", [2, 1024])
def test_dense_cluster_and_chain(spark, bucket):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    values = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (60, 2))}
    values |= {base ^ ((1 << k) - 1) << 20 for k in range(0, 40, 3)} | set(rng.integers(0, 2**62, 40).tolist())
    values = sorted(values)
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.root for r in simhash.connected_components(simhash.near_links(nodes, bucket)).collect()}
    want = plain_components(values, values)
    assert [found.get(v, v) for v in values] == want


def test_edge_rows(spark):
    rows = [(1, None, "en", 7, 7), (2, "", "en", 7, 7), (3, " \n", None, 7, 7), (4, "One two", "en", 7, 7), (4, "One two", "en", 7, 7)]
    rows += [(None, "one TWO", "en", 7, 7), (6, "long words " * 30000, "en", 7, 7)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 4), (6, 6)}
    assert len(got) == 7
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
