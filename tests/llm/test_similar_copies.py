import itertools
import random

import corpus_pipeline
import pytest
from rookery.llm import simhash


def plain_sets(texts):
    split = {d: (t or "").encode().lower().split() for d, t in texts.items()}
    return {d: {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in split.items()}


def plain_kept(texts, similarity=0.8):
    """Smallest id of each component, all pairs compared."""
    sets = plain_sets(texts)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        low, high = sorted((len(sets[a]), len(sets[b])))
        if low >= similarity * high - 1e-9 and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d for d in sets if find(d) == d}


def test_near_copies_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"]).cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = plain_kept(texts)
    assert len(texts) - len(want) >= 5
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want


@pytest.mark.parametrize("sample", [1, 20_000])
def test_group_and_chain(spark, monkeypatch, sample):
    monkeypatch.setattr(simhash.common_shingles, "__defaults__", (sample,))
    base = [f"w{i}" for i in range(100)]
    texts = {i: " ".join([*base[:50], f"x{i}", *base[51:]]) for i in range(30)}  # near copies of each other
    texts |= {100 + i: " ".join([f"y{j}" for j in range(6 * i, 6 * i + 100)]) for i in range(8)}  # a chain: neighbours only
    texts |= {200 + i: " ".join([*base[:45], *(f"z{i}-{j}" for j in range(60))]) for i in range(20)}  # a common passage, not copies
    texts |= {300: "One two", 301: "one  TWO", 302: "", 303: None, 304: "one two three"}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    want = plain_kept(texts)
    assert {0, 100, 300, 302, 304} | {200 + i for i in range(20)} == want
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want


def test_short_texts_of_the_similarity_are_linked(spark):
    """Texts of 4 to 10 shingles: one word more or less is similar or not, whatever the fingerprints."""
    rng = random.Random(11)
    texts = {}
    for i in range(20_000):
        words = [f"{rng.getrandbits(40):x}" for _ in range(rng.randint(8, 13))]
        other = [*words, f"{rng.getrandbits(40):x}"] if i % 2 else words[1:]
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(other)
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    sets = plain_sets(texts)
    gone = {2 * i + 1 for i in range(20_000) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1]) - 1e-9}
    assert 10_000 < len(gone)
    far = [d for d in gone if (simhash.fingerprint(texts[d].encode(), 5) ^ simhash.fingerprint(texts[d - 1].encode(), 5)).bit_count() > 22]
    assert far  # some are far apart in SimHash
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == set(texts) - gone


def test_long_texts_of_the_similarity_are_linked(spark):
    """Texts with the longer marks: those just similar enough, and others that share a passage."""
    rng = random.Random(12)
    word = lambda: f"{rng.getrandbits(40):x}"
    texts, passage = {}, [word() for _ in range(60)]
    for i, n in enumerate([950, 1000, 1005, 1010, 1500, 7990, 8003, 8010, 12000]):
        words = [word() for _ in range(n)] + passage
        at = rng.randrange(n)
        near = words[:at] + [word() for _ in range(n // 10)] + words[at + n // 10 :]  # 0.81 to 0.82
        far = words[:at] + [word() for _ in range(n // 8)] + words[at + n // 8 :]  # 0.77
        texts |= {10 * i: " ".join(words), 10 * i + 1: " ".join(near), 10 * i + 2: " ".join(far)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    want = plain_kept(texts)
    assert len(texts) - len(want) >= 9
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want
