import itertools
import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rookery.llm.bin_slack import ByteEncoder, Pool, closest, pack_windows

FILE = public_tokenizers.path("byte_bpe_50k.json")


def library():
    own = Tokenizer.from_file(FILE)
    own.no_truncation()
    own.no_padding()
    return own


def power_of_two(n):
    return n & (n - 1) == 0


def check(rows, docs, capacity, ids_of):
    """Every id in one piece, sequences gapless, and padding only where a sequence is no power of two."""
    placed, pieces = {}, {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, bytes(r.ids), r.doc_tokens))
    padding = 0
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if power_of_two(at) else capacity - at
    for doc_id, text in docs.items():
        want = array("I", [*ids_of(text), 1]).tobytes()
        got = sorted(pieces.pop(doc_id))
        assert b"".join(p[2] for p in got) == want
        assert [p[0] for p in got] == [sum(q[1] for q in got[:i]) for i in range(len(got))]
        assert {p[3] for p in got} == {len(want) // 4}
    assert not pieces
    return padding


def test_closest_against_every_multiset():
    rng = random.Random(5)
    for _ in range(300):
        sizes = sorted(rng.sample(range(1, 30), rng.randint(0, 5)))
        counts = {w: rng.randint(1, 4) for w in sizes}
        target = rng.randint(1, 60)
        sums = {sum(w * n for w, n in zip(sizes, each, strict=True)) for each in itertools.product(*[range(counts[w] + 1) for w in sizes])}
        used = closest(sizes, counts, target)
        assert all(0 < n <= counts[w] for w, n in used.items())
        assert sum(w * n for w, n in used.items()) == max(s for s in sums if s <= target)


@pytest.mark.parametrize("lengths", [[1500] * 40, [7] * 3, [2047] * 9, [1] * 5000, list(range(1, 300)), [1025] * 11 + [3] * 2])
def test_pool_leaves_no_padding(lengths):
    pool = Pool(2048)
    for i, n in enumerate(lengths):
        pool.put(i, 0, bytes(4 * n), n)
    got, sizes = [], []
    while pool.tokens:
        window = pool.window()
        got += [(p[0], p[1], len(p[2]) // 4) for p in window]
        sizes.append(sum(len(p[2]) // 4 for p in window))
    assert sum(sizes) == sum(lengths) and all(power_of_two(s) for s in sizes)
    for i, n in enumerate(lengths):
        at = 0
        for _, start, length in sorted(g for g in got if g[0] == i):
            assert start == at
            at += length
        assert at == n


def test_few_cuts_where_short_pieces_abound():
    rng = random.Random(1)
    pool = Pool(2048)
    for i in range(3000):
        n = 1 + int(min(2047, rng.lognormvariate(6, 1.2)))
        pool.put(i, 0, bytes(4 * n), n)
    pieces = 0
    while pool.tokens:
        pieces += len(pool.window())
    assert pieces < 3000 + 40


def test_ids_of_hostile_texts():
    rng = random.Random(3)
    parts = ["the", " ", "  ", "\n", "\t\r\n", "'s", "'ll", "123", "é", "ß", "ɏ", "ɐ", "日本", " ", " ", "\x1c", "\x00", "𐍈", "<|endoftext|>", "<|", "½", "²", "_", "--", "a" * 30, "́", "🙂"]
    own, lib = ByteEncoder(FILE), library()
    assert own.merge
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + ["", "x" * 5000, " " * 5000, " \n" * 3000]
    for t in texts:
        assert array("I", own.encode(t)).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_pack_windows(spark):
    rng = random.Random(2)
    words = ["alpha", "bêta", "gamma", "delta\n", "<|endoftext|>", "  "]
    docs = {i: " ".join(rng.choices(words, k=rng.choice([0, 3, 40, 400]))) for i in range(200)}
    docs |= {-5: "word " * 9000, 1 << 40: ""}
    rows = [(i, t, "x", 1) for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, sequence_id int").repartition(3)
    lib = library()
    out = pack_windows(df, FILE)
    assert check(out.collect(), docs, 2048, lambda t: lib.encode(t, add_special_tokens=False).ids) == 0
    small = pack_windows(df, FILE, 100).collect()
    assert check(small, docs, 100, lambda t: lib.encode(t, add_special_tokens=False).ids) == 0


def test_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (4, None), (4, "c"), (4, "c")], "doc_id long, text string").coalesce(1)
    rows = pack_windows(df, FILE).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows if r.start == 0) == [("4", 1), ("4", 2), ("4", 2), ("None", 1), ("None", 3)]
    assert sum(r.length for r in rows) == 9
    assert pack_windows(df.limit(0), FILE).collect() == []


def test_query(spark):
    from rookery.llm.queries import op11_bin_slack

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op11_bin_slack(spark, sf)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    lib, rows = library(), out.collect()
    ids = {d: array("I", [*lib.encode(t, add_special_tokens=False).ids, 1]) for d, t in docs.items()}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert all(power_of_two(n) and n <= 2048 for n in filled.values())
