import random
import zlib
from array import array
from collections import defaultdict
from itertools import combinations

import public_tokenizers
from tokenizers import Tokenizer

from rookery.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, start long, length string"


def check(docs, rows, capacity=4096):
    library = Tokenizer.from_file(FILE)
    want = defaultdict(list)
    for d in docs:
        ids = [*library.encode(d[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d[0]].append((k, at, len(part), zlib.crc32(array("I", part).tobytes())))
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    made, bound = check(docs.collect(), packing.pack(docs.repartition(5), FILE).collect())
    assert made <= bound + 1


def test_edge_rows(spark):
    rows = [(1, None, 1, "x"), (2, "", 1, "x"), (3, " \n", 1, None), (4, "a b", 1, "x"), (4, "a b", 1, "x"), (None, "q", 1, "x")]
    rows += [(5, "word " * 9000, 1, "x"), (6, "<|endoftext|> ² İstanbul é 漢字\x85 it's", 1, "x")]
    check(rows, packing.pack(spark.createDataFrame(rows, DOCS), FILE).collect())
    assert packing.pack(spark.createDataFrame([], DOCS), FILE).collect() == []


def fewest(sizes, capacity):
    """Bins by trying everything."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def test_reduction_keeps_an_optimum():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([10, 20, 37])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        fixed, left = packing.reduce_dominated({s: sizes.count(s) for s in sizes}, capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + (fewest(sorted(rest, reverse=True), capacity) if rest else 0) == fewest(sizes, capacity)
        used = sorted([s for n, lengths in fixed for s in lengths * n] + rest, reverse=True)
        assert used == sizes and all(sum(lengths) <= capacity for _, lengths in fixed)


def test_best_fit_covers():
    counts = {a + b: a * b for a, b in combinations(range(1, 40), 2)}
    made = packing.best_fit(counts, 100)
    total = defaultdict(int)
    for n, lengths in made:
        assert sum(lengths) <= 100
        for w in lengths:
            total[w] += n
    assert total == counts
