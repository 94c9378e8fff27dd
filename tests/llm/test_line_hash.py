import hashlib
import random
import time

import xxhash
from pyspark.sql import functions as F

from rookery.llm import line_dedup

P1, P2, P3, P4 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579
M = 2**64 - 1


def turn(x, r):
    return (x << r | x >> (64 - r)) & M


def before_the_tail(block, seed, length):
    """State of XXH64 after the 32 bytes of `block`, in front of the last 8 of `length`."""
    v = [(seed + P1 + P2) & M, (seed + P2) & M, seed, (seed - P1) & M]
    for i in range(4):
        v[i] = turn((v[i] + int.from_bytes(block[8 * i : 8 * i + 8], "little") * P2) & M, 31) * P1 & M
    h = sum(turn(x, r) for x, r in zip(v, (1, 7, 12, 18), strict=True)) & M
    for x in v:
        h = ((h ^ turn(x * P2 & M, 31) * P1 & M) * P1 + P4) & M
    return (h + length) & M


def two_lines_of_one_xxh64(seed=42):
    """The last round is inverted: it is given the eight bytes that lead to the hash of another line."""
    rng = random.Random(5)
    letters = b"abcdefghijklmnopqrstuvwxyz"
    one = bytes(rng.choice(letters) for _ in range(40))
    k = turn(int.from_bytes(one[32:], "little") * P2 & M, 31) * P1 & M
    want = before_the_tail(one[:32], seed, 40) ^ k
    while True:
        block = bytes(rng.choice(letters) for _ in range(32))
        k = before_the_tail(block, seed, 40) ^ want
        tail = turn(k * pow(P1, -1, 2**64) & M, 33) * pow(P2, -1, 2**64) & M
        two = block + tail.to_bytes(8, "little")
        if all(32 < c < 127 and not 65 <= c <= 90 for c in two[32:]):
            return one.decode(), two.decode()


def test_lines_of_one_xxh64_are_told_apart(spark):
    one, two = two_lines_of_one_xxh64()
    assert one != two and xxhash.xxh64_intdigest(one, 42) == xxhash.xxh64_intdigest(two, 42)
    docs = spark.createDataFrame([(i, one) for i in range(5)] + [(5, two), (6, one + "\n" + two)], "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, r.kept_text) for r in line_dedup.drop_frequent_lines(docs).collect()}
    assert got == {i: (1, "") for i in range(5)} | {5: (0, two), 6: (0, one + "\n" + two)}


def test_hash_is_part_of_sha256(spark):
    line = " \t Ünd ONE line\x0b"
    made = spark.createDataFrame([(line,)], "k string").select(line_dedup.line_hash(line_dedup.line_keys(F.col("k"))[0]).alias("h")).first().h
    assert bytes(made) == line_dedup.hash_of(line.encode()) == hashlib.sha256("Ünd one line".encode()).digest()[:16]


def test_many_lines(spark):
    lines = [f"this is the shared line of the number {i} and no other" for i in range(20_000)]
    docs = spark.createDataFrame([(i, "\n".join(lines + [f"own {i}"])) for i in range(6)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text[-5:]) for r in line_dedup.drop_frequent_lines(docs).collect()}
    assert got == {i: (20_001, 20_000 if i < 5 else 0, f"own {i}") for i in range(6)}
    assert time.time() - began < 40


def test_null_ids_lose_lines_like_others(spark):
    line = "a line of at least forty characters, shared by many documents"
    other = "another line of at least forty characters, which only null ids hold"
    rows = [(i, f"own {i}\n{line}") for i in range(1, 7)] + [(None, f"x\n{line}\n{other}"), (None, f"y\n{line}\n{other}"), (None, f"y\n{line}\n{other}")]
    rows += [(None, f"z{i}\n{other}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r.doc_id), r.kept_text, r.n_dropped) for r in line_dedup.drop_frequent_lines(df).collect())
    want = [(str(i), f"own {i}" if i < 6 else f"own {i}\n{line}", int(i < 6)) for i in range(1, 7)]
    want += [("None", f"{c}\n{other}", 1) for c in "xyy"] + [("None", f"z{i}\n{other}", 0) for i in range(4)]
    assert got == sorted(want)
