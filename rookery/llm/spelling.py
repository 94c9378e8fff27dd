"""Spelling variants: near words by a relational trie, and the form that each word follows.

Words are counted in tasks and summed. Those that are frequent and long enough form a trie, which is an
edge table: a node is the hash of a prefix. The frontier holds states (word, position, node, edits): of
the word so far read its own node of the trie, so that words share a state until they part; how many
letters were read; the node reached; one edit. Level by level the frontier is joined with the edges on
both sides, and the level's own edges open new states: two children of a node for a replaced letter, a
child beside its parent for a letter too many. A state goes on only with letters that lie below both of
its nodes, of which each edge knows the set. States that end in two words make them near. Nearness is
symmetric, so that each pair is found once, and a missing letter is one too many in the other word.
Words of over DEPTH letters are compared by the hashes that are left when one letter is taken out. All
pairs are checked on the words themselves, so that equal hashes do no harm.

Scale: counting moves a word a task; all else is equality joins. Children of a node are at most as many
as there are letters, so that no key opens many states; the root's level and those below it have few
nodes, since states are of prefixes and not of words. Each level is written. A form has at least RATIO
times the count, so that chains are short: they are followed by doubling.

Defined results: a null text has no words, a null doc_id is the empty string in front of the colon;
repeated rows count again; very long words are linked like others; ties of forms go to the smallest word
in code-point order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete_path, materialise, scratch_path

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: Levels of the trie; longer words are compared by hashes with one letter taken out.
DEPTH = 32
#: Words that a task counts before it sends them on.
HELD = 200_000
#: The words of documents, A-Z lower-cased, and the share of them that lose a letter.
RUN = re.compile("[a-zÀ-ÿ]+")
DAMAGED = 199
#: Bit of the end of a word in the set of letters that may follow; a-z have the bits before.
END = 1 << 26


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, n: runs of letters of `docs` (doc_id, text), one in 199 of them without one letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def send() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # bytes are lower-cased by ASCII's rule alone
                for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield send()
        if held:
            yield send()

    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def low_bit(code: Column) -> Column:
    """Bit of a letter a-z, else 0."""
    return F.when(code < 192, F.call_function("shiftleft", F.lit(1).cast("long"), code - 97)).otherwise(F.lit(0).cast("long"))


def high_bit(code: Column) -> Column:
    """Bit of a letter of code 192 to 255, else 0."""
    return F.when(code >= 192, F.call_function("shiftleft", F.lit(1).cast("long"), code - 192)).otherwise(F.lit(0).cast("long"))


def trie_edges(words: DataFrame) -> DataFrame:
    """depth, parent, child, c, low, high: an edge to each prefix of the words, and what may follow it.

    `c` is the letter's code (0 for the root, whose parent is 0), `low` and `high` are the sets of letters
    below the child, with END if it is a word.
    """
    steps = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("depth"))
    prefix = lambda n: F.xxhash64(F.left("word", n))
    letter = lambda at: F.ascii(F.substr("word", at, F.lit(1)))
    depth = F.col("depth")
    after = letter(depth + 1)
    ends = depth == F.length("word")
    return (
        steps.select(
            depth,
            F.when(depth == 0, F.lit(0).cast("long")).otherwise(prefix(depth - 1)).alias("parent"),
            prefix(depth).alias("child"),
            F.when(depth == 0, 0).otherwise(letter(depth)).alias("c"),
            F.when(ends, F.lit(END).cast("long")).otherwise(low_bit(after)).alias("low"),
            F.when(ends, F.lit(0).cast("long")).otherwise(high_bit(after)).alias("high"),
        )
        .groupBy("depth", "parent", "child", "c")
        .agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))
    )


def states(both: DataFrame, word: str, node: str) -> DataFrame:
    """word, node, low, high: the pairs that have a letter or the end in common below."""
    low, high = F.col(f"{word}.low").bitwiseAND(F.col(f"{node}.low")), F.col(f"{word}.high").bitwiseAND(F.col(f"{node}.high"))
    out = both.select(F.col(f"{word}.child").alias("word"), F.col(f"{node}.child").alias("node"), low.alias("low"), high.alias("high"))
    return out.where((F.col("low") != 0) | (F.col("high") != 0))


def trie_pairs(words: DataFrame, count: int, longest: int) -> DataFrame:
    """word, node: hashes of the words of at most DEPTH letters that are one edit apart, each pair once."""
    spark = words.sparkSession
    path, files = scratch_path(spark, "spelling-edges"), max(1, count // 200_000)
    edges = trie_edges(words)
    edges.repartition(F.col("depth"), F.pmod("parent", F.lit(files))).write.partitionBy("depth").parquet(path)
    edges = spark.read.schema(edges.schema).parquet(path)
    frontier, levels = None, []
    for depth in range(1, longest + 1):
        here, above = edges.where(F.col("depth") == depth), edges.where(F.col("depth") == depth - 1)
        a, b, p = here.alias("a"), here.alias("b"), above.alias("p")
        replaced = states(a.join(b, (F.col("a.parent") == F.col("b.parent")) & (F.col("a.c") < F.col("b.c"))), "a", "b")
        # of equal letters the first is the one too many
        extra = states(a.join(p, (F.col("a.parent") == F.col("p.child")) & (F.col("a.c") != F.col("p.c"))), "a", "p")
        opened = replaced.union(extra)
        if frontier is not None:
            f, q = frontier.where((F.col("low").bitwiseAND(F.lit(END - 1)) != 0) | (F.col("high") != 0)).alias("f"), here.union(above).alias("q")
            shared = (F.col("f.low").bitwiseAND(low_bit(F.col("a.c"))) != 0) | (F.col("f.high").bitwiseAND(high_bit(F.col("a.c"))) != 0)
            read = f.join(a, (F.col("f.word") == F.col("a.parent")) & shared).select("a.*", "f.node").alias("r")
            moved = read.join(q, (F.col("r.node") == F.col("q.parent")) & (F.col("r.c") == F.col("q.c")))
            opened = opened.union(states(moved, "r", "q"))
        frontier = materialise(opened, f"spelling-level-{depth}")
        levels.append(frontier)
    ended = [f.where(F.col("low").bitwiseAND(F.lit(END)) != 0).select("word", "node") for f in levels]
    return reduce(DataFrame.union, ended)


PRIMES, BASE = (2147483647, 2147483629), 1000003


def powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def hashes_without(word: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of a word; with a gap at each letter; without each letter that differs from the one before; where."""
    codes = np.array([ord(c) for c in word], np.uint64)
    full, gap, short = 0, np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    for prime in PRIMES:
        m = np.uint64(prime)
        terms = codes * powers(BASE, len(word), prime) % m
        sums = np.cumsum(terms)  # below 2^63 for words of up to four billion letters
        whole = int(sums[-1]) % prime
        rest = (sums[-1] - sums) % m * np.uint64(pow(BASE, -1, prime)) % m
        full = full << 31 | whole
        gap = gap << 31 | ((np.uint64(whole) + m - terms) % m).astype(np.int64)
        short = short << 31 | ((sums - terms + rest) % m).astype(np.int64)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return full, gap, short[first], first


def long_pairs(words: DataFrame) -> DataFrame:
    """word, node: hashes of the words of DEPTH letters or more, one of them longer, that are one edit apart."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, word in zip(b.column("own").to_pylist(), b.column("word").to_pylist(), strict=True):
                n = len(word)
                full, gap, short, _ = hashes_without(word)
                key = np.concatenate([gap, short, [full]])
                # what a key stands for: a gap at a place, one letter less, the word
                place = np.concatenate([np.arange(n), np.full(len(short), -1), [-2]])
                size = np.concatenate([np.full(n, n), np.full(len(short), n - 1), [n]])
                for at in range(0, len(key), 100_000):
                    part = slice(at, at + 100_000)
                    rows = [pa.array(np.full(len(key[part]), own, np.int64)), *(pa.array(x[part].astype(np.int64)) for x in (key, place, size))]
                    yield pa.RecordBatch.from_arrays(rows, ["own", "key", "place", "size"])

    rows = words.select(F.xxhash64("word").alias("own"), "word").mapInArrow(emit, "own long, key long, place long, size long")
    rows = materialise(rows, "spelling-long")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.size") == F.col("b.size"))
    replaced = a.where("place >= 0").join(b.where("place >= 0"), same & (F.col("a.place") == F.col("b.place")) & (F.col("a.own") < F.col("b.own")) & (F.col("a.size") > DEPTH))
    extra = a.where("place = -1").join(b.where("place = -2"), same & (F.col("a.size") >= DEPTH))
    return replaced.union(extra).select(F.col("a.own").alias("word"), F.col("b.own").alias("node"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, near, near_n: both ways, every two words of `vocabulary` (word, n) that are one edit apart."""
    length = F.length("word")
    facts = vocabulary.agg(F.count(F.lit(1)).alias("count"), F.max(F.when(length <= DEPTH, length)).alias("longest"), F.max(length).alias("most")).first()
    named = vocabulary.select(F.xxhash64("word").alias("own"), "word", "n")
    found = []
    if facts["longest"]:
        found.append(trie_pairs(vocabulary.where(length <= DEPTH).select("word"), facts["count"], facts["longest"]))
    if (facts["most"] or 0) > DEPTH:
        found.append(long_pairs(vocabulary.where(length >= DEPTH).select("word")))
    if not found:
        return vocabulary.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = reduce(DataFrame.union, found).alias("p")
    a, b = named.alias("a"), named.alias("b")
    both = pairs.join(a, F.col("p.word") == F.col("a.own")).join(b, F.col("p.node") == F.col("b.own"))
    both = both.where(F.levenshtein("a.word", "b.word", 1) == 1).select(F.col("a.word").alias("x"), F.col("a.n").alias("xn"), F.col("b.word").alias("y"), F.col("b.n").alias("yn"))
    both = materialise(both, "spelling-near")
    there = both.select(F.col("x").alias("word"), F.col("y").alias("near"), F.col("yn").alias("near_n"))
    return there.union(both.select(F.col("y").alias("word"), F.col("x").alias("near"), F.col("xn").alias("near_n")))


def follow(links: DataFrame, rounds: int) -> DataFrame:
    """word, root: the last of the chain that starts with each link (word, form); each round doubles the steps."""
    ways = links.select("word", F.col("form").alias("root"))
    for i in range(rounds):
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ways = materialise(ways.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), f"spelling-roots-{i}")
    return ways


def spelling_groups(docs: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every frequent word of `docs` (doc_id, text)."""
    vocabulary = materialise(count_words(docs).where(F.col("n") >= min_count), "spelling-words")
    most = vocabulary.agg(F.max("n").alias("most")).first()["most"]
    if most is None:
        return vocabulary.select("word", F.col("word").alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.col("n").alias("form_n"))
    near = near_words(vocabulary)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    led = -F.col("best.less") >= ratio * F.col("n")
    words = vocabulary.join(best, "word", "left").select(
        "word",
        F.when(led, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(led, -F.col("best.less")).alias("form_n"),
    )
    words = materialise(words, "spelling-forms")
    steps = max(1, ceil(log(most, ratio)))  # counts rise by the ratio at every step
    roots = follow(words.where("form IS NOT NULL"), ceil(log2(steps)) + 1)
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
