"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Documents become token ids and pieces of at most `capacity` tokens. Packing needs only how many pieces
have each length: a histogram of at most `capacity` entries, whatever the corpus. On it, sets that
provably dominate every alternative for one of their members are fixed for good (a piece that fits
nothing; two that fill a sequence exactly; the largest partner where no better set is possible), the
rest is packed best-fit decreasing, many equal sequences at a time. The plan is a list of patterns
with multiplicities; a piece finds its sequence and offset from its length and its rank among the
pieces of that length.

Scale: encoding is a map over the documents, written once with block and rank inside the block;
ranks over all blocks come from a prefix sum over one row a block and length, so no task sees all
pieces of a common length. The plan's size depends on the capacity and not on the corpus, and it is
what tasks receive.

Defined results: a null text counts as empty and is one piece of the end token; repeated rows and
null doc_ids are packed like any other; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

CAPACITY = 4096
END_ID = 1
CACHE = 300_000
#: Anything but these characters, or the start of a special token, sends a text to the library whole.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]|<\\|")
#: The file's own splitting rule, as it reads for the characters above.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as, by code point."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class TextEncoder:
    """Ids of whole texts by a tokenizer file whose words never reach over white space.

    White-space-delimited chunks are lower-cased, split into words and encoded by the library's model;
    chunks and words are kept in caches of at most `cache` entries. Texts with unusual characters go
    to the library as they are.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.limit = cache

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(self.words) >= self.limit:
            self.words.clear()
        self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        known = self.words
        return b"".join([known.get(w) or self._word(w) for w in WORD.findall(chunk.lower())])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        out = []
        for t in texts:
            if UNUSUAL.search(t):
                out.append(array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
                continue
            parts, known = t.split(), self.chunks
            for c in parts:
                if c not in known:
                    if len(known) >= self.limit:
                        self.chunks = known = {p: known[p] for p in parts if p in known}
                    known[c] = self._chunk(c)
            out.append(b"".join(map(known.__getitem__, parts)))
        return out


def cut_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and (block, rank): its place among the block's pieces of that length."""
    end = array("I", [END_ID]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, encoder, seen = TaskContext.get().partitionId(), TextEncoder(tokenizer_file), Counter()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                out: list[tuple] = []
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text").to_pylist()), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        length = len(part) // 4
                        out.append((doc_id, piece, start, length, zlib.crc32(part), block, seen[length]))
                        seen[length] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "rank"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, block long, rank long")


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Sequences that some optimal packing has, as (how many, lengths), and the counts that are left."""
    left, fixed = {k: n for k, n in counts.items() if n > 0}, []

    def fix(n: int, lengths: tuple[int, ...]) -> None:
        fixed.append((n, lengths))
        for w in lengths:
            left[w] -= n
            if not left[w]:
                del left[w]

    changed = True
    while changed:
        changed = False
        sizes = sorted(left)
        for w in reversed(sizes):
            while n := left.get(w, 0):
                room = capacity - w
                small = _smallest(sizes, left, w)
                if not small or small[0] > room:
                    fix(n, (w,))
                    changed = True
                    break
                if (m := left.get(room, 0)) and (room != w or n > 1):
                    fix(n // 2 if room == w else min(n, m), (w, room))
                    changed = True
                    continue
                if len(small) > 1 and small[0] + small[1] <= room:
                    break
                # only one more piece fits: the largest that does dominates the others
                partner = _largest(sizes, left, room, w)
                fix(left[w] // 2 if partner == w else min(n, left[partner]), (w, partner))
                changed = True
    return fixed, left


def _smallest(sizes: list[int], left: dict[int, int], w: int) -> list[int]:
    """The two smallest pieces besides one of length w."""
    out: list[int] = []
    for s in sizes:
        out += [s] * min(2, left.get(s, 0) - (s == w))
        if len(out) >= 2:
            break
    return out


def _largest(sizes: list[int], left: dict[int, int], room: int, w: int) -> int:
    at = bisect_left(sizes, room + 1) - 1
    while left.get(sizes[at], 0) - (sizes[at] == w) < 1:
        at -= 1
    return sizes[at]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on a histogram; equal sequences are filled together."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    full: list[tuple[int, tuple[int, ...]]] = []

    def put(n: int, lengths: tuple[int, ...], room: int) -> None:
        if room == 0:
            full.append((n, lengths))
            return
        if not groups[room]:
            insort(rooms, room)
        groups[room].append((n, lengths))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                m, lengths = groups[room].pop()
                if not groups[room]:
                    del rooms[at]
            else:
                room, m, lengths = capacity, n, ()
            each = room // w
            whole = min(m, n // each)
            if whole:
                put(whole, lengths + (w,) * each, room - each * w)
                n -= whole * each
                m -= whole
            if m and 0 < n < each:
                put(1, lengths + (w,) * n, room - n * w)
                n, m = 0, m - 1
            if m and lengths:
                put(m, lengths, room)
    return full + [g for room in rooms for g in groups[room]]


def plan_slots(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: where runs of equal pieces go."""
    fixed, left = reduce_dominated(counts, capacity)
    rank: Counter = Counter()
    rows, base = [], 0
    for n, lengths in fixed + best_fit(left, capacity):
        offset = 0
        for w in lengths:
            rows.append((w, rank[w], base, offset))
            rank[w] += n
            offset += w
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, tokenizer_file, capacity), "packing-pieces")
    sizes = materialise(pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n")), "packing-sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(plan_slots(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("block", "length", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["block", "length"]).withColumn("rank", F.col("rank") + F.col("first")).drop("block", "first")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        starts = (table[:, 0] << 48) + table[:, 1]
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(starts, (b.column("length").to_numpy() << 48) + rank, "right") - 1
            sequence = table[at, 2] + rank - table[at, 1]
            columns = [b.column(c) for c in names] + [pa.array(sequence), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
