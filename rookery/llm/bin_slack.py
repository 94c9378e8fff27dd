"""Packing documents into token sequences by minimum bin slack, with no padding left.

A document becomes token ids and an end token. What it has beyond whole sequences is a piece, and
pieces gather in a pool. Each window (a sequence still to be filled) takes the multiset of the pool's
lengths whose sum comes closest to the capacity: the sums that can be reached are the bits of one
number, every length and count shifts it, and going back over the numbers before each shift gives the
counts that were used. The largest pieces are tried first as the one that a window must hold. While
the pool is refilled nearly every window closes without slack; where none does, the largest piece left
is cut to fill it. What a task has left in the end goes into sequences of powers of two, which are not
padded. So documents of more than a sequence are cut, and a few others in each task.

Scale: a map over the documents; nothing is shuffled, written between or planned on the driver. A task
holds at most POOL tokens of pieces, one batch of texts and one document. Sequences never reach over
tasks, and their numbers carry the task's, so that a task that is run again gives the same rows.

Defined results: a null text counts as empty and is one piece of the end token; repeated rows and null
doc_ids are packed like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN
from .packing import END_ID, byte_letters

CAPACITY = 2048
#: Tokens of pieces that wait for a window; half of them are packed before more are read.
POOL = 1 << 19
#: Largest lengths that are tried as the one that a window must hold.
TRIED = 8
#: Anything but these characters sends a text to the vocabulary's own library.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
#: So does a run of so many characters, which pair merging in another library may not bear.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


class ByteEncoder:
    """Ids of whole texts by a byte-level vocabulary file.

    Ordinary texts are merged by rank with tiktoken, whose ranks are the file's ids where each token
    comes from one merge in order of ids; other texts and files go to the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ids, special = spec["model"]["vocab"], set(self.special)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        made = [ids[a + b] for a, b in pairs]
        byte_of = {letter: b for b, letter in byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in ids.items() if t not in special}
        ordered = made == sorted(set(made)) and len(ranks) == len(made) + 256
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        plain = self.merge and not (UNUSUAL.search(text) or LONG_RUN.search(text) or any(t in text for t in self.special))
        ids = self.merge.encode_ordinary(text) if plain else self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()


def closest(sizes: list[int], counts: dict[int, int], target: int) -> dict[int, int]:
    """How many of each length give the sum closest to `target` from below; of equal sums, one of large lengths."""
    reach, mask, shifts = 1, (2 << target) - 1, []
    for w in reversed(sizes[: bisect_right(sizes, target)]):
        left, some = min(counts[w], target // w), 1
        while left > 0:  # counts in powers of two: all multiples up to the whole are sums of them
            some = min(some, left)
            more = (reach | reach << w * some) & mask
            if more != reach:
                shifts.append((w, some, reach))
                reach = more
            left -= some
            some *= 2
        if reach >> target & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for w, some, before in reversed(shifts):
        if not before >> at & 1:
            used[w] = used.get(w, 0) + some
            at -= w * some
    return used


class Pool:
    """Pieces by length, and the windows that they fill."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.sizes: list[int] = []
        self.counts: dict[int, int] = {}
        self.pieces: dict[int, list[tuple]] = {}
        self.tokens = 0

    def put(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int) -> None:
        w = len(ids) // 4
        if not self.counts.get(w):
            insort(self.sizes, w)
            self.pieces.setdefault(w, [])
        self.counts[w] = self.counts.get(w, 0) + 1
        self.pieces[w].append((doc_id, start, ids, doc_tokens))
        self.tokens += w

    def _take(self, w: int) -> tuple:
        self.counts[w] -= 1
        self.tokens -= w
        if not self.counts[w]:
            del self.counts[w], self.sizes[bisect_right(self.sizes, w) - 1]
        return self.pieces[w].pop()

    def _choice(self, target: int) -> dict[int, int]:
        """The multiset of lengths for a window: without slack if one is found, else that of the largest length."""
        first: dict[int, int] = {}
        for w in self.sizes[-TRIED:][::-1]:
            if w > target:
                continue
            self.counts[w] -= 1
            used = closest(self.sizes, self.counts, target - w)
            self.counts[w] += 1
            used[w] = used.get(w, 0) + 1
            if sum(k * n for k, n in used.items()) == target:
                return used
            first = first or used
        used = closest(self.sizes, self.counts, target)
        return used if sum(k * n for k, n in used.items()) == target else first or used

    def window(self) -> list[tuple]:
        """Pieces of the next sequence: it is full, or of a power of two where less than a sequence is left."""
        target = self.capacity if self.tokens >= self.capacity else 1 << self.tokens.bit_length() - 1
        out = [self._take(w) for w, n in sorted(self._choice(target).items(), reverse=True) for _ in range(n)]
        if slack := target - sum(len(p[2]) // 4 for p in out):
            doc_id, start, ids, doc_tokens = self._take(self.sizes[-1])
            out.append((doc_id, start, ids[: 4 * slack], doc_tokens))
            self.put(doc_id, start + slack, ids[4 * slack :], doc_tokens)
        return out


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def pack_windows(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset for every piece of `docs` (doc_id, text).

    `ids` are little-endian unsigned 32-bit numbers. `capacity` is at least 1.
    """
    end = array("I", [END_ID]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, pool = ByteEncoder(tokenizer_file), Pool(capacity)
        number = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def send() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)
            out.clear()
            return rows

        def close(pieces: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, ids, doc_tokens in pieces:
                length = len(ids) // 4
                out.append((doc_id, start, length, ids, doc_tokens, number, offset))
                offset += length
            number += 1

        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    ids = encoder.encode(text) + end
                    doc_tokens = len(ids) // 4
                    whole = doc_tokens - doc_tokens % capacity
                    for start in range(0, whole, capacity):
                        close([(doc_id, start, ids[4 * start : 4 * (start + capacity)], doc_tokens)])
                    if whole < doc_tokens:
                        pool.put(doc_id, whole, ids[4 * whole :], doc_tokens)
                if pool.tokens >= POOL:
                    while pool.tokens > POOL // 2:
                        close(pool.window())
                if out:
                    yield send()
        while pool.tokens:
            close(pool.window())
            if len(out) >= 4096:
                yield send()
        if out:
            yield send()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
