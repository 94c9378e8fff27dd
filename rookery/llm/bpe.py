"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

The exact encoding of a text's prefix ends in one certain token, and that token is all that has to be
stored: of the vocabulary tokens that are suffixes of the prefix, it is the one that is compatible
with the last token of the prefix before it. An automaton of the vocabulary with suffix links lists
those tokens at every position in one pass; two tokens are compatible if no merge across their
boundary comes before the merges that build them up. Following the stored tokens back from the end
gives exactly the ids that merging in rank order gives.

The text is first cut by the vocabulary's splitting pattern, so prefixes are those of words; each
worker keeps the encodings of the chunks and words met lately, and the results of compatibility tests,
in caches of at most twice CACHE_CHUNKS, CACHE_WORDS and CACHE_PAIRS entries.

Scale: a map over the documents; nothing is shuffled. Memory is bounded by the caches, the automaton
and one document.

Defined results: a null text counts as empty and has no ids; a special token's string in a text is
that token; repeated rows are encoded alike; decoding gives the text back; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import byte_letters

CACHE_CHUNKS = 100_000
CACHE_WORDS = 200_000
CACHE_PAIRS = 250_000
#: Unicode white space, and the splitting pattern of the vocabulary with it.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NEVER = 1 << 40


class Recent(dict):
    """What was put in or asked for lately: at most twice `limit` entries, in two generations."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.older: dict = {}

    def find(self, key):
        """The value, also if it is of the older generation; None if there is none."""
        value = self.get(key)
        if value is None and (value := self.older.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value


class PrefixEncoder:
    """Encoder and decoder for a vocabulary file whose merged tokens each come from one merge."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        byte_of = {letter: b for b, letter in byte_letters().items()}
        raw = {t: bytes(byte_of[c] for c in t) for t in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: raw[t] for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = rank
            self.parts[ids[a + b]] = (ids[a], ids[b], rank)
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(raw[t].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN)
        # a chunk is an optional space and what follows up to the next one, or space alone: the pattern never crosses it
        self.chunk = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.length_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.spines: dict[int, list[tuple[int, int]]] = {}
        self.pairs = Recent(CACHE_PAIRS)
        self.words = Recent(CACHE_WORDS)
        self.chunks = Recent(CACHE_CHUNKS)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank at which the part above takes it up) along one side, from the byte to the whole."""
        key = 2 * token + side
        if key not in self.spines:
            out, taken = [], NEVER
            while token in self.parts:
                out.append((token, taken))
                token, taken = self.parts[token][side], self.parts[token][2]
            out.append((token, taken))
            self.spines[key] = out[::-1]
        return self.spines[key]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of a and b is a and b."""
        right, left, merges = self._spine(a, 1), self._spine(b, 0), self.merges
        i = j = 0
        while True:
            (x, x_taken), (y, y_taken) = right[i], left[j]
            rank = merges.get((x, y))
            # of equal merges the one further left is done first
            if rank is not None and rank < x_taken and rank <= y_taken:
                return False
            if x_taken == NEVER and y_taken == NEVER:
                return True
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1

    def word(self, word: str) -> bytes:
        """Ids of one word: the last token of every prefix, then back from the end."""
        text = word if word.isascii() else word.encode().decode("latin-1")
        last = [-1] * (len(text) + 1)
        pairs, length_of = self.pairs, self.length_of
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length_of[token]
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 20 | token
                good = pairs.get(key)
                if good is None and (good := pairs.find(key)) is None:
                    good = self.compatible(before, token)
                    pairs.put(key, good)
                if not good:
                    continue
            last[end] = token
        at, out = len(text), []
        while at:
            out.append(last[at])
            at -= length_of[last[at]]
        out.reverse()
        return array("i", out).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for w in self.split.findall(chunk):
            ids = self.words.find(w)
            if ids is None:
                ids = self.word(w)
                self.words.put(w, ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit numbers."""
        out = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
                continue
            chunks = self.chunks
            for c in self.chunk.findall(part):
                ids = chunks.get(c)
                if ids is None and (ids := chunks.find(c)) is None:
                    ids = self._chunk(c)
                    chunks.put(c, ids)
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("i", ids))).decode("utf-8", "replace")


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The worker's encoder of a file; its caches live from task to task."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def encode_and_decode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, ids array<int>, decoded for every row of `docs` (doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_file)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                ids = [own.encode(t) for t in some.column("text").to_pylist()]
                ends = np.cumsum([0] + [len(i) // 4 for i in ids]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists, pa.array(map(own.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(each, "doc_id long, ids array<int>, decoded string")
