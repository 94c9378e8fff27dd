"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut greedily into phrases,
each the longest that occurs in the language's text; phrases times the bits that name a place in that
text, over the length, estimate the cross entropy, and the language with the least wins (ties: the
first by name). A letter that the text doesn't have is a phrase by itself and takes ESCAPE bits more, as
any letter of Unicode would, so that little text makes a language dear and not cheap. Text is lower-cased,
letters of any script count, all else is one space.

Fitting reads a bounded sample of labelled rows: of each language at most SAMPLE_DOCS texts, picked by a
hash. A text of over LONGEST characters gives PIECES pieces of that length together, spread evenly from its
beginning to its end. The sample of a language doesn't depend on how many others there are; over
MAX_LANGUAGES, and more letters than a number has room for, are refused.

Every fourth text of the sample is not learned but tells the language's usual rate of bits a character; a
language of fewer texts takes the largest rate of the others. `keep_identified` rejects a text that takes
FOREIGN times as many in its best language (with PHRASES phrases left out, so that short texts stay): it is
in no language that was learned.

Predicting reads every whole text. All blocks of BLOCK characters of all texts are parsed side by side,
each as if a phrase began there; then each block that a phrase reaches into is parsed again from the
state in which the block before has ended, until it meets the states of its first parse. So the phrases
are those of the whole text.

Scale: two narrow scans to fit, then a map over the documents; nothing but the sample is shuffled.
The automata are broadcast: about 2 MB a language, whatever the corpus.

Defined results: `und` with score 0 if the text is null or has no letter, or nothing is learned;
rows with null doc_id are training rows; rows with null lang teach nothing; repeated rows get one
answer; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 64
LONGEST = 1_000
PIECES = 4
HELD_BACK = 4
ESCAPE = 20.0
MAX_LANGUAGES = 400
FOREIGN = 2.0
PHRASES = 3
BLOCK = 1024
STRIDE = 64
CHUNK = 1 << 22
ROWS = 4096
UNKNOWN = "und"
_SPACE, _OTHER = 0, 1
_CODE, _STATE = np.uint64(16), np.uint64(24)  # bits of a letter's number and of a state's
_EMPTY = np.uint64((1 << 64) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)), F.lit(-1))


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Moves of each state; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    end = 0
    for c in codes:
        new = len(moves)
        moves.append({})
        longest.append(longest[end] + 1)
        link.append(0)
        at = end
        while at != -1 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at != -1:
            onto = moves[at][c]
            if longest[onto] == longest[at] + 1:
                link[new] = onto
            else:
                copy = len(moves)
                moves.append(dict(moves[onto]))
                longest.append(longest[at] + 1)
                link.append(link[onto])
                link[onto] = link[new] = copy
                while at != -1 and moves[at].get(c) == onto:
                    moves[at][c] = copy
                    at = link[at]
        end = new
    return moves


class Automata:
    """The suffix automata of all languages; their moves are one hash table from (state, letter) to state."""

    def __init__(self, samples: dict[str, str]) -> None:
        if len(samples) > MAX_LANGUAGES:
            raise ValueError(f"at most {MAX_LANGUAGES} languages in one model")
        self.languages = sorted(samples)
        lowered = {lang: samples[lang].lower() for lang in self.languages}
        #: All letters of the samples; a letter that none of them has is a phrase by itself in every language.
        self.letters = sorted({c for t in lowered.values() for c in t if c.isalpha()})
        if len(self.letters) > (1 << int(_CODE)) - 2:
            raise ValueError(f"at most {(1 << int(_CODE)) - 2} different letters in one model")
        self._codes: np.ndarray | None = None
        states, chars, onto, roots, bits, base = [], [], [], [], [], 0
        self.first = np.full((len(self.languages), len(self.letters) + 2), -1, np.int64)
        for k, lang in enumerate(self.languages):
            codes = self.encode(lowered[lang])[0]
            moves = suffix_automaton(codes.tolist())
            counts = [len(m) for m in moves]
            states.append(base + np.repeat(np.arange(len(moves)), counts))
            chars.append(np.fromiter((c for m in moves for c in m), np.int64, sum(counts)))
            onto.append(base + np.fromiter((t for m in moves for t in m.values()), np.int64, sum(counts)))
            for c, to in moves[0].items():
                self.first[k, c] = base + to
            roots.append(base)
            bits.append(np.log2(max(2, len(codes))))
            base += len(moves)
        if base >= 1 << int(_STATE):
            raise ValueError("the samples are too long for one model")
        self.roots, self.bits = np.array(roots, np.int64), np.array(bits)
        self.usual = np.full(len(self.languages), np.inf)
        if self.languages:
            self._store(*(np.concatenate(x).astype(np.uint64) for x in (states, chars, onto)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_codes": None}

    def _store(self, state: np.ndarray, char: np.ndarray, onto: np.ndarray) -> None:
        """Open addressing with room for four times the moves: each slot holds state, letter and next state."""
        entry = (((state << _CODE) | char) << _STATE) | onto
        size = int(4 * len(entry) + 2).bit_length()
        self.shift, self.mask = np.uint64(64 - size), (1 << size) - 1
        self.slots = np.full(1 << size, _EMPTY)
        slot = (((entry >> _STATE) * _MIX) >> self.shift).astype(np.int64)
        while len(entry):
            free = np.flatnonzero(self.slots[slot] == _EMPTY)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.slots[slot[won]] = entry[won]
            left = np.ones(len(entry), bool)
            left[won] = False
            entry, slot = entry[left], (slot[left] + 1) & self.mask

    def _move(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where there is one."""
        key = (state << _CODE) | char
        slot = ((key * _MIX) >> self.shift).view(np.int64)
        entry = self.slots[slot]
        hit = (entry >> _STATE) == key
        at = np.flatnonzero(~hit & (entry != _EMPTY))
        while len(at):
            slot[at] = (slot[at] + 1) & self.mask
            held = self.slots[slot[at]]
            same = (held >> _STATE) == key[at]
            entry[at], hit[at] = held, same
            at = at[~same & (held != _EMPTY)]
        return entry & np.uint64((1 << int(_STATE)) - 1), hit

    def encode(self, text: str) -> tuple[np.ndarray, bool]:
        """Letters' numbers with runs of other than letters as one space, and whether there is a letter."""
        if self._codes is None:
            letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
            self._codes = np.where(letter, _OTHER, _SPACE).astype(np.uint16)
            self._codes[[ord(c) for c in self.letters]] = np.arange(len(self.letters)) + 2
        codes = self._codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        space = codes == _SPACE
        keep = np.ones(len(codes), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        return codes[keep], not space.all()

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(languages, texts) numbers of phrases."""
        many = len(self.languages)
        owner, begin, length = [], [], []
        at = 0
        for k, t in enumerate(texts):
            starts = range(0, len(t), BLOCK)
            owner += [k] * len(starts)
            begin += [at + s for s in starts]
            length += [min(BLOCK, len(t) - s) for s in starts]
            at += len(t)
        if not owner:
            return np.zeros((many, len(texts)), np.int64)
        # a lane is a block in a language: lane = block * many + language
        lanes = _Lanes(np.append(np.concatenate(texts), np.zeros(STRIDE, np.uint16)), np.repeat(begin, many), np.repeat(length, many), np.tile(self.roots, len(owner)))
        owner = np.array(owner)
        again = np.repeat(np.append(False, owner[1:] == owner[:-1]), many)
        self._parse(lanes, np.arange(len(lanes.root)), False)
        lane = np.flatnonzero(again)
        lanes.enter[lane] = lanes.final[lane - many]
        lane = lane[lanes.enter[lane] != lanes.root[lane]]
        follows = np.append(again[many:], np.zeros(many, bool))
        while len(lane):
            lane = self._parse(lanes, lane, True)
            lane = lane[follows[lane]]
            lanes.enter[lane + many] = lanes.final[lane]
            lane = lane + many
        # a phrase that the text's end cuts counts as well
        counts = lanes.total + (~follows & (lanes.final != lanes.root))
        return np.stack([np.bincount(owner, weights=counts[k::many], minlength=len(texts)) for k in range(many)]).astype(np.int64)

    def _parse(self, lanes: _Lanes, lane: np.ndarray, known: bool) -> np.ndarray:
        """Parse some lanes from the states in which they are entered; returns those whose last state is another than before.

        `known`: they were parsed before; one that meets its former state at a stop goes on as it did then.
        """
        lane = lane[np.argsort(-lanes.length[lane], kind="stable")]
        asked, length, begin, root = lane, lanes.length[lane], lanes.begin[lane], lanes.root[lane].astype(np.uint64)
        state, ended = lanes.enter[lane].astype(np.uint64), np.zeros(len(lane), np.int32)
        first, width = self.first.ravel(), self.first.shape[1]
        offset = (lane % len(self.languages)) * width
        stop = 0
        while len(lane):
            steps = np.arange(stop * STRIDE, min((stop + 1) * STRIDE, length[0]))
            chars = np.ascontiguousarray(lanes.flat[begin[:, None] + steps].T)
            for char, k in zip(chars, np.searchsorted(-length, -steps, "left"), strict=True):
                here, char = state[:k], char[:k]
                onto, hit = self._move(here, char)
                if len(failed := np.flatnonzero(~hit)):
                    # the phrase ends and the next begins; a letter that is nowhere is a phrase by itself
                    inside = here[failed] != root[failed]
                    start = first[offset[failed] + char[failed]]
                    nowhere = start < 0
                    ended[failed] += inside.astype(np.int32) + nowhere
                    onto[failed] = np.where(nowhere, root[failed], start)
                state[:k] = onto
            k = np.searchsorted(-length, -stop * STRIDE, "left")
            done = length <= (stop + 1) * STRIDE
            if known:
                met = np.zeros(len(lane), bool)
                met[:k] = lanes.states[stop, lane[:k]] == state[:k]
                at = lane[met]
                more = ended[met] - lanes.ended[stop, at]
                lanes.total[at] += more
                lanes.ended[stop:, at] += more
            else:
                met = np.zeros(len(lane), bool)
            lanes.states[stop, lane[~met]], lanes.ended[stop, lane[~met]] = state[~met], ended[~met]
            over = done & ~met
            lanes.final[lane[over]], lanes.total[lane[over]] = state[over], ended[over]
            lanes.changed[lane[met]], lanes.changed[lane[over]] = False, True
            stay = ~(met | done)
            lane, length, begin, root, state, ended, offset = (x[stay] for x in (lane, length, begin, root, state, ended, offset))
            stop += 1
        return asked[lanes.changed[asked]]

    def costs(self, coded: list[np.ndarray]) -> np.ndarray:
        """(languages, texts) bits that the texts take."""
        parts, some, held = [np.zeros((len(self.languages), 0), np.int64)], [], 0
        for codes in coded:
            some.append(codes)
            held += len(codes)
            if held >= CHUNK:
                parts.append(self.phrases(some))
                some, held = [], 0
        if some:
            parts.append(self.phrases(some))
        return np.concatenate(parts, axis=1) * self.bits[:, None] + ESCAPE * self.unknown(coded)

    def unknown(self, coded: list[np.ndarray]) -> np.ndarray:
        """(languages, texts) numbers of letters that the language's sample doesn't hold."""
        absent = (self.first < 0).astype(np.float64)
        counts = [np.bincount(c, minlength=absent.shape[1]) for c in coded]
        return absent @ np.array(counts, np.float64).reshape(len(coded), -1).T if counts else np.zeros((len(absent), 0))

    def calibrate(self, others: dict[str, list[str]]) -> None:
        """Learn the usual bits a character from labelled texts that the automata do not hold."""
        for k, lang in enumerate(self.languages):
            coded = [self.encode(t)[0] for t in others.get(lang, [])]
            if chars := sum(map(len, coded)):
                self.usual[k] = self.costs(coded)[k].sum() / chars
        if (known := np.isfinite(self.usual)).any():
            self.usual[~known] = self.usual[known].max()

    def measure(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Of each text the language, its score, and whether it is as that language's texts are."""
        coded = [self.encode(t or "") for t in texts]
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [has for _, has in coded]
        bits = self.costs([c for c, _ in coded])
        best, least = bits.argmin(axis=0), bits.min(axis=0)
        share = 1 / np.exp2(np.minimum(0, least - bits)).sum(axis=0)
        chars = np.array([len(c) for c, _ in coded])
        alike = least - PHRASES * (self.bits[best] + ESCAPE) <= FOREIGN * self.usual[best] * np.maximum(chars, 1)
        lang = [self.languages[b] if has else UNKNOWN for b, (_, has) in zip(best, coded, strict=True)]
        score = [float(s) if has else 0.0 for s, (_, has) in zip(share, coded, strict=True)]
        return lang, score, [bool(a) and has for a, (_, has) in zip(alike, coded, strict=True)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.measure(texts)[:2]


class _Lanes:
    """Blocks of text under parsing, with the states at every STRIDE characters."""

    def __init__(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray, root: np.ndarray) -> None:
        self.flat, self.begin, self.length, self.root = flat, begin, length, root  # flat: with STRIDE more at the end
        self.enter, self.final, self.total = root.copy(), root.copy(), np.zeros(len(root), np.int32)
        self.changed = np.zeros(len(root), bool)
        stops = -(-int(length.max()) // STRIDE)
        self.states, self.ended = (np.full((stops, len(root)), -1, np.int32) for _ in range(2))


def spread(text: Column, longest: int = LONGEST) -> Column:
    """The text, or of a long one PIECES pieces of `longest` characters together, from its beginning to its end."""
    n, piece = F.char_length(text), longest // PIECES
    starts = [F.floor((n - piece) * i / (PIECES - 1)).cast("int") + 1 for i in range(PIECES)]
    return F.when(n > longest, F.concat_ws(" ", *(F.substr(text, at, F.lit(piece)) for at in starts))).otherwise(text)


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Automata:
    """Automata of all languages of `labelled` (doc_id, text, lang)."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return Automata({})
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"at most {MAX_LANGUAGES} languages in one model")
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4.0 * sample_docs / n))))
    order = F.xxhash64(F.col("doc_id").cast("string"), "text")
    picked = rows.where(F.pmod(order, F.lit(1_000_000_000)) / 1e9 < share[F.col("lang")])
    picked = picked.select("lang", order.alias("place"), spread(F.col("text")).alias("text"))
    by = Window.partitionBy("lang").orderBy("place", "text")
    texts: dict[str, list] = {lang: [] for lang in counts}
    for r in picked.withColumn("k", F.row_number().over(by)).where(F.col("k") <= sample_docs).collect():
        texts[r["lang"]].append((r["k"], r["text"]))
    model = Automata({lang: " ".join(t for k, t in sorted(some) if k % HELD_BACK) for lang, some in texts.items()})
    model.calibrate({lang: [t for k, t in sorted(some) if k % HELD_BACK == 0] for lang, some in texts.items()})
    return model


def keep_identified(docs: DataFrame, model: Automata) -> DataFrame:
    """The rows of `docs`, whole, whose text is in a learned language: `und` and foreign texts go.

    A model that has learned nothing can't tell languages: then all texts with a letter stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                yield some.filter(pa.array(own.measure(some.column("text").to_pylist())[2], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)


def identify(docs: DataFrame, model: Automata) -> DataFrame:
    """doc_id, lang_pred, score for every row of `docs` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                lang, score = own.predict(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(each, "doc_id long, lang_pred string, score double")
