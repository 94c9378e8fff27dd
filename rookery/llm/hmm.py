"""A hidden Markov language model: Baum-Welch over all training documents, exact likelihood of texts.

Tokens are white-space-delimited words with A-Z lower-cased, then one end token. Frequent words (about
VOCABULARY) are symbols of their own; the others share SUFFIX_CLASSES symbols by a hash of their last
bytes, so that a word never seen still says something. Within such a class a word's probability is its
share of the class, and Good-Turing's share (words seen once over tokens) goes to the one event that the
word is unseen. So probabilities over known words and the unseen events sum to one.

Training: expected counts of Baum-Welch over the training documents of each partition, summed by
symbol over partitions; PASSES rounds, each of which reports the log-likelihood of the training
documents (`Model.history`). Training and scoring run over whole documents, so a start is a document's
first token.

Scale: word counts are aggregated from per-task counts; only the KNOWN most frequent words and the class
sums (both bounded) reach the driver, and the model, whose size is bounded by the symbols, is what tasks
receive. Counts of the other words meet their documents in a join; what is in it is rarer than KNOWN
other words, AQE splits a key that is hot all the same. Encoded documents are written once, two bytes a
token.

Defined results: a null text counts as empty: one end token; rows with null doc_id are training rows;
repeated rows count as often as they occur and score alike; with no training rows every word is
unseen and nothing is known; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

VOCABULARY = 40_000
KNOWN = 250_000
SUFFIX_CLASSES = 4096
SUFFIX_BYTES = 4
STATES = 8
PASSES = 6
TOKENS = 1 << 19
PRIOR = 50.0


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX_BYTES:]) % SUFFIX_CLASSES


@dataclass
class Model:
    """start (K), move (K, K), emit (symbols, K): symbol 0 is the end, then the suffix classes, then frequent words."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    #: log10 likelihood of the training documents before each pass
    history: list[float] = field(default_factory=list)

    @staticmethod
    def begin(share: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
        """Sticky moves, and the symbols' shares disturbed by chance."""
        rng = np.random.default_rng(seed)
        emit = share[:, None] * rng.gamma(1.0, 1.0, (len(share), states))
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def again(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
        """The model of the expected counts; unseen events lean on the symbols' shares."""
        states = len(start)
        emit = emit + PRIOR * share[:, None]
        move = move + 1.0
        return Model((start + 1) / (start.sum() + states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class _Steps:
    """Some sequences side by side, longest first: the symbols in the order of their place in a sequence."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        self.offset = np.append(0, np.cumsum(self.active))
        # of each token its place in the sequence and its sequence
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        lane = np.repeat(np.arange(len(lengths)), lengths)
        self.symbols, self.lane = np.zeros(len(at), np.uint16), np.zeros(len(at), np.int64)
        place = self.offset[at] + lane
        self.symbols[place], self.lane[place] = np.concatenate([sequences[i] for i in self.order]), lane

    def forward(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward variables of every token, and the scales, whose product is the likelihood."""
        alpha = np.empty_like(emit)
        scale = np.empty(len(emit), emit.dtype)
        o = self.offset.tolist()
        for t, k in enumerate(self.active.tolist()):
            here = slice(o[t], o[t] + k)
            a = emit[here] * (start if t == 0 else alpha[o[t - 1] : o[t - 1] + k] @ move)
            c = scale[here] = a.sum(axis=1)
            np.divide(a, c[:, None], out=alpha[here])
        return alpha, scale


def in_steps(sequences: list[np.ndarray], most: int = TOKENS) -> Iterator[np.ndarray]:
    """Numbers of the sequences, longest first, in parts of about `most` tokens."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    part = np.cumsum(lengths[order]) // most
    yield from np.split(order, np.flatnonzero(np.diff(part)) + 1)


def expected_counts(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch's expected starts, moves and emissions over some sequences of symbols, and their log10 likelihood."""
    states = len(model.start)
    steps = _Steps(sequences)
    move = model.move.astype(np.float32)
    emit = model.emit.astype(np.float32)[steps.symbols]
    alpha, scale = steps.forward(model.start.astype(np.float32), move, emit)
    # what a token and all after it say about the state before; made in place of the emissions
    ahead = np.divide(emit, scale[:, None], out=emit)
    beta = np.ones_like(alpha)
    o, active, back = steps.offset.tolist(), steps.active.tolist(), np.ascontiguousarray(move.T)
    for t in range(len(active) - 2, -1, -1):
        m = active[t + 1]
        after = slice(o[t + 1], o[t + 1] + m)
        ahead[after] *= beta[after]
        np.matmul(ahead[after], back, out=beta[o[t] : o[t] + m])
    first = active[0]
    before = np.arange(first, len(alpha)) - np.repeat(steps.active[:-1], steps.active[1:])
    moves = (alpha[before].T @ ahead[first:]).astype(np.float64) * model.move
    beta *= alpha
    emits = np.stack([np.bincount(steps.symbols, weights=beta[:, s], minlength=len(model.emit)) for s in range(states)], axis=1)
    return beta[:first].sum(axis=0, dtype=np.float64), moves, emits, float(np.log10(scale, dtype=np.float64).sum())


def log10_likelihood(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Exact log10 probability of each sequence, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    for some in in_steps(sequences):
        steps = _Steps([sequences[i] for i in some])
        _, scale = steps.forward(model.start, model.move, model.emit[steps.symbols])
        out[some[steps.order]] = np.bincount(steps.lane, weights=np.log10(scale), minlength=len(some))
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), c: how often each word occurs in `docs` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for b in batches:
            for text in b.column("text").cast(pa.binary()).to_pylist():
                seen.update(tokens(text))
                if len(seen) > 300_000:
                    yield rows()
        yield rows()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What scoring needs of the training counts besides the counts of the words that are not known here.

    `words` numbers the known words by falling count, `counts` and `symbol` go with them: the first are
    symbols of their own, the others have the symbol of their class.
    """

    words: dict[bytes, int]
    counts: np.ndarray
    symbol: np.ndarray
    share: np.ndarray
    class_total: np.ndarray
    class_unseen: np.ndarray
    least: int
    train_tokens: int
    distinct: int
    ends: int

    @property
    def class_rest(self) -> np.ndarray:
        """log10 of a seen word's share of its class for each time that it occurs."""
        return np.log10(np.maximum(1 - self.class_unseen, 1e-300) / np.maximum(self.class_total, 1))

    @property
    def base_rest(self) -> float:
        return float(np.log10(self.train_tokens + 0.5 * (self.distinct + 1)))


def _class_column() -> Column:
    size = F.octet_length("word")
    tail = F.when(size <= SUFFIX_BYTES, F.col("word")).otherwise(F.substring("word", size - SUFFIX_BYTES + 1, F.lit(SUFFIX_BYTES)))
    return (F.crc32(tail) % SUFFIX_CLASSES).cast("int")


def lexicon(counts: DataFrame, ends: int, vocabulary: int = VOCABULARY, known: int = KNOWN) -> Lexicon:
    """From word counts (word, c) and the number of training documents.

    The words that are symbols are those of at least the least count that no more than `vocabulary` words
    have, the known ones likewise.
    """
    steps = counts.groupBy(F.floor(20 * F.log(F.col("c"))).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"), F.sum("c").alias("sum"))
    frequent, least, held, total, distinct = 1 << 62, 1 << 62, 0, 0, 0
    for r in sorted(steps.collect(), key=lambda r: -r["step"]):
        held += r["n"]
        total, distinct = total + r["sum"], distinct + r["n"]
        frequent = r["c"] if held <= vocabulary else frequent
        least = r["c"] if held <= max(vocabulary, known) else least
    found = counts.where(F.col("c") >= least).select("word", "c").toArrow()
    words, numbers = found.column("word").to_pylist(), found.column("c").to_numpy().astype(np.int64)
    order = sorted(range(len(words)), key=lambda i: (-numbers[i], words[i]))
    words, numbers = [words[i] for i in order], numbers[order]
    own = int((numbers >= frequent).sum())
    once = F.sum((F.col("c") == 1).cast("long"))
    class_total, class_once = np.zeros(SUFFIX_CLASSES, np.int64), np.zeros(SUFFIX_CLASSES, np.int64)
    for r in counts.where(F.col("c") < frequent).groupBy(_class_column().alias("k")).agg(F.sum("c").alias("c"), once.alias("once")).collect():
        class_total[r["k"]], class_once[r["k"]] = r["c"], r["once"]
    symbol = np.concatenate([1 + SUFFIX_CLASSES + np.arange(own), np.array([1 + suffix_class(w) for w in words[own:]], np.int64)])
    share = np.concatenate([[ends], class_total, numbers[:own]]) + 0.5
    unseen = np.where(class_total > 0, (class_once + 0.5) / (class_total + 1), 1.0)
    numbered = {w: i for i, w in enumerate(words)}
    return Lexicon(numbered, numbers, symbol.astype(np.uint16), share / share.sum(), class_total, unseen, int(least), total + ends, distinct + (ends > 0), ends)


def encode(docs: DataFrame, lexicon_of) -> DataFrame:
    """The symbols of each document, two bytes each, with the sums over its known words.

    `base`: log10(c + 0.5) of known words and the end; `inside`: log10 of their probability within their classes.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon_of.value
        get = lex.words.get
        log_counts = np.log10(lex.counts + 0.5)
        classed = lex.symbol <= SUFFIX_CLASSES
        within = np.where(classed, np.log10(np.maximum(lex.counts, 1)) + lex.class_rest[np.where(classed, lex.symbol, 1).astype(np.int64) - 1], 0.0)
        end = float(np.log10(lex.ends + 0.5))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                out = []
                for text in some.column("text").cast(pa.binary()).to_pylist():
                    words = tokens(text)
                    number = np.array([get(w, -1) for w in words], np.int64)
                    ids = np.zeros(len(words) + 1, np.uint16)
                    known = number >= 0
                    ids[:-1][known] = lex.symbol[number[known]]
                    for i in np.flatnonzero(~known).tolist():
                        ids[i] = 1 + suffix_class(words[i])
                    number = number[known]
                    out.append((len(ids), len(number), float(log_counts[number].sum()) + end, float(within[number].sum()), ids.tobytes()))
                n, known, base, inside, symbols = zip(*out, strict=True)
                given = [some.column(c) for c in ("doc_id", "copy", "held_out")]
                made = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(inside, pa.float64()), pa.array(symbols, pa.binary())]
                yield pa.RecordBatch.from_arrays(given + made, ["doc_id", "copy", "held_out", "n_tokens", "known", "base", "inside", "symbols"])

    schema = "doc_id long, copy long, held_out boolean, n_tokens long, known long, base double, inside double, symbols binary"
    return docs.mapInArrow(each, schema)


def train(encoded: DataFrame, lex: Lexicon, states: int = STATES, passes: int = PASSES) -> Model:
    """Baum-Welch over the rows of `encoded` that are not held out; the model's history has a likelihood for each pass."""
    spark = encoded.sparkSession
    model = Model.begin(lex.share, states)
    rows = encoded.where(~F.col("held_out")).select("symbols")
    names = [f"s{k}" for k in range(states)]
    schema = "symbol int, " + ", ".join(f"{n} double" for n in names)
    # rows of moves, starts and likelihood follow the symbols
    size, history = len(lex.share), []
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            total = np.zeros((size + states + 2, states))
            for b in batches:
                texts = [np.frombuffer(x, np.uint16) for x in b.column("symbols").to_pylist()]
                for some in in_steps(texts) if texts else ():
                    starts, moves, emits, likelihood = expected_counts(own, [texts[i] for i in some])
                    total[:size] += emits
                    total[size:-2] += moves
                    total[-2] += starts
                    total[-1, 0] += likelihood
            some = np.flatnonzero(total.any(axis=1))
            columns = [pa.array(some.astype(np.int32))] + [pa.array(total[some, k]) for k in range(states)]
            yield pa.RecordBatch.from_arrays(columns, ["symbol", *names])

        counts = rows.mapInArrow(expect, schema).groupBy("symbol").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        total = np.zeros((size + states + 2, states))
        total[counts.column("symbol").to_numpy()] = np.stack([counts.column(n).to_numpy() for n in names], axis=1)
        model = model.again(total[-2], total[size:-2], total[:size], lex.share)
        history.append(float(total[-1, 0]))
        shared.destroy()
    model.history = history
    return model


def rare_sums(docs: DataFrame, counts: DataFrame, lexicon_of) -> DataFrame:
    """doc_id, copy, rare_base, rare_inside, n_rare: sums over the words that the lexicon doesn't know.

    `rare_inside` is the log10 probability of those words within their classes. Rows alike in doc_id and
    copy are summed together.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon_of.value.words
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                word, times, row = [], [], []
                for i, text in enumerate(some.column("text").cast(pa.binary()).to_pylist()):
                    rare = Counter(w for w in tokens(text) if w not in known)
                    word += rare.keys()
                    times += rare.values()
                    row += [i] * len(rare)
                at_row = pa.array(row, pa.int64())
                given = [some.column(c).take(at_row) for c in ("doc_id", "copy")]
                columns = [*given, pa.array(word, pa.binary()), pa.array(times, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "word", "times"])

    lex = lexicon_of.value
    spark = docs.sparkSession
    per_class = [(k, float(u), float(r)) for k, (u, r) in enumerate(zip(np.log10(lex.class_unseen), lex.class_rest, strict=True))]
    classes = F.broadcast(spark.createDataFrame(per_class, "k int, unseen double, rest double"))  # SUFFIX_CLASSES rows
    met = docs.select("doc_id", "copy", "text").mapInArrow(words, "doc_id long, copy long, word binary, times int")
    found = met.join(counts.where(F.col("c") < lex.least), "word", "left").withColumn("k", _class_column()).join(classes, "k")
    known = F.col("c").isNotNull()
    return found.groupBy("doc_id", "copy").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_base"),
        F.sum(F.col("times") * F.when(known, F.log10(F.col("c").cast("double")) + F.col("rest")).otherwise(F.col("unseen"))).alias("rare_inside"),
        F.sum(F.when(known, F.col("times")).otherwise(0).cast("long")).alias("n_rare"),
    )


def score(
    docs: DataFrame, held_out: Column, states: int = STATES, passes: int = PASSES, vocabulary: int = VOCABULARY, known: int = KNOWN
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs` (doc_id, text).

    `held_out`: a boolean column over doc_id of the rows that are not learned from.
    """
    if 1 + SUFFIX_CLASSES + vocabulary > 1 << 16:
        raise ValueError("symbols are written in two bytes: use fewer words or classes")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("copy"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    training = rows.where(~F.col("held_out"))
    counts = materialise(count_words(training), "hmm-counts")
    lex = lexicon(counts, training.select("doc_id").count(), vocabulary, known)
    shared = spark.sparkContext.broadcast(lex)
    encoded = materialise(encode(rows, shared), "hmm-encoded")
    model = spark.sparkContext.broadcast(train(encoded, lex, states, passes))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = log10_likelihood(model.value, [np.frombuffer(x, np.uint16) for x in b.column("symbols").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in plain] + [pa.array(found)], [*plain, "forward"])

    plain = ["doc_id", "copy", "held_out", "n_tokens", "known", "base", "inside"]
    kinds = "doc_id long, copy long, held_out boolean, n_tokens long, known long, base double, inside double"
    scored = encoded.select(*plain, "symbols").mapInArrow(forward, kinds + ", forward double")
    key = [F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "copy"]
    same = encoded.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    sums = rare_sums(rows, counts, shared).select(*key, "rare_base", "rare_inside", "n_rare").join(same, ["id", "no_id", "copy"])
    sums = sums.select("id", "no_id", "copy", *((F.col(c) / F.col("rows")).alias(c) for c in ("rare_base", "rare_inside", "n_rare")))
    keyed = scored.withColumns({"id": key[0], "no_id": key[1]})
    out = keyed.join(sums, ["id", "no_id", "copy"], "left").na.fill(0.0, ["rare_base", "rare_inside", "n_rare"])
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.round("n_rare").cast("long") + F.lit(int(lex.ends > 0))).alias("n_known"),
        F.lit(lex.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_base") - F.col("n_tokens") * F.lit(lex.base_rest)).alias("base_score"),
        (F.col("forward") + F.col("inside") + F.col("rare_inside")).alias("score"),
    )
