"""Searches that share their places between kinds of documents, and chains of searches with count gates.

Each is one pass: counts and ranks come from windows over the hits of all queries and stages together, so
that no stage is run query by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import top_k
from .textindex import PATTERNS, ROWS, Finder, each, in_blocks, substring_hits, written

#: Kinds of documents, in the order in which they get places that are left over.
TYPES = ["pdf", "excel", "word", "text"]
#: Chunks that a task takes at once in the beginning.
FEWEST = 4


def tiered_matches(queries: DataFrame, chunks: DataFrame, whole: float, every: float, some: float) -> DataFrame:
    """query_id, chunk_id, score: chunks with any word of a query (query_id, text); more if they hold every word, or the text itself.

    Words are what white space separates, of two characters or more, found as substrings in any case.
    """
    asked = queries.select("query_id", F.lower("text").alias("text"))
    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: F.char_length(w) > 1))
    words = written(asked.select("query_id", F.explode(words).alias("pattern")), "tier-words")
    hits = written(substring_hits(words.select("pattern").union(asked.select(F.col("text").alias("pattern"))), chunks), "tier-hits")
    size = words.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    met = words.join(hits, "pattern").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("met"))
    text = asked.select("query_id", F.col("text").alias("pattern")).join(hits, "pattern").select("query_id", "chunk_id", F.lit(True).alias("held"))
    rows = met.join(size, "query_id").join(text, ["query_id", "chunk_id"], "left")
    score = F.when(F.col("held"), whole).when(F.col("met") == F.col("size"), every).otherwise(some)
    return rows.select("query_id", "chunk_id", score.cast("double").alias("score"))


def tiered_best(queries: DataFrame, chunks: DataFrame, whole: float, every: float, some: float, k: int, block: int = PATTERNS) -> DataFrame:
    """query_id, chunk_id, type, score: rows of `tiered_matches`, with all of the k best of each query and type (ties by chunk) among them.

    Chunks have a `type`. A task takes its chunks by type in order of their names and leaves out hits of a query
    that has k of the type as good already, so that a word of every chunk makes few rows.
    """
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.lower("text").alias("text"))
    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: F.char_length(w) > 1))
    asked = written(asked.select("query_id", "text", words.alias("words")).where(F.size("words") > 0), "tier-queries")
    texts = chunks.select("chunk_id", F.lower("content").alias("low"), "type").where("content IS NOT NULL")
    texts = texts.coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions("type", "chunk_id")
    return reduce(DataFrame.union, [_tier_block(rows, texts, [some, every, whole], k) for rows in in_blocks(asked, "query_id", block)])


class Tiers:
    """The level at which chunks meet queries, 0 for any word, 1 for every word, 2 for the text itself, of k hits a query and level.

    Queries that still want chunks with any word are held against each; those that want chunks with every word
    are met by their rarest word so far, and texts are found as they are.
    """

    def __init__(self, rows: list[tuple[list[str], str]]) -> None:
        strings = {x: i for i, x in enumerate(dict.fromkeys(x for words, text in rows for x in (*words, text)))}
        self.finder = Finder(strings)
        self.queries = len(rows)
        most = max((len(words) for words, _ in rows), default=1)
        #: each query's words, the last one again where there are fewer
        self.words = np.array([[strings[w] for w in words] + [strings[words[-1]]] * (most - len(words)) for words, _ in rows], np.int64).reshape(len(rows), most)
        self.whole = np.array([strings[text] for _, text in rows], np.int64)
        self.by_whole = self.by(self.whole, np.arange(len(rows)))

    def by(self, strings: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries by a string of each: where they begin, how many there are, and their numbers."""
        many = np.bincount(strings, minlength=len(self.finder.strings))
        return np.cumsum(many) - many, many, queries[np.argsort(strings, kind="stable")]

    def start(self, k: int) -> None:
        """From here on hits are counted anew."""
        self.k, self.seen, self.looked = k, 0, 0
        self.counts = np.zeros((3, self.queries), np.int64)
        self.hits = np.zeros(len(self.finder.strings), np.int64)
        self.marks = np.zeros((self.finder.at_once(), len(self.finder.strings)), bool)

    def at_once(self) -> int:
        """Chunks to be met next: few at first, when every query wants hits of any kind."""
        return min(self.finder.at_once(), max(FEWEST, self.seen))

    def met(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of texts and queries, in order, and the levels of hits that the queries still want."""
        pairs, marks = self.finder.pairs(texts), self.marks
        marks.ravel()[pairs] = True
        held, string = np.divmod(pairs, max(1, len(self.hits)))
        self.hits += np.bincount(string, minlength=len(self.hits))
        wants = self.counts < self.k
        if self.seen >= 2 * self.looked:  # after twice as many chunks other words may be the rarest, and fewer queries are left
            left = np.flatnonzero(wants[1])
            own = self.words[left]
            rarest = own[np.arange(len(left)), self.hits[own].argmin(axis=1)]
            self.by_rarest, self.looked = self.by(rarest, left), max(self.seen, 1)
        self.seen += len(texts)
        keys, levels = [], []

        def put(text: np.ndarray, query: np.ndarray, level: int) -> None:
            keys.append(text * self.queries + query)
            levels.append(np.full(len(text), level))

        left = np.flatnonzero(wants[0])
        if len(left):
            some = np.zeros((len(texts), len(left)), bool)
            for own in self.words[left].T:
                some |= marks[: len(texts), own]
            text, at = np.nonzero(some)
            put(text, left[at], 0)
        for level, (start, many, queries) in ((1, self.by_rarest), (2, self.by_whole)):
            text, query = np.repeat(held, many[string]), queries[each(start[string], many[string])]
            good = wants[level, query]
            text, query = text[good], query[good]
            for own in self.words.T if level == 1 else ():
                good = marks[text, own[query]]
                text, query = text[good], query[good]
            put(text, query, level)
        marks.ravel()[pairs] = False
        key, level = np.concatenate(keys), np.concatenate(levels)
        order = np.lexsort((-level, key))
        key, level = key[order], level[order]
        best = np.append(True, key[1:] != key[:-1])[: len(key)]
        key, level = key[best], level[best]
        text, query = key // self.queries, key % self.queries
        for i in range(3):
            self.counts[i] += np.bincount(query[level >= i], minlength=self.queries)
        return text, query, level


def _tier_block(rows: list, texts: DataFrame, scores: list[float], k: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((pa.array([r["query_id"] for r in rows], pa.string()), Tiers([(r["words"], r["text"]) for r in rows])))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tiers = shared.value
        before: list = []  # the type of the chunks before
        for b in batches:
            at = 0
            while at < b.num_rows and tiers.queries:
                kind = b.column(2)[at].as_py()
                if before != [kind]:
                    before = [kind]
                    tiers.start(k)
                same = 0
                some = b.slice(at, tiers.at_once())
                kinds = some.column(2).to_pylist()
                while same < len(kinds) and kinds[same] == kind:
                    same += 1
                some = some.slice(0, same)
                at += same
                text, query, level = tiers.met(some.column(1).to_pylist())
                for i in range(0, len(text), ROWS):
                    t, q, v = text[i : i + ROWS], query[i : i + ROWS], np.array(scores, float)[level[i : i + ROWS]]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), some.column(0).take(pa.array(t)), some.column(2).take(pa.array(t)), pa.array(v)], ["query_id", "chunk_id", "type", "score"])

    return texts.mapInArrow(find, "query_id string, chunk_id string, type string, score double")


def type_focused(hits: DataFrame, kind: str, k: int) -> DataFrame:
    """The k best hits of each query (with a type) of one kind of document."""
    return top_k(hits.where(F.col("type") == kind), k)


def places_by_type(k: int, types: list[str]) -> dict[str, int]:
    """k places dealt evenly, what is left over to the first types."""
    return {t: max(1, k // len(types)) + (i < k % len(types)) for i, t in enumerate(types)}


def share_by_type(hits: DataFrame, k: int, types: list[str] | None = None) -> DataFrame:
    """query_id, chunk_id, type, score, rank: k places a query, dealt evenly to the types, what is left over to the first ones.

    A type with fewer hits leaves its places empty.
    """
    types = types or TYPES
    places = places_by_type(k, types)
    place = F.element_at(F.create_map(*[F.lit(x) for t, n in places.items() for x in (t, n)]), F.col("type"))
    own = Window.partitionBy("query_id", "type").orderBy(F.desc("score"), "chunk_id")
    # the largest share bounds every type's, which lets Spark cut the groups before it moves them
    kept = hits.where(F.col("type").isin(types)).withColumn("own", F.row_number().over(own)).where(F.col("own") <= max(places.values()))
    return top_k(kept.where(F.col("own") <= place).drop("own"), k).select("query_id", "chunk_id", "type", "score", "rank")


def first_sufficient(stages: list[tuple[str, DataFrame, int]], k: int) -> DataFrame:
    """query_id, chunk_id, score, stage, rank: of each query the hits of the first stage (name, hits, least number) that has enough."""
    rows = None
    for i, (name, hits, least) in enumerate(stages):
        part = top_k(hits.select("query_id", "chunk_id", F.col("score").cast("double").alias("score")), k)
        part = part.withColumns({"no": F.lit(i), "stage": F.lit(name), "least": F.lit(least)})
        rows = part if rows is None else rows.unionByName(part)
    counted = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id", "no")))
    enough = counted.where("n >= least").withColumn("first", F.min("no").over(Window.partitionBy("query_id")))
    return enough.where("no = first").select("query_id", "chunk_id", "score", "stage", "rank")


def top_up(hits: DataFrame, more: DataFrame, kind: str, least: int, stage: str, add: int, k: int) -> DataFrame:
    """Hits (query_id, chunk_id, score, stage, rank, type) of which `stage` has fewer than `least` of a kind get up to `add` further ones of it.

    Further hits (`more`, with a rank) come after the others, each chunk once, k in all.
    """
    short = hits.groupBy("query_id").agg(F.first("stage").alias("stage"), F.count_if(F.col("type") == kind).alias("n")).where((F.col("n") < least) & (F.col("stage") == stage))
    extra = more.where(F.col("rank") <= add).join(short.select("query_id"), "query_id", "left_semi")
    columns = ["query_id", "chunk_id", "score", "rank"]
    both = hits.select(*columns, F.lit(0).alias("part"), "stage").unionByName(extra.select(*columns, F.lit(1).alias("part"), F.lit("top-up").alias("stage")))
    once = both.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("part"))).where("r = 1").drop("r")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank"))).where(F.col("place") <= k)
    return placed.select("query_id", "chunk_id", "score", "stage", F.col("place").alias("rank"))


def vector_with_type_backfill(queries: DataFrame, hits: DataFrame, unembedded: DataFrame, newest: DataFrame, k: int = 20, add: int = 10, gate: int = 15) -> DataFrame:
    """query_id, chunk_id, score, source, rank: hits of a vector search, filled up where there are few.

    A query (query_id) with fewer than `k` hits gets up to `add` chunks without vectors (`unembedded`: chunk_id,
    of the wanted type) at 0.5; one that then has fewer than `gate` gets the `gate` newest (`newest`: chunk_id,
    at) at 0.4. A chunk counts once, for what found it first. Both lists are cut to those few rows, which is what
    tasks receive.
    """

    def filled(rows: DataFrame, order: list, most: int, part: int, score: float, source: str) -> DataFrame:
        ids = [r["chunk_id"] for r in rows.orderBy(*order).limit(most).collect()]
        some = F.array(*map(F.lit, ids)).cast("array<string>")
        return queries.select("query_id", F.explode(some).alias("chunk_id"), F.lit(score).alias("score"), F.lit(source).alias("source"), F.lit(part).alias("part"))

    rows = hits.select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), F.lit("vector").alias("source"), F.lit(0).alias("part"))
    rows = rows.unionByName(filled(unembedded, [F.col("chunk_id")], add, 1, 0.5, "type")).unionByName(filled(newest, [F.desc("at"), F.col("chunk_id")], gate, 2, 0.4, "newest"))
    of_query = Window.partitionBy("query_id")
    counted = rows.withColumn("own", F.count_if(F.col("part") == 0).over(of_query)).where((F.col("part") == 0) | (F.col("part") == 2) | (F.col("own") < k))
    once = counted.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("part"))).where("r = 1")
    gated = once.withColumn("n", F.count_if(F.col("part") < 2).over(of_query)).where((F.col("part") < 2) | (F.col("n") < gate))
    return top_k(gated.select("query_id", "chunk_id", "score", "source"), k)
