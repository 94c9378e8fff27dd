"""Retrieval for whole tables of questions at once.

Queries and chunks are DataFrames; every operator returns hits (query_id, chunk_id, score, ...). Keyword
and trigram search find their candidates by equality joins on words or grams, scoring them after. Vector
search multiplies blocks of the query set with each batch of vectors inside its task: one block after
another is sent to the tasks, so that no number of queries is too large. Only top-k rows of each task are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_path
from .best import FEW, SPAN, Best, best_matched, in_blocks, in_order, written

QUERY_BLOCK = 512
MAX_QUERIES = 100_000
#: Vectors that a task takes at a time, and those of a group that it multiplies with a block of queries.
VECTORS, TILE = 4_096, 512
#: Query keywords of a block, each of which is a number in the lists that tasks receive, and the chunks that are scored at a time.
BM25_KEYWORDS = 100_000
BM25_CHUNKS = 128


def normalise(c: Column) -> Column:
    """Lower case, full-width ASCII and space folded, white space collapsed, trimmed."""
    wide = "".join(chr(0xFEE0 + x) for x in range(0x21, 0x7F)) + "　"
    plain = "".join(chr(x) for x in range(0x21, 0x7F)) + " "
    return F.trim(F.regexp_replace(F.lower(F.translate(c, wide, plain)), r"[\t\n\r ]+", " "))


def top_k(hits: DataFrame, k: int, by: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The k best rows of each group, ties by chunk."""
    w = Window.partitionBy(*(by or ["query_id"])).orderBy(*(order or [F.desc("score"), F.col("chunk_id")]))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine from dot product and norms; 0 when a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(dot(a, b) / F.nullif(norms, F.lit(0.0)), F.lit(0.0))


def vector_pairs(queries: DataFrame, chunks: DataFrame, digits: int = 5, block: int = MAX_QUERIES) -> DataFrame:
    """query_id, chunk_id, score: the cosine of every query (query_id, embedding) and chunk that has a vector.

    Pairs come out of the tasks that read the chunks, a block of queries after another; nothing is ranked or moved.
    """
    asked = queries.select("query_id", "embedding")
    blocks = max(1, -(-asked.count() // block))
    some = lambda i: asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
    return reduce(DataFrame.union, (_block_hits(some(i), chunks, None, digits)[0] for i in range(blocks)))


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, digits: int = 5, block: int = MAX_QUERIES) -> DataFrame:
    """query_id, chunk_id, score, rank: the k chunks of the largest cosine, for queries (query_id, embedding).

    Queries are taken in blocks of about `block` rows, one after another; more than one block is read from a
    table in the shared folder and its hits are written there. Each batch of chunks keeps the k best of each
    query with ties beyond them, so that rounding and tie order are settled in the final ranking.
    """
    asked = queries.select("query_id", "embedding")
    blocks = -(-asked.count() // block)
    if blocks <= 1:
        return _block_topk(asked.collect(), chunks, k, digits)[0]
    spark = chunks.sparkSession
    path = shared_path(spark, "vector-topk")
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    asked.select("*", number).repartition("block").write.partitionBy("block").parquet(f"{path}/queries")
    stored = spark.read.schema(T.StructType([*asked.schema.fields, T.StructField("block", T.IntegerType())])).parquet(f"{path}/queries")
    for i in range(blocks):
        some = stored.where(F.col("block") == i).select("query_id", "embedding").collect()
        hits, shared = _block_topk(some, chunks, k, digits)
        hits.write.parquet(f"{path}/hits/block={i}")
        shared.destroy()
    return spark.read.schema(hits.schema).parquet(f"{path}/hits").select(*hits.columns)


def _block_topk(found: list, chunks: DataFrame, k: int, digits: int):
    """Top-k of one block of query rows, and the broadcast it reads."""
    hits, shared = _block_hits(found, chunks, k, digits)
    return top_k(hits, k), shared


def _block_hits(found: list, chunks: DataFrame, k: int | None, digits: int):
    """Hits of one block of query rows, of each batch of chunks the k best and ties or (None) all, and the broadcast it reads."""
    ids = np.array([r["query_id"] for r in found], object)
    matrix = np.array([r["embedding"] for r in found], np.float64).reshape(len(found), -1)
    norms = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(norms > 0, norms, 1)[:, None]
    shared = chunks.sparkSession.sparkContext.broadcast((ids, unit))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, unit = shared.value
        for b in batches:
            v = np.array(b["embedding"].tolist(), np.float64)
            n = np.linalg.norm(v, axis=1)
            v /= np.where(n > 0, n, 1)[:, None]
            names = b["chunk_id"].to_numpy()
            for at in range(0, len(ids), QUERY_BLOCK):
                scores = np.round(unit[at : at + QUERY_BLOCK] @ v.T, digits) + 0.0
                if k is None:
                    for own, row in zip(ids[at : at + QUERY_BLOCK], scores, strict=True):
                        yield pd.DataFrame({"query_id": own, "chunk_id": names, "score": row})
                    continue
                if scores.shape[1] > k:
                    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                    q, c = np.nonzero(scores >= least[:, None])
                else:
                    q, c = np.nonzero(np.ones_like(scores, bool))
                yield pd.DataFrame({"query_id": ids[at + q], "chunk_id": names[c], "score": scores[q, c]})

    hits = chunks.select("chunk_id", "embedding").where("embedding IS NOT NULL").mapInPandas(best, "query_id string, chunk_id string, score double")
    return hits, shared


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word, padded with two spaces in front and one behind."""
    words = F.filter(F.split(normalise(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def keywords_of(queries: DataFrame, least: int = 4, most: int = 25) -> DataFrame:
    """query_id, keyword: distinct lower-case words of a least length, in order of first use."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) >= least))
    return queries.select("query_id", F.posexplode(F.slice(words, 1, most)).alias("position", "keyword"))


def token_hits(keywords: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, keyword, chunk_id, n: how often a chunk has a keyword as a word; one equality join."""
    words = F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counts = chunks.select("chunk_id", F.explode(words).alias("keyword")).groupBy("chunk_id", "keyword").agg(F.count(F.lit(1)).alias("n"))
    return keywords.select("query_id", "keyword").join(counts, "keyword")


def keyword_count_rank(keywords: DataFrame, chunks: DataFrame, k: int = 20) -> DataFrame:
    """Chunks by the number of matched keywords, then length."""
    asked = keywords.select(F.col("query_id").cast("string").alias("query_id"), "keyword").groupBy("query_id").agg(F.collect_set("keyword").alias("items"))
    sized = chunks.select("chunk_id", "content", F.char_length("content").alias("length")).where("content IS NOT NULL")
    texts = in_order(sized, F.desc("length"), F.col("chunk_id"))
    texts = texts.select("chunk_id", F.split(F.lower("content"), r"[^\p{L}\p{N}]+").alias("words"), F.lit("").alias("kind"), F.col("length").cast("long").alias("carried"))
    hits = best_matched(asked, texts, k).select("query_id", "chunk_id", "matched", F.col("carried").alias("length"))
    return top_k(hits.withColumn("score", F.col("matched").cast("double")), k, order=[F.desc("matched"), F.desc("length"), F.col("chunk_id")])


def bm25(keywords: DataFrame, chunks: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, block: int = BM25_KEYWORDS) -> DataFrame:
    """Okapi BM25 of each query's keywords: query_id, chunk_id, score, rank of the k best chunks.

    Chunks are scored inside their tasks against blocks of queries of about `block` keywords, and only the
    best of each task are shuffled, so that a word of every query and every chunk makes no row a pair.
    """
    spark, path = chunks.sparkSession, shared_path(chunks.sparkSession, "bm25")
    words = F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    few = spark.sparkContext.defaultParallelism
    spread = chunks.select("chunk_id", "content")
    spread = spread.repartition(few) if len(chunks.inputFiles()) < few else spread
    spread.select("chunk_id", words.alias("words")).write.parquet(f"{path}/words")
    tokens = spark.read.parquet(f"{path}/words")
    whole = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean")).first()
    asked = keywords.select(F.col("query_id").cast("string").alias("query_id"), "keyword").distinct()
    held = tokens.select(F.explode(F.array_distinct("words")).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("df"))
    blocks = max(1, -(-asked.count() // block))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).join(held, "keyword")
    numbered.repartition("block").write.partitionBy("block").parquet(f"{path}/queries")
    queries = spark.read.schema("query_id string, keyword string, df long, block int").parquet(f"{path}/queries")
    for i in range(blocks):
        some = queries.where(F.col("block") == i).select("query_id", "keyword", "df").collect()
        hits, shared = _bm25_block(some, tokens, whole["n"], whole["mean"] or 1.0, k, k1, b)
        if blocks == 1:
            return top_k(hits, k)
        top_k(hits, k).write.parquet(f"{path}/hits/block={i}")
        shared.destroy()
    # the folders' names would be a column more
    return spark.read.schema("query_id string, chunk_id string, score double, rank int").parquet(f"{path}/hits").drop("block")


def _bm25_block(asked: list, tokens: DataFrame, n: int, mean: float, k: int, k1: float, b: float):
    """Hits (query_id, chunk_id, score) of one block of queries' keywords, with ties at the k-th, and the broadcast they read."""
    names, words = sorted({r["query_id"] for r in asked}), sorted({r["keyword"] for r in asked})
    at_name, at_word = ({x: i for i, x in enumerate(xs)} for xs in (names, words))
    df = np.zeros(len(words))
    asking: list[list[int]] = [[] for _ in words]
    for r in asked:
        df[at_word[r["keyword"]]] = r["df"]
        asking[at_word[r["keyword"]]].append(at_name[r["query_id"]])
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shared = tokens.sparkSession.sparkContext.broadcast((np.array(names, object), at_word, idf, [np.array(own, np.int32) for own in asking]))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, at_word, idf, asking = shared.value
        top = np.zeros((len(names), k))  # the best scores of the task so far; 0: none
        for batch in batches:
            for at in range(0, len(batch), BM25_CHUNKS):
                some = batch.iloc[at : at + BM25_CHUNKS]
                scores = np.zeros((len(some), len(names)))
                for i, held in enumerate(some["words"]):
                    found = [(j, m) for j, m in sorted(Counter(at_word[w] for w in held if w in at_word).items())]
                    if found:
                        own, times = np.array([j for j, _ in found]), np.array([m for _, m in found], np.float64)
                        part = idf[own] * times * (k1 + 1) / (times + k1 * (1 - b + b * len(held) / mean))
                        who = [asking[j] for j in own]
                        scores[i] = np.bincount(np.concatenate(who), np.repeat(part, [len(x) for x in who]), len(names))
                scores = scores.T
                top = np.partition(np.concatenate([top, scores], axis=1), -k, axis=1)[:, -k:]
                # and what rounding may make equal to the k-th of the task
                q, c = np.nonzero((scores > 0) & (scores >= top[:, 0][:, None] - 2e-6))
                if len(q):
                    yield pd.DataFrame({"query_id": names[q], "chunk_id": some["chunk_id"].to_numpy()[c], "score": scores[q, c]})

    hits = tokens.mapInPandas(best, "query_id string, chunk_id string, score double")
    return hits.withColumn("score", F.round("score", 6)), shared


def fuse(methods: list[tuple[str, float, DataFrame]], k: int = 25) -> DataFrame:
    """Hits of several methods: weighted, the best per chunk kept, with the list of methods."""
    rows = None
    for name, weight, hits in methods:
        part = hits.select("query_id", "chunk_id", (F.col("score") * weight).alias("score"), F.lit(name).alias("method"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("query_id", "chunk_id").agg((F.floor(F.max("score") * 1e6 + 0.5) / 1e6).alias("score"), F.concat_ws(",", F.sort_array(F.collect_set("method"))).alias("methods"))
    return top_k(best, k)


def only_without_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries that an earlier stage found nothing for."""
    return queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")


def pack_context(hits: DataFrame, chunks: DataFrame, least: float = 0.02, budget: int = 120_000) -> DataFrame:
    """One text a query: hits in rank order with a header line, up to the first that breaks the budget."""
    rows = hits.where(F.col("score") >= least).join(chunks.select("chunk_id", "content").where("trim(content) <> ''"), "chunk_id")
    part = F.concat(F.lit("[#"), F.col("rank").cast("string"), F.lit(" "), F.col("chunk_id"), F.lit("]\n"), F.col("content"))
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", part).withColumn("used", F.sum(F.char_length("part")).over(order)).where(F.col("used") <= budget)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"])
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), F.array_join(ordered, "\n").alias("context"))


def phrase_search(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that hold two consecutive words of a query next to each other, by a join on word pairs."""

    def pairs(df: DataFrame, key: str, text: str) -> DataFrame:
        words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        two = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return df.select(key, F.explode(F.array_distinct(F.filter(two, lambda p: p.isNotNull()))).alias("pair"))

    q, c = pairs(queries, "query_id", "text"), pairs(chunks, "chunk_id", "content")
    return q.join(c, "pair").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).cast("double").alias("score"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """doc_id, text: the chunks of each document in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])
    return chunks.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("text"), F.count(F.lit(1)).alias("chunks"))


def ann_topk(queries: DataFrame, chunks: DataFrame, k: int, lists: int = 100, probes: int = 10, seed: int = 1) -> DataFrame:
    """Inverted-file search: k-means lists over unit vectors, the nearest `probes` lists of each query searched inside tasks."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    whole = chunks.select("chunk_id", "embedding").where("embedding IS NOT NULL")
    unit = lambda df: Normalizer(inputCol="raw", outputCol="features").transform(df.withColumn("raw", array_to_vector("embedding")))
    # the centres are fitted on a bounded sample, every row is indexed
    sample = unit(whole.orderBy(F.xxhash64("chunk_id", F.lit(seed))).limit(lists * 256))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(sample)
    centres = np.array(model.clusterCenters())

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.array(b["embedding"].tolist(), np.float64).reshape(len(b), -1)
            v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
            near = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame({"query_id": b["query_id"], "unit": list(v), "groups": list(near.astype(np.int32))})

    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding").where("embedding IS NOT NULL")
    probed = written(asked.mapInPandas(nearest, "query_id string, unit array<double>, groups array<int>"), "ann-queries")
    # vectors move as they came, of half the bytes
    indexed = unit(in_order(model.transform(unit(whole)).select("chunk_id", F.col("prediction").alias("group"), "embedding")))
    return best_within(probed, indexed.select("chunk_id", "group", vector_to_array("features").alias("v")), k)


def best_within(asked: DataFrame, vectors: DataFrame, k: int, digits: int = 5, block: int = MAX_QUERIES) -> DataFrame:
    """query_id, chunk_id, score, rank: of each query (query_id, unit, groups) the k vectors (chunk_id, group, v) of its groups with the largest products.

    Vectors come in the order in which ties are broken. A block of queries is one pass over them; tasks multiply
    each group's vectors with the queries that ask for it, and put out the best of each query.
    """
    return top_k(reduce(DataFrame.union, [_within_block(rows, vectors, k, digits) for rows in in_blocks(asked, "query_id", block)]), k)


def _within_block(rows: list, vectors: DataFrame, k: int, digits: int) -> DataFrame:
    own: dict = {}
    for i, r in enumerate(rows):
        for group in r["groups"]:
            own.setdefault(group, []).append(i)
    matrix = np.array([r["unit"] for r in rows], np.float64).reshape(len(rows), -1)
    shared = vectors.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], matrix, {g: np.array(x) for g, x in own.items()}))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, own = shared.value
        best = Best(len(names), k)
        for b in batches:
            at = 0
            while at < b.num_rows:
                # few vectors at first, so that later ones are held against scores that few of them reach
                some = b.slice(at, min(max(best.seen, FEW), VECTORS))
                at += some.num_rows
                chunk, group, v = some.columns
                place, chunk = best.places(some.num_rows), np.array(chunk.to_pylist(), object)
                v = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
                groups: dict = {}
                for i, x in enumerate(group.to_pylist()):
                    if x in own:
                        groups.setdefault(x, []).append(i)
                for x, rows in groups.items():
                    for r, q in product(range(0, len(rows), TILE), range(0, len(own[x]), QUERY_BLOCK)):
                        vector, query = np.array(rows[r : r + TILE]), own[x][q : q + QUERY_BLOCK]
                        scores = v[vector] @ matrix[query].T
                        found = np.flatnonzero(scores >= (best.least[query] // SPAN - 0.501) / 10**digits)
                        exact = scores.ravel()[found] * 10**digits
                        vector, query = vector[found // len(query)], query[found % len(query)]
                        keys = np.copysign(np.floor(np.abs(exact) + 0.5), exact).astype(np.int64) * SPAN + place[vector]
                        better = keys > best.least[query]
                        if better.any():
                            best.put(query[better], keys[better], chunk[vector[better]])
        for query, chunk, score, _ in best.rows(names):
            yield pa.RecordBatch.from_arrays([query, chunk, pa.array(score / 10**digits)], ["query_id", "chunk_id", "score"])

    return vectors.select("chunk_id", "group", "v").where("v IS NOT NULL").mapInArrow(find, "query_id string, chunk_id string, score double")


def partial_match(queries: DataFrame, keywords: DataFrame, hits: DataFrame, chunks: DataFrame, least: int = 5, factor: float = 0.8, k: int = 10) -> DataFrame:
    """query_id, chunk_id, score, rank: for queries of fewer than `least` hits, chunks with any of their keywords.

    The score is `factor` times the share of the keywords that the chunk has; chunks that are hits already stay out.
    """
    enough = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("query_id")
    asked = keywords.join(queries.select("query_id").join(enough, "query_id", "left_anti"), "query_id", "left_semi").select("query_id", "keyword").distinct()
    many = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("many"))
    found = token_hits(asked, chunks).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("matched")).join(many, "query_id")
    new = found.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return top_k(new.select("query_id", "chunk_id", F.round(factor * F.col("matched") / F.col("many"), 6).alias("score")), k)
