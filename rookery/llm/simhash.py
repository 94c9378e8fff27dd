"""SimHash near-duplicates linked through deletion-variant signatures.

A text's fingerprint has bit i set if over half of its word shingles' XXH64 values have it set. Two
fingerprints within 3 bits, cut into two segments of 32 bits, have a segment that differs in at most
one bit. So each distinct fingerprint is indexed under 64 signatures: for each segment and each of
its bits, the segment with that bit deleted. An equality of signatures proposes a pair, the whole
fingerprints verify it.

Scale: equal texts and equal fingerprints are one node, found by partial aggregation, so a group of
copies never is a group of pairs. Signatures are dealt and sorted by Spark and read as a stream; a
bucket of up to `BUCKET` fingerprints is compared in blocks and reported as a spanning forest, not
as its pairs. A larger bucket is dealt again by deletion variants of the other segment's halves, 32
to a fingerprint; its members agree in 46 bits, so there are at most 2^18 in any such bucket. No
candidate is dropped. Components are found by alternating large-star and small-star joins on the
links, written to the shared folder after each round.

The pipeline links by similarity instead (`similar_copies`): texts of Jaccard 0.8 on five words lie some
ten bits apart, up to twenty, and segments short enough to be equal there tell nothing apart. So the
signatures propose what they can, and besides texts that share one of the rarest fifth of their
shingles are candidates, which no pair of 0.8 fails to do. Size, the shared shingle's place and a bitmap of
parities, all three exact, reject nearly all other pairs inside the join, and the shingle sets themselves
decide. Hot shingles come last in that order. SimHash itself rejects no pair unless a `distance` under 64 is
given: short texts of that similarity may differ in any number of bits.

Defined results: a null text counts as empty; A-Z are lower-cased; words are runs of anything but
ASCII white space; fewer words than a shingle are one shingle; a text without words has fingerprint
zero and is linked like any other; component_id is the smallest doc_id reachable (null ids don't
count); repeated rows share a component; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SHINGLE = 3
SEED = 42
DISTANCE = 3
BUCKET = 1024
TASK_NODES = 100_000
#: Bits in which fingerprints of similar texts may differ: all of them.
WIDE = 64
MARK_BITS = 768
#: Texts of over so many shingles have longer marks as well, of so many bits.
WIDE_MARKS = [(8_000, 1 << 15), (1_000, 1 << 12)]
SAMPLE = 8_000
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        texts = [b" ".join(words)]
    else:
        texts = [b" ".join(w) for w in zip(*(words[k:] for k in range(shingle)), strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(texts), _CHUNK):
        some = texts[at : at + _CHUNK]
        h = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in some), np.uint64, len(some))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(texts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for each row of `docs` (doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            fp = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(each, "doc_id long, fp long")


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= DISTANCE


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of one bucket's distinct fingerprints; memory is linear in the bucket."""
    m = len(fps)
    root = np.arange(m)
    links = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    step = max(1, (1 << 20) // m)
    for at in range(0, m, step):
        rows = fps[at : at + step]
        near = _within(rows[:, None], fps[None, : at + len(rows)])
        r, c = np.nonzero(near & (np.arange(at + len(rows))[None, :] < (at + np.arange(len(rows)))[:, None]))
        # one candidate for each pair of trees is enough
        trees = np.array([find(i) for i in range(at + len(rows))])
        r += at
        _, first = np.unique(trees[r] * m + trees[c], return_index=True)
        for i, j in zip(r[first].tolist(), c[first].tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((int(fps[j]), int(fps[i])))
    return links


def _variants(value: np.ndarray, bits: int, tag: int) -> np.ndarray:
    """(n, bits) keys of `value` with each bit deleted; keys of different tags and bits differ."""
    at = np.arange(bits, dtype=np.uint64)
    return (value[:, None] & ~(np.uint64(1) << at)[None, :]) | ((np.uint64(tag * bits) + at) << np.uint64(32))[None, :]


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = fp.view(np.uint64)
    return u & np.uint64(0xFFFFFFFF), u >> np.uint64(32)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 4096):
            fp = fps[at : at + 4096].copy()
            key = np.concatenate([_variants(s, 32, i) for i, s in enumerate(_halves(fp))], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp, 64))], ["key", "fp"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets (key, fp) under 32 more signatures, of the segment that the key does not hold."""
    for b in batches:
        keys, fps = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        for at in range(0, len(fps), 4096):
            key, fp = keys[at : at + 4096].copy(), fps[at : at + 4096].copy()
            low, high = _halves(fp)
            other = np.where(key.view(np.uint64) >> np.uint64(32) < np.uint64(32), high, low)
            sub = np.concatenate([_variants((other >> np.uint64(16 * i)) & np.uint64(0xFFFF), 16, i) for i in range(2)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(key, 32)), pa.array(sub.ravel().view(np.int64)), pa.array(np.repeat(fp, 32))], ["key", "sub", "fp"]
            )


def _links(keys: list[str]):
    """Links from a stream sorted by `keys`, whose buckets may reach over batches."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in _and_end(batches):
            if b is not None:
                part = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in [*keys, "fp"]])
                if held:
                    part = np.concatenate([held[0], part], axis=1)
            elif held:
                part = held[0]
            else:
                return
            new = np.flatnonzero((part[:-1, 1:] != part[:-1, :-1]).any(axis=0)) + 1
            ends = np.append(new, part.shape[1]) if b is None else new
            starts = np.append(0, new)[: len(ends)]
            held = [] if b is None else [part[:, (new[-1] if len(new) else 0) :].copy()]
            fps, size = part[-1], ends - starts
            two = starts[size == 2]
            two = two[_within(fps[two], fps[two + 1])]
            out = [np.stack([fps[two], fps[two + 1]])]
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                if found := spanning_links(fps[s:e]):
                    out.append(np.array(found, np.int64).T)
            got = np.concatenate(out, axis=1)
            if got.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(got.min(axis=0)), pa.array(got.max(axis=0))], ["a", "b"])

    return find


def _and_end(batches: Iterator) -> Iterator:
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def near_links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: links that connect all distinct fingerprints of `nodes` (fp) within DISTANCE bits."""
    spark = nodes.sparkSession
    # a fingerprint becomes 64 rows: tasks are dealt by their number, not by the size of the table's files
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // TASK_NODES))
    signed = nodes.select("fp").repartition(parts, "fp").mapInArrow(_signatures, "key long, fp long")
    large = materialise(signed.groupBy("key").count().where(F.col("count") > bucket).select("key"), "simhash-large")
    usual = signed.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key", "fp")
    links = usual.mapInArrow(_links(["key"]), "a long, b long")
    if not large.isEmpty():
        finer = signed.join(large, "key").select("key", "fp").mapInArrow(_finer, "key long, sub long, fp long")
        finer = finer.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")
        links = links.unionByName(finer.mapInArrow(_links(["key", "sub"]), "a long, b long"))
    return links.distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of every node that has a link (a, b)."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        # large star: each node's larger neighbours are tied to its least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if now == state:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        state = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for every row of `docs` (doc_id, text)."""
    prints = materialise(fingerprints(docs, shingle), "simhash-prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = connected_components(near_links(nodes))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "simhash-rooted")
    components = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(components, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle of UTF-8 text; fewer words than a shingle are one shingle."""
    words = text.lower().split()
    texts = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) > shingle else [words]
    return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED) for w in texts], np.uint64)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles (distinct values)."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _bits(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        some = np.ascontiguousarray(hashes[at : at + _CHUNK])
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def common_shingles(nodes: DataFrame, shingle: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur twice or more in about `sample` texts of `nodes`, sorted, with their counts."""
    step = max(1, -(-nodes.count() // sample))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text").cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, shingle)).view(np.int64))], ["s"])

    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(step)) == 0).select("text").mapInArrow(each, "s long")
    found = some.groupBy("s").count().where("count > 1").toPandas().sort_values("s")
    return found["s"].to_numpy(np.int64), found["count"].to_numpy(np.int64)


def _mark(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the shingles that fall to each of so many bits, as longs."""
    odd = np.bincount((shingles.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _prefixes(nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node, n, fp, mark, wide, keys: so many of each text's rarest shingles that two texts of `similarity` share one.

    `mark` has MARK_BITS bits, each the parity of the shingles that fall to it, so two texts differ in at
    least as many shingles as their marks in bits; `wide` has the bits of WIDE_MARKS for long texts.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(common_shingles(nodes, shingle))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                sizes, prints, marks, wide, keys = [], [], [], [], []
                for t in some.column("text").cast(pa.binary()).to_pylist():
                    hashes = shingle_hashes(t, shingle)
                    own = np.unique(hashes).view(np.int64)
                    n = len(own)
                    seen = np.zeros(n, np.int64)
                    if len(common):
                        place = np.minimum(np.searchsorted(common, own), len(common) - 1)
                        seen = np.where(common[place] == own, counts[place], 0)
                    # one order of all shingles for all texts: whatever the sample counts, no pair is lost
                    keys.append(own[np.lexsort((own, seen))[: n - int(np.ceil(round(similarity * n, 6))) + 1]])
                    sizes.append(n)
                    prints.append(_bits(hashes))
                    marks.append(_mark(own, MARK_BITS))
                    wide.append(next((_mark(own, bits) for least, bits in WIDE_MARKS if n > least), None))
                longs = pa.list_(pa.int64())
                columns = [pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(marks, longs), pa.array(wide, longs), pa.array(keys, longs)]
                yield pa.RecordBatch.from_arrays([some.column("node"), *columns], ["node", "n", "fp", "mark", "wide", "keys"])

    return nodes.select("node", "text").mapInArrow(each, "node long, n long, fp long, mark array<long>, wide array<long>, keys array<long>")


def _passing(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the longer marks of long texts don't reject, before any text is read."""
    long = prints.where("wide IS NOT NULL")
    x, y = (long.select(F.col("node").alias(c), F.struct("n", "wide").alias(f"t_{c}")) for c in ("a", "b"))
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    bits = F.aggregate(F.zip_with("t_a.wide", "t_b.wide", lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda s, n: s + n)
    apart = (F.col("t_a.n") + F.col("t_b.n")) * (1 - 2 * similarity / (1 + similarity)) + 1e-6
    same = F.size("t_a.wide") == F.size("t_b.wide")
    return both.where(F.coalesce(~same | (bits <= apart), F.lit(True))).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, prints: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (b.column(c).cast(pa.binary()).to_pylist() for c in ("one", "two"))
            sets = ((np.unique(shingle_hashes(x, shingle)), np.unique(shingle_hashes(y, shingle))) for x, y in zip(one, two, strict=True))
            near = pa.array([similarity_of(x, y) >= similarity - 1e-9 for x, y in sets], pa.bool_())
            yield b.select(["a", "b"]).filter(near)

    pairs = materialise(_passing(pairs, prints, similarity), "similar-passing")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = materialise(nodes.join(asked, "node", "left_semi"), "similar-texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("two")), "b")
    return materialise(both.select("a", "b", "one", "two").mapInArrow(each, "a long, b long"), "similar-links")


def _can_be_similar(x: Column, y: Column, similarity: float, distance: int) -> Column:
    """Whether two texts (n, fp, mark) may have the similarity: by size, marks and, if asked for, SimHash."""
    n = x["n"] + y["n"]
    apart = n * (1 - 2 * similarity / (1 + similarity)) + 1e-6
    bits = sum(F.bit_count(x["mark"][i].bitwiseXOR(y["mark"][i])) for i in range(MARK_BITS // 64))
    alike = F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"]) - 1e-6
    return alike & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= distance) & (bits <= apart)


def _meet(x: Column, y: Column, similarity: float, distance: int) -> Column:
    """`_can_be_similar` for texts (and pos, the key's place in each) that share a key, if it is the first that they share.

    What comes before the key in either is not in the other, so that the rest must hold all they have in common.
    """
    least = (x["n"] + y["n"]) * (similarity / (1 + similarity)) - 1e-6
    return (F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= least) & _can_be_similar(x, y, similarity, distance)


def _signature_pairs(prints: DataFrame, similarity: float, distance: int) -> DataFrame:
    """a, b: texts linked by deletion variants of their fingerprints that may have the similarity."""
    about = F.struct("node", "n", "fp", "mark").alias("t")
    named = materialise(prints.groupBy("fp").agg(F.min(about).alias("t")), "similar-named")
    x, y = (named.select(F.col("fp").alias(c), F.col("t").alias(f"t_{c}")) for c in ("a", "b"))
    near = near_links(named).join(x, "a").join(y, "b").select(F.col("t_a").alias("x"), F.col("t_b").alias("y"))
    same = prints.select("fp", about).join(named.select("fp", F.col("t").alias("x")), "fp").select("x", F.col("t").alias("y"))
    x, y = F.col("x"), F.col("y")
    some = near.unionByName(same).where((x["node"] != y["node"]) & _can_be_similar(x, y, similarity, distance))
    return some.select(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"))


def similar_links(nodes: DataFrame, shingle: int, similarity: float, distance: int) -> DataFrame:
    """a, b: links that connect all texts of `nodes` (node, text) of at least `similarity`.

    Texts that deletion variants of their fingerprints link are candidates, and so are texts that share a
    key. First each meets the least and the largest node of its keys, so that a group of near copies is
    tied by a row or two a key; then, of each key, those outside its largest component meet the others.
    Only pairs that pass `_can_be_similar` leave the join and are read.
    """
    prints = materialise(_prefixes(nodes, shingle, similarity), "similar-prints")
    keys = prints.select(F.posexplode("keys").alias("pos", "key"), "node").repartition("key")
    repeated = keys.groupBy("key").count().where("count > 1").select("key")
    shared = keys.join(repeated, "key").join(prints.drop("keys", "wide"), "node")
    shared = materialise(shared.select("key", F.struct("node", "pos", "n", "fp", "mark").alias("x")), "similar-shared")
    ends = shared.groupBy("key").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    met = shared.join(ends, "key")
    x, y = F.col("x"), F.col("y")
    stars = met.select(F.col("low").alias("x"), F.col("x").alias("y")).unionByName(met.select("x", F.col("high").alias("y")))
    stars = stars.where((x["node"] < y["node"]) & _can_be_similar(x, y, similarity, distance)).select(x["node"].alias("a"), y["node"].alias("b"))
    stars = materialise(stars.unionByName(_signature_pairs(prints, similarity, distance)).distinct(), "similar-pairs")
    first = _verified(stars, nodes, prints, shingle, similarity)

    roots = connected_components(first).withColumnRenamed("node", "n")
    rooted = shared.join(roots, shared["x"]["node"] == roots["n"], "left").select("key", "x", F.coalesce("root", x["node"]).alias("root"))
    rooted = materialise(rooted, "similar-rooted")
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    left = materialise(rooted.join(main.select("key", "main"), "key"), "similar-apart")
    other = left.where("root <> main").select("key", F.col("x").alias("y"), F.col("root").alias("root_y"))
    # two that are both outside the largest component meet once
    once = (F.col("root") == F.col("main")) | (x["node"] < y["node"])
    pairs = left.join(other, "key").where((F.col("root") != F.col("root_y")) & once & _meet(x, y, similarity, distance))
    pairs = pairs.select(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")).distinct()
    pairs = materialise(pairs.join(stars, ["a", "b"], "left_anti"), "similar-pairs")
    return first.unionByName(_verified(pairs, nodes, prints, shingle, similarity))


def similar_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = WIDE) -> DataFrame:
    """node, component_id of every text (doc_id, text) that is linked to another by shingle similarity.

    A node is a doc_id, or for a null one the text's XXH64; component_id is the least doc_id of the
    component (null ones don't count), or its least node if it has none.
    """
    text = F.coalesce("text", F.lit(""))
    nodes = docs.select(node_of(docs).alias("node"), text.alias("text"))
    linked = connected_components(similar_links(nodes, shingle, similarity, distance))
    every = materialise(linked.unionByName(linked.select(F.col("root").alias("node"), "root")).distinct(), "similar-members")
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("node")).distinct().withColumn("named", F.lit(True))
    members = every.join(named, "node", "left")
    least = members.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("named"), F.col("node"))), F.min("node")).alias("component_id"))
    return every.join(least, "root").select("node", "component_id")


def node_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
