"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A document's sketch is every distinct 64-bit hash of its five-word shingles that falls below a fixed
fraction of the hash range, and the smallest hash besides, so that no text with words has an empty
sketch. The threshold doesn't depend on the document: the sketch of a union is the union of sketches
(drop the smallest-hash extras), and the share of one sketch found in another estimates containment
even between a page and a book; the share that both have estimates their resemblance.

Scale: sketches are a projection; nothing is shuffled. Pairing each document with the next one by
doc_id deals documents into blocks of about BLOCK ranks: doc_ids become ranks through BINS quantiles of
the ids whose hash falls into a fixed share (at most about MAX_SAMPLE), so that sparse and hash-like ids
make blocks as even as consecutive ones do. Texts move once, to their block. There are at most MAX_BLOCKS
blocks, whose first ids are broadcast, and only the first document of each is copied to the block before.

Defined results: a null text counts as empty; texts are lower-cased and split on ASCII white space;
fewer words than a shingle are one shingle of them all; a text without words has the fingerprint "", which is
like another such (1.0) and unlike all else (0.0); equal texts have equal fingerprints; rows with the
same doc_id are ordered by text and share a block; a null doc_id comes first; a single row is its own next one; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialise

WORDS = 5
FRACTION = 8
BLOCK = 256
MAX_BLOCKS = 1_000_000
BINS = 1024
MAX_SAMPLE = 500_000


def words(text: Column) -> Column:
    spaces = ASCII_SPACE.replace(" ", "")
    return F.array_remove(F.split(F.translate(F.lower(text), spaces, " " * len(spaces)), " "), "")


def with_sketch(rows: DataFrame, text: str, out: str, fraction: int = FRACTION, n: int = WORDS) -> DataFrame:
    """Adds the sorted distinct shingle hashes of `text` under 1/fraction of the range, and the smallest of all.

    The steps are columns of their own: an expression used inside a lambda is evaluated for each element.
    """
    limit = -(1 << 63) + (1 << 64) // fraction
    hashed, shingles = f"{out}_words", f"{out}_shingles"
    # a shingle hashes the hashes of its words, so that no strings are built
    first = F.sequence(F.lit(0), F.greatest(F.size(hashed) - n, F.lit(0)))
    several = F.transform(first, lambda i: F.xxhash64(*(F.get(F.col(hashed), i + k) for k in range(n))))
    rows = rows.withColumn(hashed, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    rows = rows.withColumn(shingles, F.when(F.size(hashed) == 0, F.array().cast("array<bigint>")).otherwise(several))
    under = F.filter(shingles, lambda h: h < limit)
    kept = F.sort_array(F.array_union(under, F.array_compact(F.array(F.array_min(shingles)))))
    return rows.withColumn(out, kept).drop(hashed, shingles)


def fingerprint_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of the shingle sets: shared share of both sketches."""
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_empty, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller shingle set that the larger holds."""
    least = F.least(F.size(a), F.size(b))
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_empty, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def rank_bounds(ids: DataFrame, n: int) -> list[int]:
    """At most BINS + 1 quantiles of `ids` (rank), the least and the largest of the sample among them."""
    share = max(1, n // MAX_SAMPLE)
    found = sorted(r[0] for r in ids.where(F.pmod(F.xxhash64("rank"), F.lit(share)) == 0).select("rank").collect())
    return sorted({found[(len(found) - 1) * k // BINS] for k in range(BINS + 1)}) if found else []


def block_of(rank: Column, bounds: list[int], blocks: int) -> Column:
    """The block of a rank, which never falls: its place between two bounds, interpolated."""
    if len(bounds) < 2 or blocks < 2:
        return F.lit(0).cast("long")
    # first among every 32nd bound, then among those that follow
    coarse = F.size(F.filter(F.array(*(F.lit(b) for b in bounds[::32])), lambda b: b <= rank))
    groups = [bounds[k : k + 32] for k in range(0, len(bounds), 32)]
    groups[-1] += [(1 << 63) - 1] * (32 - len(groups[-1]))
    fine = F.element_at(F.array(*(F.array(*(F.lit(b) for b in g)) for g in groups)), F.greatest(coarse, F.lit(1)))
    bin_ = (F.greatest(coarse, F.lit(1)) - 1) * 32 + F.size(F.filter(fine, lambda b: b <= rank)) - 1
    bin_ = F.least(F.greatest(bin_, F.lit(0)), F.lit(len(bounds) - 2))
    every = F.array(*(F.lit(b) for b in bounds))
    low, high = F.get(every, bin_).cast("double"), F.get(every, bin_ + 1).cast("double")
    inside = F.least(F.greatest((rank.cast("double") - low) / F.greatest(high - low, F.lit(1.0)), F.lit(0.0)), F.lit(0.999999))
    return F.floor((bin_ + inside) * (blocks / (len(bounds) - 1)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, hashes, next_text, next_hashes: each document with the next by doc_id, the last with the first."""
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), rank.alias("rank"))
    n = rows.count()
    blocks = min(MAX_BLOCKS, max(1, n // BLOCK))
    plain = rows.withColumn("block", block_of(F.col("rank"), rank_bounds(rows, n), blocks))
    firsts = materialise(plain.groupBy("block").agg(F.min("rank").alias("rank")), "fingerprint-blocks")
    # at most MAX_BLOCKS rows of two numbers
    heads = plain.join(F.broadcast(firsts), ["block", "rank"]).groupBy("block").agg(F.min("text").alias("text"))
    heads = with_sketch(heads, "text", "hashes").select("block", F.struct("text", "hashes").alias("head"))
    heads = heads.join(_block_before(firsts.select("block")), "block").select(F.col("before").alias("block"), "head")
    order = Window.partitionBy("block").orderBy("rank", "text")
    led = with_sketch(plain, "text", "hashes").withColumn("after", F.lead(F.struct("text", "hashes")).over(order))
    after = F.coalesce("after", "head")
    led = led.join(heads, "block", "left")
    return led.select("doc_id", "text", "hashes", after["text"].alias("next_text"), after["hashes"].alias("next_hashes"))


def _block_before(blocks: DataFrame, group: int = 4096) -> DataFrame:
    """block, before: the block in front of each, the last one's for the first; windows over groups, then over groups of groups."""
    grouped = blocks.withColumn("g", F.floor(F.col("block") / group))
    ends = grouped.groupBy("g").agg(F.max("block").alias("end"))
    last = ends.agg(F.max("end")).first()[0]
    ends = ends.select("g", F.lag("end").over(Window.partitionBy(F.lit(0)).orderBy("g")).alias("end_before"))
    within = grouped.withColumn("inside", F.lag("block").over(Window.partitionBy("g").orderBy("block")))
    found = within.join(ends, "g").select("block", F.coalesce("inside", "end_before").alias("before"))
    return found.withColumn("before", F.coalesce("before", F.lit(last).cast("long")))


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_sketch(with_next(docs).withColumn("edited", edited), "edited", "edited_hashes")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "edited",
        fingerprint_text(F.col("hashes")).alias("fingerprint"),
        fingerprint_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
        containment(F.col("hashes"), F.col("edited_hashes")).alias("within_edited"),
        containment(F.col("hashes"), F.col("next_hashes")).alias("within_next"),
    )
