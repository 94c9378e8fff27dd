"""Documents to chunks, sections, quality scores and table cells."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import token_estimate

SIZE, LEAST, OVERLAP = 700, 600, 50
#: Chunks that a task puts out at once.
ROWS = 1_000


def cut_points(text: str, size: int = SIZE, least: int = LEAST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Greedy windows: an end moves back to after the last newline or else space of its last `overlap` characters."""
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            for mark in ("\n", " "):
                if (at := text.rfind(mark, end - overlap, end)) >= 0:
                    end = at + 1
                    break
        end = min(end, len(text))
        out.append((start, end))
        if end >= len(text):
            break
        start = max(start + least, end - overlap)
    return out


def chunk_documents(docs: DataFrame, size: int = SIZE, least: int = LEAST, overlap: int = OVERLAP, name: Column | None = None) -> DataFrame:
    """doc_id, chunk_index, content, char_count, token_count: windows of each document, blanks dropped.

    A task holds one document as a Python text and about ROWS chunks at a time, whatever the size of its batches.
    `name`, a text of the document, becomes a column of its chunks, so that they need not be joined with it.
    """
    named = name is not None
    types = {"doc_id": pa.int64(), "chunk_index": pa.int32(), "content": pa.string()} | ({"name": pa.string()} if named else {})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = tuple([] for _ in types)
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types.values(), strict=True)], list(types))
        for b in batches:
            for doc_id, text, *own in zip(*b.columns, strict=True):
                doc_id, text, own = doc_id.as_py(), text.as_py(), [x.as_py() for x in own]
                number = 0
                for s, e in cut_points(text, size, least, overlap):
                    if part := text[s:e].strip():
                        for column, value in zip(out, (doc_id, number, part, *own), strict=True):
                            column.append(value)
                        number += 1
                        if len(out[0]) >= ROWS:
                            yield batch()
                            out = tuple([] for _ in types)
        if out[0]:
            yield batch()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *([name.alias("name")] if named else []))
    rows = rows.mapInArrow(cut, "doc_id long, chunk_index int, content string" + ", name string" * named)
    return rows.withColumns({"char_count": F.char_length("content"), "token_count": token_estimate(F.col("content"))})


def chunk_report(chunks: DataFrame, least: int = LEAST, most: int = 800) -> DataFrame:
    """Chunks by document: count, sizes, words, spread, and how many are too long or short."""
    n = F.col("char_count")
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.round(F.avg(n), 6).alias("mean_chars"),
        F.min(n).alias("least_chars"),
        F.max(n).alias("most_chars"),
        F.round(F.var_pop(n), 4).alias("variance"),
        F.sum((n > most).cast("long")).alias("oversize"),
        F.sum((n < least).cast("long")).alias("undersize"),
    )


def html_text(html: Column) -> Column:
    """Visible text: scripts and styles dropped, tags removed, lines trimmed, empties dropped; null under 10 characters."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    text = F.array_join(lines, "\n")
    return F.when(F.char_length(text) >= 10, text)


def url_route(url: Column) -> Column:
    """Where an address goes: video, pdf, html; null if it has no host."""
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    kind = F.when(F.lower(full).rlike(r"youtube\.com|youtu\.be|vimeo\.com"), "video").when(F.lower(full).rlike(r"\.pdf($|[?#])"), "pdf").otherwise("html")
    return F.when(full.rlike(r"^https?://[^/?#]+"), kind)


def text_quality(text: Column) -> Column:
    """0 to 100: share of ordinary characters, line structure, meaningful lines, length."""
    n = F.greatest(F.char_length(text), F.lit(1))
    ordinary = F.char_length(F.regexp_replace(text, r"[^A-Za-z0-9À-ÿ .,;:!?\n]", "")) / n
    lines = F.split(text, "\n")
    meaningful = F.size(F.filter(lines, lambda x: F.char_length(F.trim(x)) >= 10)) / F.size(lines)
    length = F.least(F.char_length(text) / 1000, F.lit(1.0))
    return 50 * ordinary + 30 * meaningful + 20 * length


def corruption_flags(text: Column) -> dict[str, Column]:
    """Tests for damaged text: marks in number, marks in share, replacement characters, long runs, control characters."""
    marks = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[$%&*#@^~]", ""))
    n = F.greatest(F.char_length(text), F.lit(1))
    return {
        "many_marks": marks > 30,
        "share_of_marks": marks / n > 0.05,
        "replacement": text.contains("�"),
        "long_runs": text.rlike(r"[^ ]{40}"),
        "control": text.rlike(r"[\x00-\x08\x0e-\x1f]"),
    }


def corpus_quality(docs: DataFrame) -> DataFrame:
    """Quality and flags by language and source."""
    text = F.coalesce("text", F.lit(""))
    flags = corruption_flags(text)
    rows = docs.select("lang", "source", text_quality(text).alias("quality"), *(c.cast("long").alias(k) for k, c in flags.items()))
    return rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 5).alias("quality"), *(F.sum(k).alias(k) for k in flags))


def sections(docs: DataFrame, heading: str = r"^[^|]{1,30}\.$") -> DataFrame:
    """doc_id, section, heading, n_lines, content: a line that is a heading starts a section; those before it are section 0."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    starts = F.col("line").rlike(heading)
    order = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.sum(starts.cast("int")).over(order)).withColumn("head", starts)
    body = F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("i", "line")))), lambda x: x["line"])
    return rows.groupBy("doc_id", "section").agg(
        F.max(F.when(F.col("head"), F.col("line"))).alias("heading"), F.sum((~F.col("head")).cast("long")).alias("n_lines"), F.array_join(body, "\n").alias("content")
    )


def pipe_tables(docs: DataFrame, least_cells: int = 3) -> DataFrame:
    """doc_id, table_no, row_no, col_no, value: runs of lines with enough cells between pipes, as a grid."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\|?|\|?\s*$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.withColumn("cells", cells).where((F.size("cells") >= least_cells) & ~F.col("line").rlike(r"^[\s|:-]+$"))
    order = Window.partitionBy("doc_id").orderBy("i")
    rows = rows.withColumn("new", F.coalesce(F.col("i") - F.lag("i").over(order) > 1, F.lit(True)).cast("int"))
    rows = rows.withColumn("table_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id", "table_no").orderBy("i")))
    return rows.select("doc_id", "table_no", "row_no", F.posexplode("cells").alias("col", "value")).select("doc_id", "table_no", "row_no", (F.col("col") + 1).alias("col_no"), "value")


def profile_columns(grid: DataFrame) -> DataFrame:
    """Each table's columns: cells, filled, share of numbers and a type."""
    number = F.col("value").rlike(r"^[-+]?[0-9][0-9,.]*$")
    stats = grid.groupBy("doc_id", "table_no", "col_no").agg(
        F.count(F.lit(1)).alias("cells"), F.sum((F.col("value") != "").cast("long")).alias("filled"), F.round(F.avg(number.cast("int")), 6).alias("numeric_share")
    )
    return stats.withColumn("kind", F.when(F.col("numeric_share") > 0.7, "numeric").otherwise("text"))


def fill_headers(grid: DataFrame) -> DataFrame:
    """First-row headers, blanks filled from the left, repeats numbered."""
    first = grid.where("row_no = 1")
    order = Window.partitionBy("doc_id", "table_no").orderBy("col_no")
    filled = first.withColumn("name", F.coalesce(F.last(F.nullif("value", F.lit("")), True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.concat(F.lit("C"), F.col("col_no"))))
    again = F.row_number().over(Window.partitionBy("doc_id", "table_no", "name").orderBy("col_no")) - 1
    return filled.withColumn("again", again).select("doc_id", "table_no", "col_no", F.when(F.col("again") > 0, F.concat_ws("_", "name", "again")).otherwise(F.col("name")).alias("name"))


def record_text(grid: DataFrame, headers: DataFrame, most: int = 800) -> DataFrame:
    """Each data row as `column: value` text, cut at `most` characters."""
    rows = grid.where("row_no > 1").join(headers, ["doc_id", "table_no", "col_no"])
    cell = F.concat(F.col("name"), F.lit(": "), F.when(F.col("value") == "", "-").otherwise(F.col("value")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("col_no", cell.alias("cell")))), lambda x: x["cell"])
    return rows.groupBy("doc_id", "table_no", "row_no").agg(F.left(F.array_join(ordered, ", "), F.lit(most)).alias("record"))
