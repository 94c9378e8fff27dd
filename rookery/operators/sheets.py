"""Sheets as cell grids: records, metadata, rendering, and repair of stored tables and damaged text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .refine import date_like

#: Page marks and boilerplate that text repair removes, and marks that it makes plain.
BOILERPLATE = [r"(?m)^--- Page [0-9]+ ---$", r"(?i)all rights reserved\.?", r"(?i)confidential"]
FANCY, PLAIN = "“”‘’–—…", "\"\"''--."
#: Unnamed columns.
PLACEHOLDER = r"^(|C[0-9]+|Unnamed.*|Column ?[0-9]+|[0-9]+|nan|None|col_[0-9]+|Field[0-9]+)$"


def sheet_records(grid: DataFrame, most_rows: int = 5000) -> DataFrame:
    """Each non-empty row of a sheet as `a | b | c`, in the first rows that a sheet may have."""
    cells = F.transform(F.sort_array(F.collect_list(F.when(F.col("value") != "", F.struct("col_no", "value")))), lambda x: x["value"])
    rows = grid.where(F.col("row_no") <= most_rows).groupBy("doc_id", "table_no", "row_no").agg(cells.alias("cells"))
    return rows.where(F.size("cells") > 0).select("doc_id", "table_no", "row_no", F.array_join("cells", " | ").alias("record"))


def sheet_content(grid: DataFrame) -> DataFrame:
    """All non-empty cells of a sheet joined by spaces, with section and source."""
    cells = F.transform(F.sort_array(F.collect_list(F.when(F.col("value") != "", F.struct("row_no", "col_no", "value")))), lambda x: x["value"])
    return grid.groupBy("doc_id", "table_no").agg(F.array_join(cells, " ").alias("content")).withColumns({"section": F.concat(F.lit("sheet "), F.col("table_no")), "source": F.concat(F.lit("doc-"), F.col("doc_id"))})


def sheet_profile(grid: DataFrame) -> DataFrame:
    """Rows, columns and share of filled cells of each sheet."""
    return grid.groupBy("doc_id", "table_no").agg(
        F.max("row_no").alias("rows"), F.max("col_no").alias("columns"), F.round(F.avg((F.col("value") != "").cast("int")), 6).alias("fill_rate")
    )


def sheet_metadata(grid: DataFrame, headers: DataFrame, samples: int = 10) -> DataFrame:
    """Per sheet, JSON of its columns and of those that hold dates by their first values."""
    order = Window.partitionBy("doc_id", "table_no", "col_no").orderBy("row_no")
    first = grid.where("row_no > 1 AND value <> ''").withColumn("n", F.row_number().over(order)).where(F.col("n") <= samples)
    share = first.groupBy("doc_id", "table_no", "col_no").agg(F.avg(F.coalesce(date_like(F.col("value")), F.lit(False)).cast("int")).alias("share"))
    rows = headers.join(share, ["doc_id", "table_no", "col_no"], "left")
    ordered = F.sort_array(F.collect_list(F.struct("col_no", "name", (F.coalesce("share", F.lit(0.0)) >= 0.7).alias("date"))))
    meta = F.struct(F.transform(ordered, lambda x: x["name"]).alias("columns"), F.transform(F.filter(ordered, lambda x: x["date"]), lambda x: x["name"]).alias("dates"))
    return rows.groupBy("doc_id", "table_no").agg(F.to_json(meta).alias("metadata"))


def clean_names(headers: DataFrame) -> DataFrame:
    """Column names trimmed of marks and white space; blank ones numbered by their column."""
    name = F.trim(F.regexp_replace(F.regexp_replace("name", r"[\r\n\t]+", " "), r"[*#:]+", ""))
    return headers.withColumn("name", F.when(name == "", F.concat(F.lit("C"), F.col("col_no"))).otherwise(name))


def placeholder_columns(headers: DataFrame) -> DataFrame:
    return headers.where(F.col("name").rlike(PLACEHOLDER))


def render_sheet(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Each sheet as text: its columns as a list, a line a row, and its size."""
    keys = ["doc_id", "table_no"]
    names = headers.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "name"))), lambda x: F.concat(F.lit("- "), x["name"])), "\n").alias("head"))
    rows = sheet_records(grid.where("row_no > 1"))
    body = rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "record"))), lambda x: x["record"]), "\n").alias("body"), F.count(F.lit(1)).alias("n"))
    out = names.join(body, keys, "left")
    return out.select(*keys, F.concat_ws("\n", "head", "body", F.concat(F.lit("rows: "), F.coalesce("n", F.lit(0)))).alias("text"))


def rewrite_placeholders(text: Column, mark: str = "-") -> Column:
    """Placeholder cells of pipe-table lines rewritten; other lines stay."""
    cell = lambda c: F.when(F.trim(c).rlike(r"(?i)^(nan|none|null|unnamed.*)$"), F.lit(f" {mark} ")).otherwise(c)
    line = lambda x: F.when(x.contains("|"), F.array_join(F.transform(F.split(x, r"\|"), cell), "|")).otherwise(x)
    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def repair_text(text: Column) -> Column:
    """Boilerplate removed, marks made plain, spaces collapsed within lines."""
    out = text
    for pattern in BOILERPLATE:
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(F.translate(out, FANCY, PLAIN), "[ \t]+", " "))


def header_keywords(grid: DataFrame, words: list[str]) -> DataFrame:
    """Rows whose text has a header word."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "value"))), lambda x: F.lower(x["value"])), " ")
    rows = grid.groupBy("doc_id", "table_no", "row_no").agg(text.alias("text"))
    return rows.where(F.col("text").rlike("|".join(words))).select("doc_id", "table_no", "row_no")


def extraction_score(jobs: DataFrame) -> DataFrame:
    """Score of each extraction: 40 if it ended, 30 with text, 20 without damage, and up to 10 by sections."""
    score = 40 * F.col("done").cast("int") + 30 * (F.col("chars") > 0).cast("int") + 20 * (~F.col("damaged")).cast("int") + F.least(F.lit(10.0), F.col("sections") / 10)
    return jobs.select("id", F.round(score, 6).alias("score"))
