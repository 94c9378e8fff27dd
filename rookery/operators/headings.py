"""Sections of texts by their headings, for plain text files and for word-processor texts.

Lines are told apart by window functions over a document's lines; a section is a running number of headings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A heading of a plain text: perhaps a number, chapter or mark, then letters up to a colon, comma or stop.
TEXT_HEADING = r"^(?:\d+[\.\s]+|第\d+[章節]\s+|[\*\#]+\s+)?([A-Za-z\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FAF}]{2,}[：:、。])"
#: Headings of a word-processor text; the first pattern that matches gives the title.
WORD_HEADINGS = [
    r"^(?:\d+\.?\s+)(.+)$",
    r"^(?:[IVXLC]+\.?\s+)(.+)$",
    r"^(?:[A-Z]\.?\s+)(.+)$",
    r"^(?:第\d+[章節条項])\s*(.*)$",
    r"^(?:●|■|▲|◆)\s*(.+)$",
    r"^(?:\*+|\#+)\s*(.+)$",
]
#: Names of what comes before the first heading, and of a text without sections.
TEXT_LEAD, WORD_LEAD, WHOLE = "一般情報", "概要", "全体"
BLANK = r"[ \t\r\n\x0b\f\x{3000}]+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}|{BLANK}$", "")


def _numbered(docs: DataFrame, title: Column, lead: str) -> DataFrame:
    """doc_id, section, title, content: the sections with content; `title` is null for a line that is no heading."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "raw"))
    lines = lines.select("doc_id", "i", stripped(F.col("raw")).alias("line")).where("line <> ''").withColumn("title", title)
    order = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.count("title").over(order))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("i", "line")))), lambda x: x["line"])
    found = rows.groupBy("doc_id", "section").agg(F.coalesce(F.max("title"), F.lit(lead)).alias("title"), F.array_join(body, "\n").alias("content"))
    return found.where("content <> ''")


def text_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, title, content: sections of plain texts; a heading is the whole line, sections of one title stay apart."""
    return _numbered(docs, F.when(F.col("line").rlike(TEXT_HEADING), F.col("line")), TEXT_LEAD)


def word_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, title, content: sections of word-processor texts by six kinds of heading.

    Of sections of one title the last one's content stays, at the place of the first; a text without any is
    one section.
    """
    title = F.lit(None).cast("string")
    for pattern in reversed(WORD_HEADINGS):
        own = F.coalesce(F.nullif(stripped(F.regexp_extract("line", pattern, 1)), F.lit("")), F.col("line"))
        title = F.when(F.col("line").rlike(pattern), own).otherwise(title)
    found = _numbered(docs, title, WORD_LEAD)
    kept = found.groupBy("doc_id", "title").agg(F.min("section").alias("section"), F.max_by("content", "section").alias("content"))
    bare = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = bare.select("doc_id", F.lit(WHOLE).alias("title"), F.lit(0).cast("long").alias("section"), F.coalesce("text", F.lit("")).alias("content"))
    return kept.unionByName(whole).select("doc_id", "section", "title", "content")
