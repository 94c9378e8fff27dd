"""Table functions for SQL: `SELECT ... FROM documents d, LATERAL chunk_text(d.text) c`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import cut_points


class ChunkText:
    """chunk_index, content, char_count of a text's windows, blank ones dropped; a null text has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        parts = ((text or "")[s:e].strip() for s, e in cut_points(text or ""))
        for i, part in enumerate(p for p in parts if p):
            yield i, part, len(part)


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="chunk_index int, content string, char_count int", useArrow=True))
