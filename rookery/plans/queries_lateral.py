"""Table functions called from SQL, with their DuckDB twins."""

from __future__ import annotations

from ..functions import tables
from .queries_corpus import CHUNKS
from .registry import query


@query("t1_chunk_text_lateral", CHUNKS + " SELECT doc_id, chunk_index, content, length(content) AS char_count FROM chunks")
def chunk_text_lateral(d):
    tables.register(d.spark)
    return d.sql("SELECT d.doc_id, c.chunk_index, c.content, c.char_count FROM documents d, LATERAL chunk_text(d.text) c")


@query("t1_chunks_by_language", CHUNKS + " SELECT lang, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM chunks c JOIN documents d ON d.doc_id = c.doc_id GROUP BY 1")
def lateral_by_language(d):
    tables.register(d.spark)
    return d.sql("SELECT d.lang, count(*) AS chunks, CAST(sum(c.char_count) AS BIGINT) AS chars FROM documents d, LATERAL chunk_text(d.text) c GROUP BY d.lang")
