"""Searches in titles, partial matches and explained ranks, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extras as X
from ..operators import retrieval as R
from .queries_corpus import BM25, CHUNKS, KEYWORDS, WORDS, chunks_of, keyword_table, questions
from .registry import query


@query(
    "w10_explained_ranks",
    CHUNKS
    + KEYWORDS
    + BM25
    + """ SELECT query_id, chunk_id, rank, score, '#' || rank || ' ' || CASE WHEN score >= 0.8 THEN 'very close' WHEN score >= 0.5 THEN 'close' ELSE 'loose' END || ' score ' || printf('%.2f', score) AS reason
 FROM bm WHERE rank <= 10""",
)
def explained_ranks(d):
    return X.explain_ranks(R.bm25(keyword_table(d), chunks_of(d), 10)).select("query_id", "chunk_id", "rank", "score", "reason")


@query(
    "r11_title_content_search",
    CHUNKS
    + KEYWORDS
    + f""", title AS (SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS name FROM documents),
 tw AS (SELECT DISTINCT doc_id, unnest({WORDS.format(t="name", n=1)}) AS keyword FROM title),
 b AS (SELECT query_id, chunk_id, 3.0 AS score FROM kw JOIN tw ON tw.keyword = kw.keyword JOIN chunks c ON c.doc_id = tw.doc_id UNION ALL SELECT query_id, chunk_id, 2.0 FROM hits),
 m AS (SELECT query_id, chunk_id, CAST(max(score) AS DOUBLE) AS score FROM b GROUP BY 1, 2)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m) AS r WHERE rank <= 10""",
)
def title_content_search(d):
    titles = d.documents.select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("name"))
    return X.title_content_search(keyword_table(d), chunks_of(d), titles).select("query_id", "chunk_id", "score", "rank")


@query(
    "r7_partial_match",
    CHUNKS
    + KEYWORDS
    + BM25
    + """, first AS (SELECT query_id, chunk_id FROM bm WHERE rank <= 10 AND score >= 17), few AS (SELECT DISTINCT kw.query_id FROM kw WHERE kw.query_id NOT IN (SELECT query_id FROM first GROUP BY 1 HAVING count(*) >= 5)),
 many AS (SELECT query_id, count(*) AS many FROM kw GROUP BY 1), f AS (SELECT h.query_id, h.chunk_id, count(*) AS matched FROM hits h JOIN few ON few.query_id = h.query_id GROUP BY 1, 2),
 s AS (SELECT f.query_id, f.chunk_id, round(0.8::DOUBLE * matched / many, 6) AS score FROM f JOIN many m ON m.query_id = f.query_id
 WHERE NOT EXISTS (SELECT 1 FROM first x WHERE x.query_id = f.query_id AND x.chunk_id = f.chunk_id))
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) AS r WHERE rank <= 10""".replace(" s AS (SELECT f.", " part AS (SELECT f.").replace("FROM s) AS r", "FROM part) AS r"),
)
def partial_match(d):
    keywords, chunks = keyword_table(d), chunks_of(d)
    hits = R.bm25(keywords, chunks, 10).where("score >= 17")
    return R.partial_match(questions(d), keywords, hits, chunks).select("query_id", "chunk_id", "score", "rank")
