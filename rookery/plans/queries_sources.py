"""Files written from stored tables and read back, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as S
from ..sources.shared import shared_path
from .registry import query


@query("s2_append_rows", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'made' ELSE CAST(o_orderkey AS VARCHAR) END AS id, o_totalprice AS price FROM orders")
def append_rows(d):
    path = shared_path(d.spark, "appended")
    rows = d.orders.select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).alias("id"), F.col("o_totalprice").alias("price"), "o_orderkey")
    for part in (0, 1):
        S.append_rows(rows.where(F.col("o_orderkey") % 2 == part).drop("o_orderkey"), path)
    return d.spark.read.parquet(path).select(F.when(F.length("id") == 36, "made").otherwise(F.col("id")).alias("id"), "price")


@query(
    "s5_csv_corpus",
    """SELECT 'key: ' || c_custkey || ', name: ' || c_name || ', note: one' || chr(10) || 'two, ' || c_mktsegment AS record FROM customer
 UNION ALL SELECT 's_suppkey: ' || s_suppkey || ', s_name: ' || s_name FROM supplier UNION ALL SELECT 'p_partkey: ' || p_partkey || ', p_brand: ' || p_brand FROM part""",
)
def csv_corpus(d):
    """Three headers, two delimiters, line breaks inside of fields."""
    path = shared_path(d.spark, "csv")
    note = F.concat(F.lit("one\ntwo, "), "c_mktsegment")
    d.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), note.alias("note")).write.option("header", True).csv(f"{path}/a")
    d.supplier.select("s_suppkey", "s_name").write.option("header", True).csv(f"{path}/b")
    d.part.select("p_partkey", "p_brand").write.option("header", True).option("sep", ";").csv(f"{path}/c")
    return S.read_csv_corpus(d.spark, f"{path}/*").select("record")


@query("s6_text_corpus", "SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS lines, sum(length(c_name)) AS chars FROM customer GROUP BY 1")
def text_corpus(d):
    path = shared_path(d.spark, "texts")
    d.customer.select(F.col("c_nationkey").alias("nation"), "c_name").repartition("nation").write.partitionBy("nation").text(path)
    texts = S.read_text_corpus(d.spark, f"{path}/*")
    nation = F.regexp_extract("path", "nation=([0-9]+)", 1).cast("long")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    rows = texts.select(nation.alias("nation"), F.explode(lines).alias("line"))
    return rows.groupBy("nation").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("line")).alias("chars"))


@query(
    "s8_classify_files",
    """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'ole' WHEN 3 THEN 'png' WHEN 4 THEN 'jpeg' WHEN 5 THEN 'gif' WHEN 6 THEN 'csv' ELSE 'unknown' END AS kind,
 CASE doc_id % 8 WHEN 6 THEN 0.6 WHEN 7 THEN 0.1 ELSE 0.95 END AS confidence FROM documents""",
)
def classify_files(d):
    heads = F.array(*(F.lit(m) for m, _ in S.MAGIC), F.lit(""), F.lit(""))
    kind = (F.col("doc_id") % 8).cast("int")
    content = F.concat(F.unhex(F.get(heads, kind)), F.encode("text", "UTF-8"))
    files = d.documents.select("doc_id", F.concat(F.lit("/in/"), "doc_id", F.when(kind == 6, ".CSV").otherwise(".bin")).alias("path"), content.alias("content"))
    found = S.classify_files(files).withColumn("doc_id", F.regexp_extract("path", "/in/([0-9]+)", 1).cast("long"))
    return found.select("doc_id", "kind", F.col("confidence").cast("double").alias("confidence"))


@query(
    "s10_export_chat",
    """SELECT id, employee_id, coalesce(employee_name, '') AS employee_name, coalesce(sentiment, '') AS sentiment, user_message, coalesce(source_document, '') AS source_document,
 CAST(total_tokens AS VARCHAR) AS total_tokens FROM chat_history""",
)
def export_chat(d):
    path = shared_path(d.spark, "export")
    broken = d.chat_history.withColumn("user_message", F.replace("user_message", F.lit(" "), F.lit("\n")))
    S.export_chat_csv(broken, path)
    names = ["id", "timestamp", "employee_id", "employee_name", "category", "sentiment", "user_message", "bot_response", "source_document", "total_tokens"]
    back = d.spark.read.option("header", True).option("nullValue", "\0").option("emptyValue", "").schema(", ".join(f"{n} string" for n in names)).csv(path)
    return back.select("id", "employee_id", "employee_name", "sentiment", "user_message", "source_document", "total_tokens")


@query("s15_union_knowledge", "SELECT CAST(doc_id AS VARCHAR) AS id, source AS file, NULL AS url FROM documents UNION ALL SELECT CAST(page_id AS VARCHAR), NULL, url FROM pages")
def union_knowledge(d):
    files = d.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("file"))
    return S.union_knowledge([files, d.pages.select(F.col("page_id").cast("string").alias("id"), "url")]).select("id", "file", "url")


@query(
    "s16_document_catalog",
    "SELECT company_id, count(*) AS documents, sum(page_count) AS chunks FROM document_sources GROUP BY 1",
)
def document_catalog(d):
    path = shared_path(d.spark, "catalog")
    chunks = d.document_sources.select("company_id", F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1).cast("long"), "page_count")).alias("chunk_index"))
    S.write_catalog(d.document_sources, chunks.withColumn("embedding", F.lit(None).cast("array<double>")), path)
    docs, parts = (d.spark.read.parquet(f"{path}/{n}").groupBy(F.col("company_id").cast("string").alias("company_id")).agg(F.count(F.lit(1)).alias(n)) for n in ("documents", "chunks"))
    return docs.join(parts, "company_id").select("company_id", "documents", F.col("chunks").cast("long").alias("chunks"))
