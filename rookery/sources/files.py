"""Files in and out: CSV of mixed encodings and delimiters, text corpora, file kinds, exports."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import islice, zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings and delimiters tried, in this order.
ENCODINGS = ["utf-8", "shift_jis", "cp932", "euc-jp", "iso-2022-jp"]
DELIMITERS = [",", ";", "\t", "|"]
#: First bytes of file kinds, in hexadecimal.
MAGIC = [("25504446", "pdf"), ("504B0304", "zip"), ("D0CF11E0", "ole"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif")]


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """path, extension, kind, confidence of every file of a folder."""
    return classify_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def classify_files(files: DataFrame) -> DataFrame:
    """path, extension, kind, confidence of files (path, content): first bytes count more than names."""
    start = F.hex(F.substring("content", 1, 16))
    kind: Column = F.lit(None).cast("string")
    for magic, name in MAGIC:
        kind = F.when(start.startswith(magic), name).otherwise(kind)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    named = F.when(extension.isin("csv", "txt", "md", "html", "json"), extension)
    rows = files.select("path", extension.alias("extension"), kind.alias("magic"), named.alias("named"))
    return rows.select("path", "extension", F.coalesce("magic", "named", F.lit("unknown")).alias("kind"), F.when(F.col("magic").isNotNull(), 0.95).when(F.col("named").isNotNull(), 0.6).otherwise(0.1).alias("confidence"))


def decode_text(raw: bytes) -> tuple[str, str]:
    """Encoding and text: the first encoding that decodes all bytes cleanly, else the first that decodes them, else Latin-1.

    Texts of ISO-2022-JP are ASCII to the others and known by their escapes; a text whose characters beyond
    ASCII are half-width kana by more than a fifth is not clean, as EUC-JP reads so in Shift JIS.
    """
    first = None
    order = [ENCODINGS[-1], *ENCODINGS[:-1]] if b"\x1b$" in raw or b"\x1b(" in raw else ENCODINGS
    for name in order:
        try:
            text = raw.decode(name).removeprefix("\ufeff")
        except UnicodeDecodeError:
            continue
        first = first or (name, text)
        if 5 * len(re.findall("[｡-ﾟ]", text)) <= len(re.findall(r"[^\x00-\x7f]", text)):
            return name, text
    return first or ("iso-8859-1", raw.decode("iso-8859-1"))


def delimiter_of(text: str, lines: int = 10) -> str:
    """The delimiter that gives the first records the most columns with at most two widths; the first of equals."""
    best, found = None, DELIMITERS[0]
    for d in DELIMITERS:
        widths = [len(r) for r in islice((r for r in csv.reader(io.StringIO(text, newline=""), delimiter=d) if r), lines)]
        most = max(widths, default=0)
        rank = (most > 1, len(set(widths)) <= 2, most)
        if best is None or rank > best:
            best, found = rank, d
    return found


def _csv_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path", "content")


def csv_dialects(spark: SparkSession, path: str) -> DataFrame:
    """path, encoding, delimiter of every CSV file of a folder, from all its bytes."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = [decode_text(bytes(c)) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "encoding": [e for e, _ in known], "delimiter": [delimiter_of(t) for _, t in known]})

    return _csv_files(spark, path).mapInPandas(each, "path string, encoding string, delimiter string")


def read_csv_corpus(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    """file, record_no, record of all CSV files of a folder: each with its own encoding, delimiter and header.

    Files are read side by side, one task a file; quoted fields may hold line breaks. A field beyond the
    header is named by its number, a missing one is empty. Spark refuses files beyond
    `spark.sql.sources.binaryFile.maxLength`.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                text = decode_text(bytes(content))[1]
                records = (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter_of(text)) if r)
                header = next(records, [])
                named = ([*zip_longest(header, r[: len(header)], fillvalue=""), *((i + 1, r[i]) for i in range(len(header), len(r)))] for r in records)
                numbered = enumerate(", ".join(f"{h}: {v}" for h, v in r) for r in named)
                while some := list(islice(numbered, rows)):
                    yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "record_no": [i for i, _ in some], "record": [r for _, r in some]})

    return _csv_files(spark, path).mapInPandas(each, "file string, record_no long, record string")


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every text file of a folder."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def export_chat_csv(chat: DataFrame, path: str) -> None:
    """Ten columns, line breaks and tabs as spaces, all fields quoted, a header, no byte order mark."""
    columns = ["id", "timestamp", "employee_id", "employee_name", "category", "sentiment", "user_message", "bot_response", "source_document", "total_tokens"]
    plain = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n\t]", " ").alias(c) for c in columns]
    chat.select(*plain).write.option("quoteAll", True).option("header", True).csv(path)


def append_rows(df: DataFrame, path: str, key: str = "id") -> None:
    """Append, with an id where it is null."""
    df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.uuid())).write.mode("append").parquet(path)


def union_knowledge(parts: list[DataFrame]) -> DataFrame:
    """The rows of all sources; a column that a source lacks is null there."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def write_catalog(docs: DataFrame, chunks: DataFrame, path: str) -> None:
    """Documents and chunks, each partitioned by company, for pruning by tenant."""
    docs.write.partitionBy("company_id").parquet(f"{path}/documents")
    chunks.write.partitionBy("company_id").parquet(f"{path}/chunks")
