"""The registered queries of the operators of this package, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bin_slack import pack_windows
from .bpe import encode_and_decode
from .common import table
from .exact_dedup import exact_dedup
from .fingerprint import compare_with_edited
from .hmm import score
from .language_id import fit, fold_of, identify
from .line_dedup import drop_frequent_lines
from .packing import pack
from .simhash import near_duplicates
from .spelling import spelling_groups
from .url_filter import SPAM_WORDS, has_word, host_of, judge_urls
from .warc import round_trip
from .whitening import whiten

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 5) == 1)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_with_edited(table(spark, sf_dir, "documents"))
    return out.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    out = identify(docs, fit(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, bad of the pages with an outcome: bad if the host carries a word of SPAM_WORDS, else as the document is that the path names."""
    bad = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    named = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"/[a-z]{2}/([0-9]{1,18})", 1).try_cast("long").alias("doc_id"))
    met = named.join(bad, "doc_id", "left")
    return met.select("host", F.when(has_word(F.col("host"), SPAM_WORDS), True).otherwise(F.col("bad")).alias("bad")).where("bad IS NOT NULL")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), RULES)


def op11_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_windows(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_packing": op2_packing,
    "op3_hmm_score": op3_hmm_score,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe": op5_bpe,
    "op6_fingerprint": op6_fingerprint,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_url_filter": op10_url_filter,
    "op11_bin_slack": op11_bin_slack,
    "op12_spelling": op12_spelling,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
 count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op4_line_dedup": """
WITH lines AS (
 SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line
 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
freq AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, freq.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN freq ON keyed.k = freq.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op12_spelling": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
lowered AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+') AS runs FROM documents WHERE text IS NOT NULL),
each AS (SELECT head, unnest(runs) AS run FROM lowered), met AS (SELECT head, run, count(*) AS n FROM each GROUP BY 1, 2),
bytes AS (SELECT *, hex(encode(head || run)) AS x FROM met),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) AS h FROM bytes, crc),
kept AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
plain AS (SELECT *, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!"#$%&()*+,-./:;<=>?@[]^_{|}') AS p FROM vocab),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM plain a JOIN plain b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND a.word <> b.word AND levenshtein(a.p, b.p) = 1),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most, arg_min(near, {'less': -near_n, 'near': near}) AS near FROM near GROUP BY 1),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN near END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n FROM vocab v LEFT JOIN best b ON b.word = v.word),
chain AS (SELECT word, word AS root, 0 AS steps FROM forms UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY 1)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN roots r ON r.word = f.word""",
}
