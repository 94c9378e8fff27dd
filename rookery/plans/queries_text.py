"""Queries on damaged texts, cells, named sections, timestamps and traits of questions, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as P
from ..operators import damage as D
from ..operators import questions as Q
from .registry import query

#: Stored texts, most of them damaged in one way or another.
DAMAGED = """SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN concat(repeat('(cid:3)', 6), text) WHEN 2 THEN replace(text, ' ', chr(1)) WHEN 3 THEN concat('what??????', text)
 WHEN 4 THEN concat(repeat('ï¿½ ', 7), text) WHEN 5 THEN repeat('.', 30) WHEN 6 THEN concat(text, repeat(' ', 9 * length(text))) WHEN 7 THEN concat(text, '�')
 WHEN 8 THEN concat(text, CASE doc_id % 7 WHEN 0 THEN '縺ゅ→縺' WHEN 1 THEN '迺ｾ遶' WHEN 2 THEN '荳?蟋' WHEN 3 THEN '繧ｳ繝ｳ繝斐Η繝ｼ繧ｿ' WHEN 4 THEN concat('繧', chr(146), '繧', chr(147)) WHEN 5 THEN repeat('😀', 12) ELSE '���' END) ELSE text END AS t FROM documents"""
_SHARE = "len(regexp_extract_all(t, '{p}')) / greatest(length(t), 1)"
_SCRIPT = r"[A-Za-z\x{C0}-\x{24F}\x{3040}-\x{30FF}\x{4E00}-\x{9FAF}]"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def damaged_texts(d):
    return d.sql(DAMAGED)


@query(
    "t8_t10_damaged_texts",
    f"""WITH x AS ({DAMAGED}), s AS (SELECT doc_id, t, length(t) AS n, {_SHARE.format(p=_SCRIPT)} AS script, {_SHARE.format(p=chr(10))} AS breaks, {_SHARE.format(p=' ')} AS spaces,
 {_SHARE.format(p=_CONTROL)} AS controls, {_SHARE.format(p='[^' + chr(92) + 'x00-' + chr(92) + 'x7F]+')} AS runs, {_SHARE.format(p=chr(92) + 'p{L}')} AS letters,
 contains(t, '�') AS replaced, (length(t) - length(replace(t, '(cid:', ''))) / 5 AS codes, length(t) - length(replace(t, '�', '')) AS replaces, len(regexp_extract_all(t, '[\\x{{10000}}-\\x{{10FFFF}}]')) / greatest(length(t), 1) AS beyond, len(regexp_extract_all(t, 'ï¿½+')) + len(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}_\\t\\n\\x0b\\f\\r \\x{{3000}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FAF}}\\x{{3400}}-\\x{{4DBF}}]{{10,}}')) + len(regexp_extract_all(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9F}}]{{3,}}')) + len(regexp_extract_all(t, '[0-9]+\\(\\)\\[')) AS broken,
 list_max(list_transform(list_filter(list_distinct(string_split(t, '')), lambda c: c <> ''), lambda c: length(t) - length(replace(t, c, '')))) / greatest(length(t), 1) AS commonest,
 n < 50 AND NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]') AS bare FROM x)
 SELECT doc_id, trim(t) = '' OR replaced OR codes > 5 OR beyond > 0.1 OR (replaced::INT + (beyond > 0.05)::INT + (replaces > 10)::INT + bare::INT + (script < 0.05)::INT + (breaks > 0.6)::INT + (spaces > 0.8)::INT + (controls > 0.1)::INT + (n > 10 AND commonest > 0.3)::INT) >= 2 AS document,
 regexp_matches(t, '[?]{{5,}}') OR regexp_matches(t, '\\(cid:[0-9]+\\)') OR contains(t, '縺ゅ→縺') OR contains(t, '迺ｾ遶') OR contains(t, '荳?蟋') OR contains(t, '繧ｳ繝ｳ繝斐Η繝ｼ繧ｿ') OR contains(t, '繧' || chr(146) || '繧' || chr(147)) OR contains(t, '���') OR (n > 50 AND (controls > 0.15 OR runs > 1.0 / 3)) AS in_table,
 n >= 10 AND (broken > 5 OR broken * 100.0 / greatest(n, 1) > 2.0) AS page,
 trim(t) = '' OR replaced OR (length(trim(t)) < 50 AND NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]')) OR letters < 0.1 OR breaks > 0.5 AS image FROM s""",
)
def damaged(d):
    t, rows, few = F.col("t"), damaged_texts(d), d.spark.sparkContext.defaultParallelism
    rows = rows.repartition(4 * few) if len(d.documents.inputFiles()) < few else rows
    return rows.select("doc_id", D.damaged_document(t).alias("document"), D.damaged_table(t).alias("in_table"), D.damaged_page(t).alias("page"), D.damaged_image_text(t).alias("image"))


@query(
    "t16_named_sections",
    """WITH l AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS p FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents))
 SELECT doc_id, CASE WHEN i = 1 THEN 'main' ELSE 'part ' || (i - 1) END AS name, length(p) AS chars FROM l WHERE p <> ''""",
)
def named_sections(d):
    """Sentences marked as sections: the text between two marks comes back."""
    parts = F.split("text", r"\. ")
    marked = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("=== part "), i, F.lit(" ===\n"), p))), "\n")
    found = d.documents.where("text NOT LIKE '%===%'").select("doc_id", F.explode(D.named_sections(marked)).alias("s"))
    return found.select("doc_id", "s.name", F.char_length("s.content").alias("chars"))


@query(
    "t29_clean_cells",
    """SELECT doc_id, CASE WHEN length(t) > 1000 THEN trim(regexp_replace(left(t, 1000) || '...', '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g')) ELSE trim(regexp_replace(t, '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g')) END AS cell
 FROM (SELECT doc_id, trim(text) AS t FROM documents)""",
)
def clean_cells(d):
    wide = F.translate(F.left("text", F.lit(0)), "a", "a")
    return d.documents.select("doc_id", P.clean_cell(F.concat(wide, F.lit("  "), "text")).alias("cell"))


@query(
    "p11_valid_timestamps",
    """SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN NULL ELSE strftime(timestamp, '%Y-%m-%d %H:%M:%S') END AS at FROM chat_history""",
)
def valid_timestamps(d):
    text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    given = F.when(F.col("id").cast("long") % 3 == 0, F.concat(F.lit("on "), text)).otherwise(F.concat(F.lit(" "), text))
    return d.chat_history.select("id", F.date_format(P.valid_timestamp(given), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    "p20_counted_use",
    """SELECT employee_id, count(*) AS n FROM chat_history WHERE source_document IS NOT NULL AND source_document <> 'doc-7' AND CAST(employee_id AS BIGINT) % 10 <> 0 GROUP BY 1""",
)
def counted_use(d):
    role = F.when(F.col("employee_id").cast("long") % 10 == 0, "Admin").otherwise("user")
    source = F.when(F.col("source_document") == "doc-7", " Unknown").otherwise(F.col("source_document"))
    return d.chat_history.where(P.counts_as_use(role, source)).groupBy("employee_id").agg(F.count(F.lit(1)).alias("n"))


@query("t5_page_estimates", "SELECT doc_id, greatest(1, CASE WHEN doc_id % 2 = 0 THEN ceil(n_chars / 50) ELSE ceil(n_chars / 500) END)::BIGINT AS pages FROM documents")
def page_estimates(d):
    return d.documents.select("doc_id", P.page_estimate(F.col("n_chars"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).otherwise(0)).alias("pages"))


ASKED = """SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, CASE turn % 6 WHEN 0 THEN concat('Tell me: ', text, '?') WHEN 1 THEN concat(text, ' please.') WHEN 2 THEN concat('1. ', text, ' 2. ', text)
 WHEN 3 THEN concat(text, ' 表形式') WHEN 4 THEN concat('what? ', text, ' or not?') ELSE concat(text, ' システム 条件: ABC12') END AS t FROM conversations"""


@query(
    "q6_q14_q17_q29_question_traits",
    f"""WITH q AS ({ASKED}) SELECT id, trim(translate(trim(regexp_replace(trim(regexp_replace(trim(lower(t)), '^(?:please tell me|tell me|excuse me)[:：,、，\\s]*', '')), '(?:please)[。．.\\s]*$', '')), '？?', '')) AS query,
 (regexp_matches(t, '[？?].*[？?]') OR regexp_matches(t, '[123]\\.|[①②③]')) AND length(t) > 30 AS several,
 contains(t, '表形式') OR contains(t, '条件:') OR contains(t, '×') AS complex, contains(t, '表形式') AS in_table,
 array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(t, '[ア-ヴー]{{3,}}'), regexp_extract_all(t, '[A-Za-z0-9]{{3,}}')))), ',') AS keywords FROM q""",
)
def question_traits(d):
    t = F.col("t")
    return d.sql(ASKED).select(
        "id", Q.search_query(t).alias("query"), Q.has_several_tasks(t).alias("several"), Q.is_complex(t).alias("complex"), Q.asks_for_table(t).alias("in_table"), F.array_join(Q.segment_keywords(t), ",").alias("keywords")
    )


@query(
    "q12_merged_keywords",
    """SELECT employee_id, category, string_agg(k, ',' ORDER BY k) AS keywords FROM (SELECT DISTINCT employee_id, category, replace(source_document, 'doc-', 'name ') AS k FROM chat_history WHERE source_document IS NOT NULL) AS x
 WHERE k IS NOT NULL GROUP BY 1, 2 HAVING count(*) <= 10""",
)
def merged_keywords(d):
    words = F.array(F.concat(F.replace("source_document", F.lit("doc-"), F.lit("name ")), F.lit(" 株式会社")))
    per = d.chat_history.where("source_document IS NOT NULL").groupBy("employee_id", "category").agg(F.array_sort(F.collect_set(words)).alias("lists"))
    merged = per.withColumn("k", Q.merge_keywords(F.col("lists"), 11)).where(F.size("k") <= 10)
    return merged.select("employee_id", "category", F.array_join(F.array_sort("k"), ",").alias("keywords"))
