"""Scoring and routing of hits, section variants, table repair and question splitting by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .best import in_order, written
from .corpus import profile_columns
from .retrieval import best_within, vector_pairs, vector_topk

#: Synonyms that expand a query, and words added by kind of context.
SYNONYMS = {"error": ["failure", "fault"], "price": ["cost", "fee"], "the": ["this"], "with": ["by"]}
CONTEXT_WORDS = {"technical": "system setting", "tutorial": "steps guide", "trouble": "error solution"}
#: Half-width and full-width letters, hiragana and katakana (the small a stays as it is).
HALF = "".join(chr(c) for c in range(0x21, 0x7F))
FULL = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F))
HIRAGANA = "".join(chr(c) for c in range(0x3042, 0x3094))
KATAKANA = "".join(chr(c) for c in range(0x30A2, 0x30F4))


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def enhanced_score(hits: DataFrame, chunks: DataFrame, keywords: DataFrame, near: int = 100, cap: float = 6.0) -> DataFrame:
    """Scores raised by required words, by words close together and by density, capped.

    `keywords`: query_id, keyword. Positions are found once per chunk and joined by word.
    """
    rows = hits.join(chunks.select("chunk_id", F.lower("content").alias("content")), "chunk_id").join(keywords.select("query_id", "keyword"), "query_id")
    at = F.instr("content", F.col("keyword"))
    found = rows.withColumn("at", at).where("at > 0").groupBy("query_id", "chunk_id").agg(
        F.count(F.lit(1)).alias("words"), (F.max("at") - F.min("at")).alias("spread"), F.max(F.char_length("content")).alias("size")
    )
    scored = hits.join(found, ["query_id", "chunk_id"], "left")
    words = F.coalesce("words", F.lit(0))
    close = F.when((words >= 2) & (F.col("spread") <= near), 0.4 - F.col("spread") / 250.0).otherwise(0.0)
    dense = F.when(words > 0, F.least(F.lit(0.3), words * 100.0 / F.col("size"))).otherwise(0.0)
    return scored.select("query_id", "chunk_id", F.round(F.least(F.lit(cap), F.col("score") + 0.3 * words + close + dense), 6).alias("score"))


def relevance_score(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Title 3 and content 1 for the whole query, .5 and .2 for each word, over 1 + length / 1000."""
    rows = hits.select("query_id", "chunk_id").join(chunks.select("chunk_id", "name", "content"), "chunk_id").join(queries.select("query_id", "text"), "query_id")
    q, name, content = F.lower("text"), F.lower("name"), F.lower("content")
    words = F.array_distinct(words_of(F.col("text")))
    in_name = F.size(F.array_intersect(words, words_of(F.col("name"))))
    in_content = F.size(F.array_intersect(words, words_of(F.col("content"))))
    score = F.when(name.contains(q), 3.0).otherwise(0.0) + F.when(content.contains(q), 1.0).otherwise(0.0) + in_name * 0.5 + in_content * 0.2
    return rows.select("query_id", "chunk_id", F.round(score / (1 + F.char_length("content") / 1000), 6).alias("score"))


def expand_query(text: Column) -> Column:
    """The first synonym put after each word that has one."""
    first = F.create_map(*(F.lit(x) for w, s in SYNONYMS.items() for x in (w, s[0])))
    return F.array_join(F.flatten(F.transform(F.split(F.lower(text), " "), lambda w: F.when(F.element_at(first, w).isNotNull(), F.array(w, F.element_at(first, w))).otherwise(F.array(w)))), " ")


def boost_context(text: Column, kind: Column) -> Column:
    """Words of the context's kind added behind the query."""
    words = F.create_map(*(F.lit(x) for pair in CONTEXT_WORDS.items() for x in pair))
    return F.concat_ws(" ", text, F.element_at(words, kind))


def route_by_feedback(queries: DataFrame, feedback: DataFrame) -> DataFrame:
    """Next strategy of each query from its feedback (query_id, rating): poor goes to enhanced, fair to parallel, else basic."""
    rows = queries.join(feedback, "query_id", "left")
    return rows.select("query_id", F.when(F.col("rating") <= 2, "enhanced").when(F.col("rating") == 3, "parallel").otherwise("basic").alias("route"))


def parallel_merge(lists: list[DataFrame], weight: float = 0.9) -> DataFrame:
    """Result lists merged: the first at full weight, later ones lessened each time; best per chunk."""
    out = None
    for n, hits in enumerate(lists):
        part = hits.select("query_id", "chunk_id", (F.col("score") * weight**n).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id", "chunk_id").agg(F.round(F.max("score"), 6).alias("score"))


def vector_with_backfill(queries: DataFrame, chunks: DataFrame, k: int | None = 20, fill: int = 5, score: float = 0.4) -> DataFrame:
    """Vector hits; queries with fewer than k get the newest chunks without a vector behind them.

    Without a k, hits are all chunks with a vector, which are never enough.
    """
    if k is None:
        hits, short = vector_pairs(queries, chunks), queries.select("query_id")
    else:
        hits = vector_topk(queries, chunks, k).select("query_id", "chunk_id", "score")
        counts = queries.select("query_id").join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
        short = counts.where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    newest = chunks.where("embedding IS NULL").orderBy(F.desc("chunk_id")).limit(fill).agg(F.collect_list("chunk_id").alias("ids")).first()["ids"]
    filled = short.select("query_id", F.explode(F.array(*map(F.lit, newest)) if newest else F.array().cast("array<string>")).alias("chunk_id"), F.lit(score).alias("score"))
    return hits.unionByName(filled)


def customer_fields(chunks: DataFrame) -> DataFrame:
    """A code and a company name found in each chunk by ordered patterns."""
    code = F.coalesce(F.nullif(F.regexp_extract("content", r"([A-Z]{2}[0-9]{3,})", 1), F.lit("")), F.nullif(F.regexp_extract("content", r"([0-9]{5,})", 1), F.lit("")))
    company = F.coalesce(F.nullif(F.regexp_extract("content", r"(株式会社[^ \n、。]{1,20})", 1), F.lit("")), F.nullif(F.regexp_extract("content", r"([A-Z][a-z]+ (?:Inc|Ltd|GmbH))", 1), F.lit("")))
    return chunks.select("chunk_id", code.alias("code"), company.alias("company"))


def guessed_tables(docs: DataFrame, separators: tuple[str, ...] = ("|", "\t", ";", ","), least: int = 3) -> DataFrame:
    """Runs of `least` and more lines that share their commonest separator: doc_id, first line, lines, separator."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    counts = F.array(*(F.struct((F.size(F.split("line", F.lit("\\Q" + s + "\\E"))) - 1).alias("n"), F.lit(-p).alias("order"), F.lit(s).alias("s")) for p, s in enumerate(separators)))
    rows = lines.withColumn("best", F.array_max(counts)).withColumn("separator", F.when(F.col("best.n") >= 2, F.col("best.s"))).where("separator IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy("i")
    new = (F.col("i") - F.lag("i").over(order) > 1) | (F.col("separator") != F.lag("separator").over(order))
    rows = rows.withColumn("new", F.coalesce(new, F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("doc_id", "run").agg(F.min("i").alias("first_line"), F.count(F.lit(1)).alias("lines"), F.max("separator").alias("separator"))
    return out.where(F.col("lines") >= least).select("doc_id", "first_line", "lines", "separator")


def delimiter_choice(lines: DataFrame, delimiters: tuple[str, ...] = (",", ";", "\t", "|")) -> DataFrame:
    """Per file: of the delimiters with at most two widths, that of the most columns. `lines`: file, line."""
    each = lines.select("file", "line", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(-i).alias("order")) for i, d in enumerate(delimiters)))).alias("x"))
    width = F.size(F.split("line", F.concat(F.lit("\\Q"), F.col("x.d"), F.lit("\\E"))))
    per = each.groupBy("file", "x.d", "x.order").agg(F.max(width).alias("columns"), F.countDistinct(width).alias("widths"))
    return per.groupBy("file").agg(F.max_by("d", F.struct(F.col("widths") <= 2, "columns", "order")).alias("delimiter"))


def repair_columns(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Columns kept: not empty, and not an unnamed running number. doc_id, table_no, col_no, name."""
    keys = ["doc_id", "table_no", "col_no"]
    profile = profile_columns(grid.where("row_no > 1"))
    number = F.expr("try_cast(value AS BIGINT)")
    order = Window.partitionBy(*keys).orderBy("row_no")
    gaps = grid.where("row_no > 1").withColumn("v", number).withColumn("gap", F.col("v") - F.lag("v").over(order))
    running = gaps.groupBy(*keys).agg(F.coalesce(F.avg((F.col("gap") == 1).cast("int")), F.lit(0.0)).alias("steps"))
    placeholder = F.col("name").rlike(r"^(C[0-9]+(_[0-9]+)?|Unnamed.*|Column ?[0-9]*|[0-9]*)$")
    rows = headers.join(profile, keys, "left").join(running, keys, "left")
    drop = (F.coalesce("filled", F.lit(0)) == 0) | (placeholder & (F.coalesce("steps", F.lit(0.0)) >= 0.7))
    return rows.where(~drop).select(*keys, "name")


def date_like(c: Column) -> Column:
    """Dates by pattern, or serial day numbers of spreadsheets."""
    number = c.try_cast("double")
    return c.rlike(r"^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}( [0-9:]{5,8})?$") | c.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$") | ((number >= 20_000) & (number <= 60_000) & (number == F.floor(number)))


def date_columns(rows: DataFrame, group: list[str], value: str, least: float = 0.7) -> DataFrame:
    """Share of date-like values by column, and whether it is a date column."""
    per = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*group).agg(F.round(F.avg(F.coalesce(date_like(F.col(value)), F.lit(False)).cast("int")), 6).alias("share"))
    return per.withColumn("is_date", F.col("share") >= least)


def rows_to_sections(records: DataFrame, headers: DataFrame) -> DataFrame:
    """Record texts as sections, behind one row that names each table's columns."""
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "name"))), lambda x: x["name"]), ", ")
    structure = headers.groupBy("doc_id", "table_no").agg(names.alias("content")).withColumn("section", F.lit("structure"))
    body = records.select("doc_id", "table_no", F.col("record").alias("content"), F.concat(F.lit("row "), F.col("row_no")).alias("section"))
    return structure.select("doc_id", "table_no", "section", "content").unionByName(body.select("doc_id", "table_no", "section", "content"))


def to_full(c: Column) -> Column:
    return F.translate(c, HALF + " ", FULL + "　")


def to_half(c: Column) -> Column:
    return F.translate(c, FULL + "　", HALF + " ")


def to_katakana(c: Column) -> Column:
    return F.translate(c, HIRAGANA, KATAKANA)


def to_hiragana(c: Column) -> Column:
    return F.translate(c, KATAKANA, HIRAGANA)


def split_keywords(keywords: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Keywords as required words or members of a synonym group: query_id, keyword, group_name (null: required)."""
    groups = synonyms.select(F.col("synonym").alias("keyword"), F.col("term").alias("group_name")).unionByName(synonyms.select(F.col("term").alias("keyword"), F.col("term").alias("group_name"))).distinct()
    return keywords.select("query_id", "keyword").join(groups, "keyword", "left").select("query_id", "keyword", "group_name")


def preferred_terms(keywords: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Each keyword by the preferred term of its group; distinct by query."""
    return split_keywords(keywords, synonyms).select("query_id", F.coalesce("group_name", "keyword").alias("keyword")).distinct()


def questions_per_code(questions: DataFrame, aspects: tuple[str, ...] = ("price", "stock", "delivery")) -> DataFrame:
    """One question for each item code in a text, with the aspects it asks for."""
    codes = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(r"([A-Z]{1,3}-?[0-9]{2,})"), 1))
    asked = F.concat_ws(", ", *(F.when(F.lower("text").contains(a), F.lit(a)) for a in aspects))
    rows = questions.select("id", F.posexplode(codes).alias("n", "code"), asked.alias("asked"))
    return rows.select("id", "n", "code", F.concat_ws(": ", "code", F.nullif("asked", F.lit(""))).alias("question"))


def merge_answers(parts: DataFrame) -> DataFrame:
    """Answers of a question's parts in order, with their distinct sources. `parts`: id, part_no, answer, sources array."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part_no", "answer"))), lambda x: x["answer"]), "\n\n")
    sources = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))), ", ")
    return parts.groupBy("id").agg(text.alias("answer"), sources.alias("sources"), F.count(F.lit(1)).alias("parts"))


def ranked_dot(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Top k by dot product within the tenant of each query; tasks keep the best of each query."""
    asked = queries.select("query_id", F.col("embedding").alias("unit"), F.array_compact(F.array("company_id")).alias("groups")).where("embedding IS NOT NULL")
    vectors = in_order(chunks.select("chunk_id", "company_id", "embedding"))
    return best_within(written(asked, "tenant-queries"), vectors.withColumnsRenamed({"company_id": "group", "embedding": "v"}), k)
