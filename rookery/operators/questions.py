"""Understanding of question tables: category, intent, keywords, variants, splitting. All set-level projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import normalise

#: Words that point to a category, in order of precedence.
CATEGORY_WORDS = {
    "procedure": ["how", "apply", "request", "submit", "手順", "申請", "方法"],
    "finance": ["price", "cost", "invoice", "料金", "請求", "費用"],
    "technical": ["error", "login", "password", "system", "エラー", "障害", "接続"],
    "hr": ["leave", "salary", "holiday", "休暇", "給与", "勤怠"],
    "schedule": ["when", "date", "deadline", "日程", "期限", "予定"],
    "contact": ["who", "phone", "mail", "連絡", "電話", "担当"],
}
#: Greetings and short replies.
CASUAL = r"^(hi|hello|hey|thanks|thank you|ok|bye|こんにちは|ありがとう|おはよう|了解)[!. 。！]*$"
#: Legal forms of companies.
LEGAL_FORMS = ["株式会社", "有限会社", "合同会社", "Inc.", "Ltd.", "GmbH"]
#: Plain forms of often varied notation.
NOTATION = [(r"e-?mail", "email"), (r"web ?site", "website"), (r"log ?in", "login"), (r"log ?out", "logout"), (r"サーバー", "サーバ"), (r"ユーザー", "ユーザ")]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def categorise(text: Column, table: dict[str, list[str]] | None = None) -> Column:
    """struct(category, hits, confidence): the category with the most listed words; the first one wins ties."""
    table = table or CATEGORY_WORDS
    lowered = F.lower(text)
    counts = [
        F.struct(sum((lowered.contains(w).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (name, ws) in enumerate(table.items())
    ]
    best = F.array_max(F.array(*counts))
    return F.struct(
        F.when(best["n"] > 0, best["name"]).otherwise("general").alias("category"), best["n"].alias("hits"), F.least(F.lit(0.8), best["n"] * 0.2).alias("confidence")
    )


def intent(text: Column) -> Column:
    """casual, question, request or statement."""
    t = F.trim(F.lower(text))
    return (
        F.when((t == "") | t.rlike(CASUAL), "casual")
        .when(t.endswith("?") | t.endswith("？") | t.rlike("^(who|what|when|where|why|how|which|is|are|can|do|does)( |$)"), "question")
        .when(t.rlike("(please|お願い|ください)"), "request")
        .otherwise("statement")
    )


def should_split(text: Column) -> Column:
    """Two or more of: many sentences, many clauses, listed items, several questions, great length."""
    marks = [
        F.regexp_count(text, F.lit(r"[.!?。！？]")) >= 3,
        F.regexp_count(text, F.lit(r"[,;、]")) >= 4,
        F.regexp_count(text, F.lit(r"(^|\n) *([0-9]+[.)]|[-*])")) >= 2,
        F.regexp_count(text, F.lit(r"[?？]")) >= 2,
        F.char_length(text) > 300,
    ]
    return sum((m.cast("int") for m in marks), F.lit(0)) >= 2


def profile_questions(questions: DataFrame) -> DataFrame:
    """One row a question: category, confidence, intent, whether it needs search and splitting, and traits."""
    t = F.coalesce("text", F.lit(""))
    rows = questions.select("id", t.alias("text"), categorise(t).alias("c"), intent(t).alias("intent"))
    return rows.select(
        "id",
        F.col("c.category").alias("category"),
        F.round("c.confidence", 6).alias("confidence"),
        "intent",
        (F.col("intent") != "casual").alias("needs_search"),
        should_split(F.col("text")).alias("split"),
        F.char_length("text").alias("length"),
        F.col("text").rlike(r"[^\x00-\x7F]").alias("non_ascii"),
    )


def question_distribution(profiles: DataFrame) -> DataFrame:
    """Counts by category, by intent and by both."""
    return profiles.groupingSets([["category"], ["intent"], ["category", "intent"]], "category", "intent").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("length"), 6).alias("mean_length")
    )


def important_keywords(text: Column, most: int = 5) -> Column:
    """Katakana of three, kanji of two, Latin words of two or more, numbers with a unit: in this order, distinct."""
    runs = [r"([ァ-ヶー]{3,})", r"([一-龯]{2,})", r"([A-Za-z]{2,})", r"([0-9]+(?:円|件|人|日|月|年|%))"]
    found = F.concat(*(F.regexp_extract_all(text, F.lit(r), 1) for r in runs))
    return F.slice(F.array_distinct(found), 1, most)


def canonical(text: Column) -> Column:
    """Varied notation made plain, by the rules in order."""
    out = normalise(text)
    for pattern, plain in NOTATION:
        out = F.regexp_replace(out, pattern, plain)
    return out


def variants(text: Column, most: int = 10) -> Column:
    """Ways to write a question: as it is, plain, without spaces, without marks, in full width, legal forms spaced."""
    narrow = "".join(chr(x) for x in range(0x21, 0x7F))
    wide = "".join(chr(0xFEE0 + x) for x in range(0x21, 0x7F))
    spaced = text
    for form in LEGAL_FORMS:
        spaced = F.replace(spaced, F.lit(form), F.lit(f" {form} "))
    spaced = F.trim(F.regexp_replace(spaced, " +", " "))
    ways = F.array(text, canonical(text), F.replace(text, F.lit(" "), F.lit("")), F.trim(F.regexp_replace(text, r"[^\p{L}\p{N} ]", "")), F.translate(text, narrow, wide), spaced)
    return F.slice(F.array_distinct(F.filter(ways, lambda v: v != "")), 1, most)


def explode_variants(questions: DataFrame) -> DataFrame:
    """id, variant_no, variant: each question in each of its ways."""
    return questions.select("id", F.posexplode(variants(F.coalesce("text", F.lit("")))).alias("variant_no", "variant"))


def split_questions(questions: DataFrame, least: int = 10) -> DataFrame:
    """id, part_no, part: sentences and listed items, short ones joined to the one before."""
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?。！？])\s+|\n+"), lambda p: F.trim(p)), lambda p: p != "")
    joined = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, p: F.when((F.size(out) > 0) & (F.char_length(p) < least), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat_ws(" ", F.element_at(out, -1), p)))).otherwise(
            F.concat(out, F.array(p))
        ),
    )
    return questions.select("id", F.posexplode(joined).alias("part_no", "part"))


def merge_parts(hits: DataFrame, parts: DataFrame, k: int = 10) -> DataFrame:
    """Hits of split questions per question: a chunk's best score over the parts, and how many parts found it."""
    from .retrieval import top_k

    rows = hits.join(parts.select("query_id", "id"), "query_id").groupBy("id", "chunk_id").agg(F.max("score").alias("score"), F.countDistinct("query_id").alias("parts"))
    return top_k(rows, k, by=["id"])


#: What a message begins or ends with that a search doesn't need, in order.
REMOVED = [
    r"^(教えて|説明して|知りたい|聞きたい)[：:：\s]*",
    r"(お願いします|ください|だろうか|でしょうか)[。．\s]*$",
    r"^(すみません|恐れ入ります)[、，\s]*",
]
#: The same for English messages; these are this library's own.
REMOVED_ENGLISH = [r"^(please tell me|tell me|excuse me)[:,\s]*", r"please[.\s]*$"]
#: Signs of several tasks.
SEVERAL = [
    r"WP[DN]\d{7}.*WP[DN]\d{7}",
    r"(と|、).*について",
    r"また.*も",
    r"さらに.*も",
    r"あと.*も",
    r"[？?].*[？?]",
    r"(1\.|2\.|3\.|①|②|③)",
]
#: Signs of complex questions and of tables.
COMPLEX = ["表形式", "表で", "テーブル", "一覧表", "詳細を表", "×", "✕", "物件番号ごと", "条件:", "指示:", "注意事項", "表示条件"]
TABLES = ["表形式", "表で", "テーブル", "物件番号ごと"]


def search_query(text: Column) -> Column:
    """What a search needs of a question: no polite opening or ending, no question marks."""
    out = F.trim(F.lower(text))
    for pattern in [*REMOVED, *REMOVED_ENGLISH]:
        out = F.trim(F.regexp_replace(out, pattern, ""))
    return F.trim(F.translate(out, "？?", ""))


def _any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def has_several_tasks(text: Column, least: int = 30) -> Column:
    """A sign of several tasks in a question of over `least` characters."""
    return _any(text, SEVERAL) & (F.char_length(text) > least)


def is_complex(text: Column) -> Column:
    return _any(text, COMPLEX)


def asks_for_table(text: Column) -> Column:
    return _any(text, TABLES)


def segment_keywords(text: Column) -> Column:
    """Katakana and Latin words or numbers of three characters or more, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit("([ア-ヴー]{3,})"), 1), F.regexp_extract_all(text, F.lit("([A-Za-z0-9]{3,})"), 1))))


def merge_keywords(lists: Column, most: int = 10) -> Column:
    """Keywords of a question's variants in one list, legal forms set apart from names, in order of first use."""
    forms = "|".join(re.escape(f) for f in LEGAL_FORMS)
    words = F.transform(F.flatten(lists), lambda w: F.trim(F.regexp_replace(w, forms, "")))
    return F.slice(F.array_distinct(F.filter(words, lambda w: w != "")), 1, most)
