"""Pattern analysis of questions by a table of rules: intent, confidence, entity, keywords, and whether vectors are needed.

The rules are data and apply in their order; everything is one projection over the question table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the lower-cased question, the intent they show, and its confidence; the first rule that applies wins.
INTENTS = [
    (["代表者", "社長", "トップ", "ceo", "連絡先", "電話", "住所", "料金", "価格"], "specific_info", 0.8),
    (["なぜ", "どう", "理由", "背景"], "explanation", 0.6),
    (["手順", "方法", "やり方"], "procedure", 0.6),
]
OTHERWISE = ("general_info", 0.5)
#: Telephone numbers; all matches of all patterns are keywords.
PHONES = [
    r"\d{2,4}-\d{2,4}-\d{4}",
    r"\d{3}-\d{3}-\d{4}",
    r"\(\d{2,4}\)\s*\d{2,4}-\d{4}",
    r"\d{10,11}",
]
#: Company names; the first match of the first pattern that has one is the entity.
COMPANIES = [
    r"([^。、\s]+(?:株式会社|合同会社|有限会社))",
    r"([^。、\s]+会社)",
    r"([^。、\s]+(?:Corporation|Corp|Inc|LLC))",
]
#: Words that are no keywords.
EXCLUDED = ["は", "が", "を", "に", "で", "と", "から", "まで", "です", "ます", "だ", "である", "これ", "それ", "あの", "その", "この"]
#: Words of the question, the keywords they add, and the entity they name (None: as it was). Each rule
#: that applies makes the intent specific_info at 0.8; the last entity counts.
GROUPS = [
    (["企業名", "会社名", "社名"], ["企業名", "会社名", "社名", "株式会社", "有限会社"], "企業名"),
    (["代表者", "社長", "トップ", "CEO", "リーダー", "経営者", "オーナー"], ["代表者", "社長", "代表取締役", "責任者", "トップ", "CEO", "リーダー", "経営者", "オーナー"], "代表者"),
    (["電話", "TEL", "連絡先"], ["電話", "TEL", "連絡先", "電話番号"], None),
]
#: Keywords that name an entity where nothing else has.
GUESSES = [
    (["企業名", "会社名", "社名"], "企業名"),
    (["代表者", "社長"], "代表者"),
    (["電話", "TEL", "連絡先"], "連絡先"),
]
#: Intents that are also searched by vectors.
BY_VECTORS = ["general_info", "explanation"]


def any_of(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def analyse(questions: DataFrame) -> DataFrame:
    """id, intent, confidence, entity, keywords, by_vectors for every question (id, text); a null text is an empty one."""
    text = F.col("text")
    company = F.lit(None).cast("string")
    for pattern in reversed(COMPANIES):
        company = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), company)
    intent, confidence = F.lit(OTHERWISE[0]), F.lit(OTHERWISE[1])
    for words, name, sure in reversed(INTENTS):
        hit = any_of(F.lower(text), words)
        intent, confidence = F.when(hit, name).otherwise(intent), F.when(hit, sure).otherwise(confidence)
    none = strings([])
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(w, "[。、！？]", ""))
    words = F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.isin(EXCLUDED))
    parts = [*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PHONES), F.when(company.isNotNull(), F.array(company)).otherwise(none), words]
    entity = company
    for shown, added, name in GROUPS:
        hit = any_of(text, shown)
        intent, confidence = F.when(hit, "specific_info").otherwise(intent), F.when(hit, 0.8).otherwise(confidence)
        parts.append(F.when(hit, strings(added)).otherwise(none))
        entity = F.when(hit, name).otherwise(entity) if name else entity
    rows = questions.select("id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("id", intent.alias("intent"), confidence.alias("confidence"), entity.alias("entity"), F.concat(*parts).alias("keywords"))
    rows = rows.withColumn("keywords", F.array_distinct(F.filter(F.transform("keywords", lambda k: F.trim(k)), lambda k: k != "")))
    guess = F.lit("")
    for known, name in reversed(GUESSES):
        guess = F.when(F.arrays_overlap("keywords", strings(known)), name).otherwise(guess)
    return rows.select("id", "intent", "confidence", F.coalesce("entity", guess).alias("entity"), "keywords", F.col("intent").isin(BY_VECTORS).alias("by_vectors"))
