"""Pattern analysis of questions, with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intents as N
from .registry import query

#: Stored turns, with what the rules look for put before, into or behind them.
QUESTIONS = """SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, CASE (conv_id * 7 + turn) % 17 WHEN 0 THEN concat('代表者は ', text) WHEN 1 THEN concat(text, ' CEO') WHEN 2 THEN concat('なぜ ', text)
 WHEN 3 THEN concat(text, ' 手順 です') WHEN 4 THEN concat('TEL 03-1234-5678 ', text) WHEN 5 THEN concat('青空株式会社 の 社名 ', text) WHEN 6 THEN concat('(03) 1234-5678、', text) WHEN 7 THEN concat('09012345678 ', text)
 WHEN 8 THEN concat('Blue Corp この ', text) WHEN 9 THEN concat('子会社の 電話！ ', text) WHEN 10 THEN concat('会社名 と オーナー ', text) WHEN 11 THEN concat('どう やり方 ', text) WHEN 12 THEN concat('住所？ ', text) WHEN 13 THEN concat('社長 連絡先 ', text)
 WHEN 14 THEN '' WHEN 15 THEN concat('から まで ', text) ELSE text END AS text FROM conversations"""


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_BASE = " ".join(f"WHEN {_any('lower(text)', ws)} THEN {{{i}}}" for i, (ws, _, _) in enumerate(N.INTENTS))
_GROUP = " OR ".join(_any("text", ws) for ws, _, _ in N.GROUPS)
TWIN = f"""WITH q AS ({QUESTIONS}), c AS (SELECT *, coalesce({", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in N.COMPANIES)}) AS company FROM q),
 k AS (SELECT *, list_concat({", ".join(f"regexp_extract_all(text, '{p}')" for p in N.PHONES)}, CASE WHEN company IS NULL THEN [] ELSE [company] END,
 list_filter(list_transform(string_split_regex(trim(text), '\\s+'), lambda w: regexp_replace(w, '[。、！？]', '', 'g')), lambda w: length(w) > 1 AND NOT list_contains({_list(N.EXCLUDED)}, w)),
 {", ".join(f"CASE WHEN {_any('text', ws)} THEN {_list(added)} ELSE [] END" for ws, added, _ in N.GROUPS)}) AS raw FROM c),
 u AS (SELECT *, list_filter(list_transform(raw, lambda x: trim(x)), lambda x: x <> '') AS kws FROM k),
 d AS (SELECT *, list_filter(kws, lambda x, i: list_position(kws, x) = i) AS keywords FROM u),
 i AS (SELECT *, CASE WHEN {_GROUP} THEN 'specific_info' {_BASE.format(*(f"'{n}'" for _, n, _ in N.INTENTS))} ELSE 'general_info' END AS intent,
 CAST(CASE WHEN {_GROUP} THEN 0.8 {_BASE.format(*(s for _, _, s in N.INTENTS))} ELSE 0.5 END AS DOUBLE) AS confidence,
 CASE WHEN {_any("text", N.GROUPS[1][0])} THEN '代表者' WHEN {_any("text", N.GROUPS[0][0])} THEN '企業名' ELSE company END AS named FROM d)
 SELECT id, intent, confidence, coalesce(named, CASE {" ".join(f"WHEN len(list_intersect(keywords, {_list(ws)})) > 0 THEN '{n}'" for ws, n in N.GUESSES)} ELSE '' END) AS entity,
 array_to_string(keywords, '|') AS keywords, intent IN ('general_info', 'explanation') AS by_vectors FROM i"""


@query("q7_pattern_intents", TWIN)
def pattern_intents(d):
    return N.analyse(d.sql(QUESTIONS)).withColumn("keywords", F.array_join("keywords", "|"))


@query("q7_intent_counts", TWIN.replace(" SELECT id, intent, confidence, coalesce(", ", a AS (SELECT id, intent, confidence, coalesce(").replace("AS by_vectors FROM i", "AS by_vectors FROM i) SELECT intent, entity, by_vectors, count(*) AS n FROM a GROUP BY 1, 2, 3"))
def intent_counts(d):
    return N.analyse(d.sql(QUESTIONS)).groupBy("intent", "entity", "by_vectors").agg(F.count(F.lit(1)).alias("n"))
