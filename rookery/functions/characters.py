"""Rules on characters that need Unicode's tables or a dictionary: Arrow batches through small Python functions.

Everything that Spark's own functions can say stays a column; only normalisation and the dictionary are UDFs.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.damage import damaged_document

#: Page marks and boilerplate that repaired texts lose, in order.
MARKERS = [
    r"=== ページ \d+ ===",
    r"=== Page \d+ ===",
    r"--- Page \d+ ---",
    r"=== ファイル: .* ===",
    r"Copyright \d{4}-\d{4} © .* All Rights Reserved",
    r"Company Secret",
    r"VER\d{6} -\d{2}-\d{2}",
]
#: Marks that become plain.
FANCY, PLAIN = "。．，", "..,"
#: What broken decoding made of frequent words; longest first wherever two fit.
BROKEN_WORDS = {"縺ゅ→縺": "あと", "迺ｾ遶": "環境", "荳?蟋": "会社", "繧ｳ繝ｳ繝斐Η繝ｼ繧ｿ": "コンピュータ"}
#: Runs of characters that only broken decoding leaves, and what stands for them.
LEFT_OVER, UNREADABLE = r"[縺繝繧]{3,}", "[文字化け]"
MOST = 1000
_HALF_KANA = re.compile("[｡-ﾟ]+")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode's compatibility form: full width, half-width kana, ligatures, circled numbers made plain."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def full_kana(texts: pd.Series) -> pd.Series:
    """Half-width kana and their marks as full-width kana; all else as it is."""
    return texts.map(lambda t: _HALF_KANA.sub(lambda m: unicodedata.normalize("NFKC", m[0]), t), na_action="ignore")


def mapped(text: Column, words: dict[str, str]) -> Column:
    """Words replaced by their plain forms: at each place the longest that fits, from left to right, once.

    The dictionary goes with the function to the tasks: it is a rule table and not data.
    """
    words = {k: v for k, v in words.items() if k}
    if not words:
        return text
    rule = re.compile("|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w)))))

    @F.pandas_udf(StringType())
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: rule.sub(lambda m: words[m[0]], t), na_action="ignore")

    return each(text)


def tidy(text: Column) -> Column:
    """White space of any script collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def clean_cell_nfkc(cell: Column, most: int = MOST) -> Column:
    """A cell in compatibility form, cut after `most` characters, white space collapsed, without NUL and byte order marks; null is empty."""
    text = tidy_ends(F.coalesce(cell, F.lit("")))
    text = F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
    return F.trim(F.replace(F.replace(tidy(nfkc(text)), F.lit("\0"), F.lit("")), F.lit("﻿"), F.lit("")))


def tidy_ends(text: Column) -> Column:
    space = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return F.regexp_replace(text, f"^{space}|{space}$", "")


def repair_documents(docs: DataFrame, words: dict[str, str] | None = None) -> DataFrame:
    """`docs` with `text` repaired: no page marks and boilerplate, plain marks, full-width kana; damaged texts are mapped back.

    Only a text that the test for damaged documents finds is mapped: there known words are restored, font
    codes and replacement characters go, and runs that stay unreadable are marked as such. Null is empty.
    """
    out = F.coalesce("text", F.lit(""))
    for pattern in MARKERS:
        out = F.regexp_replace(out, pattern, "")
    rows = docs.withColumn("text", F.translate(out, FANCY, PLAIN))
    restored = F.regexp_replace(mapped(F.col("text"), BROKEN_WORDS if words is None else words), r"\(cid:\d+\)", "")
    restored = F.replace(F.regexp_replace(restored, LEFT_OVER, UNREADABLE), F.lit("�"), F.lit(""))
    # broken words hold half-width kana themselves, so that they are mapped before kana are made full
    rows = rows.withColumn("text", F.when(damaged_document(F.col("text")), restored).otherwise(F.col("text")))
    return rows.withColumn("text", tidy(full_kana(F.col("text"))))
