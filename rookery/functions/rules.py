"""Rules on single values, as columns: casts, null words, labels, dates, validation, quotas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for nothing.
NULL_WORDS = ["nan", "none", "null", "<na>", "n/a", ""]
#: Characters that names and e-mail addresses may not have.
FORBIDDEN = r"""[<>"'\\/;]"""
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
#: Least similarity of each band.
BANDS = [(0.8, "very high"), (0.6, "high"), (0.4, "medium"), (0.2, "low")]


def shorten(c: Column, n: int = 100) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def safe_long(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(default))


def safe_double(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def blank_null_words(c: Column) -> Column:
    return F.when(c.isNull() | F.lower(F.trim(c)).isin(NULL_WORDS), "").otherwise(F.trim(c))


def strip_null_words(c: Column) -> Column:
    """Null words inside a text removed, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)(^|[^A-Za-z0-9_])(nan|none|null)(?=$|[^A-Za-z0-9_])", "$1"), " +", " "))


def tokyo_time(c: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(c, "Asia/Tokyo"), "yyyy-MM-dd HH:mm:ss"), F.lit(" JST"))


def email_problem(c: Column) -> Column:
    """The first rule an address breaks; null if none."""
    return (
        F.when(c.isNull() | (F.trim(c) == ""), "empty")
        .when(F.char_length(c) < 5, "too short")
        .when(F.char_length(c) > 100, "too long")
        .when(c.rlike(FORBIDDEN), "forbidden character")
        .when(c.contains(".."), "two dots")
        .when(F.char_length(c) - F.char_length(F.replace(c, F.lit("@"), F.lit(""))) != 1, "not one @")
        .when(~c.rlike(EMAIL), "malformed")
    )


def name_problem(c: Column) -> Column:
    return (
        F.when(c.isNull() | (F.trim(c) == ""), "empty").when(F.char_length(c) > 50, "too long").when(c.rlike(FORBIDDEN), "forbidden character")
    )


def similarity_band(c: Column) -> Column:
    out = F.lit("very low")
    for least, label in reversed(BANDS):
        out = F.when(c >= least, label).otherwise(out)
    return out


def quota_allows(unlimited: Column, used: Column, limit: Column) -> Column:
    """struct(remaining, allowed)."""
    remaining = F.when(unlimited, F.lit(None)).otherwise(limit - used)
    return F.struct(remaining.alias("remaining"), (unlimited | (limit - used > 0)).alias("allowed"))


def plan_name(c: Column) -> Column:
    return F.when(c == "unlimited", "production").otherwise(c)


def token_estimate(c: Column) -> Column:
    """Japanese characters count 1.5, others a quarter."""
    other = F.char_length(F.regexp_replace(c, "[ぁ-んァ-ヶー一-龯]", ""))
    return F.ceil((F.char_length(c) - other) * 1.5 + other * 0.25)


def file_kind(name: Column) -> Column:
    """Kind of resource by address or file extension."""
    ext = F.lower(F.substring_index(name, ".", -1))
    kinds = {"pdf": ["pdf"], "excel": ["xls", "xlsx"], "word": ["doc", "docx"], "csv": ["csv"], "text": ["txt", "md"], "video": ["mp4", "avi", "mov"], "image": ["png", "jpg", "jpeg", "gif"]}
    out = F.lit("other")
    for kind, extensions in kinds.items():
        out = F.when(ext.isin(extensions), kind).otherwise(out)
    return F.when(name.rlike("^https?://"), "url").otherwise(out)


def valid_timestamp(c: Column) -> Column:
    """The timestamp a text holds; null if it can't be read."""
    return F.try_to_timestamp(F.trim(c))


def page_estimate(tokens: Column, records: Column) -> Column:
    """Pages of 500 tokens, or of 50 records where there are records; one at least."""
    return F.greatest(F.lit(1).cast("long"), F.when(records > 0, F.ceil(records / 50)).otherwise(F.ceil(tokens / 500)))


#: Accounts of operators, and names of no source.
OPERATORS = ["admin", "operator", "support"]
NO_SOURCE = ["unknown", "none", ""]


def counts_as_use(role: Column, source: Column) -> Column:
    """Whether a chat counts in the reports: not an operator's, and with a named source; case doesn't matter."""
    return ~F.lower(F.coalesce(role, F.lit(""))).isin(OPERATORS) & ~F.lower(F.trim(F.coalesce(source, F.lit("")))).isin(NO_SOURCE)


def clean_cell(c: Column, most: int = 1000) -> Column:
    """A cell without surrounding and repeated white space, NUL and byte order marks, cut after `most` characters; full width folded."""
    wide = "".join(chr(0xFEE0 + x) for x in range(0x21, 0x7F) if x != 0x40) + "　"
    plain = "".join(chr(x) for x in range(0x21, 0x7F) if x != 0x40) + " "
    text = F.trim(F.coalesce(c, F.lit("")))
    text = F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
    text = F.regexp_replace(F.translate(text, wide, plain), r"[\t\n\x0b\f\r ]+", " ")
    return F.trim(F.replace(F.replace(text, F.lit("\0"), F.lit("")), F.lit("﻿"), F.lit("")))
