"""Tests for damaged text: four rules, each a boolean column, for different kinds of source."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What broken decoding leaves behind.
REPLACED = "�"
BROKEN = [
    r"\?{5,}",
    r"[\uFFFD]{3,}",
    "繧\x92繧\x93",
    "縺\x84縺\x86",
    "讒\x81讒\x82",
    "繝\x81繝\x82",
    "縺ゅ→縺",
    "迺ｾ遶",
    r"荳\?蟋",
    "繧ｳ繝ｳ繝斐Η繝ｼ繧ｿ",
    r"\(cid:\d+\)",
]
#: Broken runs of a page. Word characters are letters, digits and the underscore of any script.
PAGE_RUNS = [
    "ï¿½+",
    r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9F}]{3,}",
    r"[^\p{L}\p{N}_\t\n\x0b\f\r \x{3000}-\x{30FF}\x{4E00}-\x{9FAF}\x{3400}-\x{4DBF}]{10,}",
    r"\d+\(\)\[",
]
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
SCRIPT = r"A-Za-z\x{C0}-\x{24F}\x{3040}-\x{30FF}\x{4E00}-\x{9FAF}"


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.char_length(text), F.lit(1))


def _inside(text: Column, chars: str) -> Column:
    """The share of characters of a class, from what is left without the runs of others: no match is kept."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")) / F.greatest(F.char_length(text), F.lit(1))


def _often(text: Column, part: str) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def _single(text: Column, char: str) -> Column:
    return _often(text, char) / F.greatest(F.char_length(text), F.lit(1))


def commonest_share(text: Column) -> Column:
    """Share of the most frequent character; one walk over the text, however many characters differ."""

    @F.udf("long", useArrow=False)
    def most(t: str | None) -> int | None:
        return None if not t else max(Counter(t).values())

    return most(text) / F.greatest(F.char_length(text), F.lit(1))


def damaged_document(text: Column) -> Column:
    """Two of ten signs, or a strong one: replacement characters, font codes, many characters beyond the basic plane."""
    n = F.char_length(text)
    beyond = _share(text, r"[\x{10000}-\x{10FFFF}]")
    replaced, codes = text.contains(REPLACED), _often(text, "(cid:") > 5
    signs = [
        replaced,
        (n < 50) & ~text.rlike(r"[\p{L}\p{N}]"),
        _inside(text, SCRIPT) < 0.05,
        _single(text, "\n") > 0.6,
        _single(text, " ") > 0.8,
        _share(text, CONTROL) > 0.1,
        beyond > 0.05,
        _often(text, REPLACED) > 10,
        codes,
        (n > 10) & (commonest_share(text) > 0.3),
    ]
    count = sum((s.cast("int") for s in signs), F.lit(0))
    return (F.trim(text) == "") | (count >= 2) | replaced | codes | (beyond > 0.1)


def damaged_table(text: Column) -> Column:
    """A known pattern; in texts of over 50 characters also many controls, or more runs beyond ASCII than a third of the length."""
    n = F.char_length(text)
    known = F.lit(False)
    for pattern in BROKEN:
        known = known | text.rlike(pattern)
    return known | ((n > 50) & ((_share(text, CONTROL) > 0.15) | (_share(text, r"[^\x00-\x7F]+") > 1 / 3)))


def damaged_page(text: Column) -> Column:
    """Over 5 broken runs, or more than two in a hundred characters."""
    count = sum((F.regexp_count(text, F.lit(r)) for r in PAGE_RUNS), F.lit(0))
    return (F.char_length(text) >= 10) & ((count > 5) | (count / F.greatest(F.char_length(text), F.lit(1)) * 100 > 2.0))


def damaged_image_text(text: Column) -> Column:
    """No text, a replacement character, short without letters, hardly any letters, or mostly line breaks."""
    short = (F.char_length(F.trim(text)) < 50) & ~text.rlike(r"[\p{L}\p{N}]")
    return (F.trim(text) == "") | text.contains(REPLACED) | short | (_inside(text, r"\p{L}") < 0.1) | (_single(text, "\n") > 0.5)


def named_sections(text: Column) -> Column:
    """array of struct(name, content): parts between lines `=== name ===`; what comes first is the main part."""
    marked = F.concat(F.lit("=== main ===\n"), text)
    parts = F.filter(F.split(marked, r"(?m)(?:^|\n)(?==== .* ===$)"), lambda p: p != "")
    found = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^=== (.*) ===(?:\n|$)", 1).alias("name"), F.regexp_replace(p, r"^=== .* ===(\n|$)", "").alias("content")))
    return F.filter(found, lambda s: s["content"] != "")
