"""Sections by heading, with their DuckDB twins."""

from __future__ import annotations

from ..operators import headings as H
from .registry import query

#: Stored texts with headings of every kind among their lines.
HEADED = """SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN concat('1. First', chr(10), text, chr(10), '2 Second', chr(10), '  ', chr(10), text) WHEN 1 THEN concat('IV. Roman ', chr(10), text, chr(10), 'X Y', chr(10), 'end')
 WHEN 2 THEN concat('lead', chr(10), 'B. Letter', chr(10), replace(text, '. ', chr(10))) WHEN 3 THEN concat('第3章 名前', chr(10), text, chr(10), '第4節', chr(10), 'end') WHEN 4 THEN concat('● dot', chr(10), text, chr(10), '■square', chr(10), 'end')
 WHEN 5 THEN concat('# Same', chr(10), 'old', chr(10), '** other', chr(10), 'mid', chr(10), '## Same', chr(10), text) WHEN 6 THEN concat('Notes: all', chr(10), text, chr(10), '12. Terms、 more', chr(10), 'end') WHEN 7 THEN '   '
 WHEN 8 THEN concat('目次。', chr(10), '第1章 序論：', chr(10), '　', text, chr(10), '* Mark: x', chr(10), 'end', chr(10), '目次。', chr(10), 'again') WHEN 9 THEN concat('● only heading', chr(10), '# none') ELSE text END AS text FROM documents"""
STRIP = "regexp_replace({t}, '^[ \\t\\r\\n\\x0b\\f\\x{{3000}}]+|[ \\t\\r\\n\\x0b\\f\\x{{3000}}]+$', '', 'g')"
LINES = f"""x AS ({HEADED}), l AS (SELECT doc_id, unnest(range(0, len(s))) AS i, {STRIP.format(t="unnest(s)")} AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM x))"""


def twin(title: str, lead: str) -> str:
    return f"""WITH {LINES}, t AS (SELECT *, {title} AS title FROM l WHERE line <> ''), s AS (SELECT *, count(title) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM t),
 g AS (SELECT doc_id, section, coalesce(max(title), '{lead}') AS title, string_agg(line, chr(10) ORDER BY i) FILTER (title IS NULL) AS content FROM s GROUP BY 1, 2), f AS (SELECT * FROM g WHERE content <> '')"""


TEXT = twin(r"CASE WHEN regexp_matches(line, '^(?:[0-9]+[. ]+|第[0-9]+[章節] +|[*#]+ +)?[A-Za-z\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FAF}]{2,}[：:、。]') THEN line END", "一般情報")
_WORD = [r"^[0-9]+\.?\s+(.+)$", r"^[IVXLC]+\.?\s+(.+)$", r"^[A-Z]\.?\s+(.+)$", r"^第[0-9]+[章節条項]\s*(.*)$", r"^[●■▲◆]\s*(.+)$", r"^(?:\*+|#+)\s*(.+)$"]
WORD = twin("CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN coalesce(nullif({STRIP.format(t=f"regexp_extract(line, '{p}', 1)")}, ''), line)" for p in _WORD) + " END", "概要")


@query("t15_text_sections", TEXT + " SELECT * FROM f")
def text_sections(d):
    return H.text_sections(d.sql(HEADED))


@query(
    "t14_heading_kinds",
    WORD
    + """, m AS (SELECT doc_id, title, min(section) AS section, arg_max(content, section) AS content FROM f GROUP BY 1, 2)
 SELECT doc_id, section, title, content FROM m UNION ALL SELECT doc_id, 0, '全体', coalesce(text, '') FROM x WHERE doc_id NOT IN (SELECT doc_id FROM m)""",
)
def heading_kinds(d):
    return H.word_sections(d.sql(HEADED))
