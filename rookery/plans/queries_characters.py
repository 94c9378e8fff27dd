"""Cleanup of cells and repair of texts by Unicode's tables and dictionaries, with their DuckDB twins."""

from __future__ import annotations

from ..functions import characters as U
from .registry import query

#: Cells with full width, half-width kana, ligatures, byte order marks and white space of other scripts.
CELLS = """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat('  ＡＢＣ　１２３　', text) WHEN 1 THEN concat('ｶﾞｲﾄﾞ ', text) WHEN 2 THEN concat('﻿', left(text, 50), chr(9), chr(10), 'ﬁn ①')
 WHEN 3 THEN concat(repeat('ｱ', 1001), text) WHEN 4 THEN concat('ａ＠ｂ．ｃ ', left(text, 30), '　') WHEN 5 THEN NULL WHEN 6 THEN concat('㈱ ', left(text, 999)) ELSE text END AS cell FROM documents"""
_SPACE = r"[ \t\n\x0b\f\r\x{85}\x{A0}\x{3000}]+"
_KANA = "replace(replace(replace(translate({t}, 'ｱｲﾄ', 'アイト'), 'ｶﾞ', 'ガ'), 'トﾞ', 'ド'), 'ﾄﾞ', 'ド')"


@query(
    "t29_nfkc_cells",
    f"""WITH c AS ({CELLS}), s AS (SELECT doc_id, regexp_replace(coalesce(cell, ''), '^{_SPACE}|{_SPACE}$', '', 'g') AS t FROM c), k AS (SELECT doc_id, CASE WHEN length(t) > 1000 THEN left(t, 1000) || '...' ELSE t END AS t FROM s),
 n AS (SELECT doc_id, replace(replace(replace({_KANA.format(t="translate(t, 'ＡＢＣ１２３ａｂｃ＠．', 'ABC123abc@.')")}, 'ﬁ', 'fi'), '①', '1'), '㈱', '(株)') AS t FROM k)
 SELECT doc_id, trim(replace(trim(regexp_replace(t, '{_SPACE}', ' ', 'g')), chr(65279), '')) AS cell FROM n""",
)
def nfkc_cells(d):
    rows = d.sql(CELLS)
    return rows.select("doc_id", U.clean_cell_nfkc(rows["cell"]).alias("cell"))


#: Texts with page marks, boilerplate, half-width kana, and words that broken decoding has made.
TEXTS = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN concat('=== Page 3 ===', chr(10), text) WHEN 1 THEN concat('Company Secret ', text, '。') WHEN 2 THEN concat('ｶﾞｲﾄﾞ，', text) WHEN 3 THEN concat(repeat('(cid:3)', 6), '迺ｾ遶 ', text)
 WHEN 4 THEN concat(text, '� 縺ゅ→縺 荳?蟋 縺縺繧繝') WHEN 5 THEN concat('縺ゅ→縺 ', text) WHEN 6 THEN concat('--- Page 12 ---Copyright 2001-2024 © us All Rights Reserved', text) WHEN 7 THEN NULL ELSE text END AS text FROM documents"""


@query(
    "t11_repaired_documents",
    f"""WITH x AS ({TEXTS}), m AS (SELECT doc_id, {("translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '=== Page [0-9]+ ===', '', 'g'), '--- Page [0-9]+ ---', '', 'g'), 'Copyright [0-9]{{4}}-[0-9]{{4}} © .* All Rights Reserved', '', 'g'), 'Company Secret', '', 'g'), '。．，', '..,')")} AS t FROM x),
 p AS (SELECT doc_id, CASE WHEN doc_id % 9 IN (3, 4) THEN replace(regexp_replace(regexp_replace(replace(replace(replace(t, '縺ゅ→縺', 'あと'), '迺ｾ遶', '環境'), '荳?蟋', '会社'), '\\(cid:[0-9]+\\)', '', 'g'), '[縺繝繧]{{3,}}', '[文字化け]', 'g'), '�', '') ELSE t END AS t FROM m), r AS (SELECT doc_id, {_KANA.format(t="t")} AS t FROM p)
 SELECT doc_id, trim(regexp_replace(t, '{_SPACE}', ' ', 'g')) AS text FROM r""".replace("{{", "{").replace("}}", "}"),
)
def repaired_documents(d):
    return U.repair_documents(d.sql(TEXTS))
