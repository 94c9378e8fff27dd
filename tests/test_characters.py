import random
import unicodedata

from pyspark.sql import functions as F

from rookery.functions import characters as U


def values(spark, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, text string").repartition(2)
    return [r.v for r in df.select("i", make(F.col("text")).alias("v")).orderBy("i").collect()]


def test_normalisation(spark):
    texts = ["ＡＢＣ　１２３", "ｶﾞｷﾞﾊﾟ", "ﬁ①㈱", "﻿x\0y", None, "", "é", "日本 語"]
    assert values(spark, texts, U.nfkc) == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert values(spark, ["ｶﾞＡ①", None, "ｱﾞ"], U.full_kana) == ["ガＡ①", None, "ア゙".replace("ア゙", unicodedata.normalize("NFKC", "ｱﾞ"))]


def test_cells(spark):
    long = "ｱ" * 1500
    assert values(spark, ["  Ａ　 b\n\tc ", None, "﻿x\0", long, "ａ＠ｂ．ｃ"], U.clean_cell_nfkc) == ["A b c", "", "x", "ア" * 1000 + "...", "a@b.c"]


def longest_first(text, words):
    out, at = "", 0
    while at < len(text):
        key = max((w for w in words if w and text.startswith(w, at)), key=len, default=None)
        out, at = (out + words[key], at + len(key)) if key else (out + text[at], at + 1)
    return out


def test_mapping_takes_the_longest(spark):
    rng = random.Random(1)
    words = {"".join(rng.choices("ab?.", k=rng.randint(1, 4))): rng.choice(["X", "", "a", "yy"]) for _ in range(25)} | {"": "never"}
    texts = ["".join(rng.choices("ab?.c", k=rng.randint(0, 30))) for _ in range(300)]
    assert values(spark, texts, lambda c: U.mapped(c, words)) == [longest_first(t, words) for t in texts]
    assert values(spark, ["ab", None], lambda c: U.mapped(c, {})) == ["ab", None]


def test_repair(spark):
    rows = [(1, "=== ページ 3 === 本文。", 0), (2, "(cid:1)" * 6 + "迺ｾ遶縺縺縺", 0), (3, None, 0), (4, "good 縺ゅ→縺 text", 0), (5, "ｶﾞ，Company Secret x　\n y", 0)]
    out = U.repair_documents(spark.createDataFrame(rows, "doc_id int, text string, other int"))
    assert out.columns == ["doc_id", "text", "other"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: "本文.", 2: "環境[文字化け]", 3: "", 4: "good 縺ゅ→縺 text", 5: "ガ, x y"}
