import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm import language_id as li

DOCS = "doc_id long, text string, lang string, score double, lang_pred string"


def greedy(sample, text):
    """Phrases of `text` by looking for each longest match in `sample`."""
    at = count = 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in sample:
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


@pytest.mark.parametrize(("block", "stride"), [(li.BLOCK, li.STRIDE), (16, 4)])
def test_phrases_match_brute_force(monkeypatch, block, stride):
    """Whole texts, phrases that reach over blocks, blocks that lie within one phrase."""
    monkeypatch.setattr(li, "BLOCK", block)
    monkeypatch.setattr(li, "STRIDE", stride)
    rng = np.random.default_rng(1)
    for _ in range(40):
        samples = {lang: "".join(rng.choice(list("abc "), rng.integers(1, 80))) for lang in "xy"}
        samples = {k: " ".join(("a" + v).split()) for k, v in samples.items()}
        model = li.Automata(samples)
        texts = [" ".join("".join(rng.choice(list("abcd "), rng.integers(0, 200))).split()) for _ in range(6)]
        texts += [samples["x"] * 4, samples["y"][: len(samples["y"]) // 2] + samples["x"], "a" * 3000]
        got = model.phrases([model.encode(t)[0] for t in texts])
        known = set("".join(samples.values()))
        plain = ["".join(c if c in known or c == " " else "?" for c in t) for t in texts]
        assert got.tolist() == [[greedy(samples[lang], t) for t in plain] for lang in "xy"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = li.fold_of(F.col("doc_id"), 3) == 1
    got = li.identify(docs, li.fit(docs.where(~held))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    right = defaultdict(list)
    for r in got:
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 1:
            right[r.lang].append(r.lang_pred == r.lang)
    print({lang: (len(x), sum(x) / len(x)) for lang, x in right.items()})
    assert all(sum(x) >= 0.97 * len(x) for x in right.values())
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_rows(spark):
    rows = [(1, "the one and the other of them", "en"), (2, "der eine und die andere", "de"), (3, None, "en"), (4, "", "de"), (5, "12 ?!\n", "en")]
    rows += [(6, "and the other", None), (None, "und die andere", None), (7, "漢字", "de"), (8, "und " * 40000, "de"), (1, "the one and the other of them", "en")]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], DOCS)
    got = {(r.doc_id, r.lang_pred) for r in li.identify(docs, li.fit(docs)).collect()}
    assert {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (None, "de"), (8, "de")} < got
    kept = li.keep_identified(docs, li.fit(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 6, 7, 8]
    empty = spark.createDataFrame([], DOCS)
    assert li.identify(empty, li.fit(empty)).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in li.identify(docs, li.fit(unlabelled)).collect()} == {"und"}


def _invented(rng, letters, words=300):
    """A language: its own words of its letters."""
    own = ["".join(rng.choice(letters, rng.integers(2, 7))) for _ in range(words)]
    return lambda n: " ".join(rng.choice(own, n))


def test_many_scripts_and_languages(spark):
    rng = np.random.default_rng(2)
    ranges = {"han1": (0x4E00, 400), "han2": (0x6000, 400), "hangul": (0xAC00, 400), "kana": (0x3041, 80), "cyrl": (0x430, 32), "grek": (0x3B1, 24)}
    speak = {k: _invented(rng, [chr(a + i) for i in range(n)]) for k, (a, n) in ranges.items()}
    speak |= {f"l{k:02d}": _invented(rng, list("abcdefghijklmnopqrstuvwxyz"), 60) for k in range(94)}
    rows, n = [], 0
    for lang, say in speak.items():
        for k in range(9):
            rows.append((n, say(80), lang if k < 6 else None, lang))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    got = {r.doc_id: r.lang_pred for r in li.identify(docs, li.fit(docs)).collect()}
    assert len(speak) == 100 and all(got[d] == truth for d, _, _, truth in rows)


def test_sample_does_not_shrink_with_languages(spark):
    say = _invented(np.random.default_rng(3), list("abcdefgh"))
    rows = [(k, say(400), f"l{k % 40}") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many, one = li.fit(docs), li.fit(docs.where("lang = 'l7'"))
    assert many.bits[many.languages.index("l7")] == one.bits[0] > np.log2(20_000)


def test_foreign_texts_go(spark):
    rng = np.random.default_rng(4)
    say = {"one": _invented(rng, list("abcdefghijkl")), "two": _invented(rng, list("mnopqrstuvwx"))}
    rows = [(k, say[lang](200), lang) for k in range(60) for lang in say]
    rows += [(1000, say["one"](50), None), (1001, say["two"](2), "two"), (1002, "".join(rng.choice(list("абвгде "), 300)), None), (1003, "".join(rng.choice(list("abcdefghijklmnopqrstuvwx "), 900)), None), (1004, "12", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in li.keep_identified(docs, li.fit(docs)).collect()}
    assert kept == {*range(60), 1000, 1001}


def test_a_stray_label_changes_no_other_prediction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    stray = spark.createDataFrame([(-1, "ok a", "xx"), (-2, "hello", "yy")], docs.schema)
    before = {r.doc_id: r.lang_pred for r in li.identify(docs, li.fit(docs)).collect()}
    model = li.fit(docs.union(stray))
    after = {r.doc_id: r.lang_pred for r in li.identify(docs, model).collect()}
    long = {r.doc_id for r in docs.where("length(text) > 50").collect()}
    assert len(long) > 900 and all(after[d] == before[d] for d in long)
    noise = spark.createDataFrame([(1, "zq xk wv jj qz kx vw qq zk xw " * 9, None)], docs.schema)
    assert np.isfinite(model.usual).all() and li.keep_identified(noise, model).collect() == []


def test_a_language_of_long_texts_is_learned_from_all_of_them(spark):
    rng = np.random.default_rng(5)
    say = {"one": _invented(rng, list("abcdefghijklmnop")), "two": _invented(rng, list("abcdefghijklmnop")), "six": _invented(rng, list("abcdefghijklmnop"))}
    rows = [(k, say["one"](3000), "one") for k in range(80)] + [(100, "abc", "one")]
    rows += [(200 + k, say["two"](60), "two") for k in range(80)]
    # the language begins with a page of another one
    rows += [(300 + k, say["two"](400) + " " + say["six"](4000), "six") for k in range(20)]
    rows += [(1000 + k, say[lang](40), None) for k, lang in enumerate(["one", "two", "six"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in li.identify(docs, li.fit(docs)).collect()}
    assert all(got[1000 + k] == lang for k, lang in enumerate(["one", "two", "six"] * 30))


def test_too_many_letters_are_refused():
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha() and chr(c).lower() == chr(c)]
    with pytest.raises(ValueError, match="different letters"):
        li.Automata({"all": "".join(letters[:70_000])})
