import random
import re
import zlib
from collections import Counter

import pytest

from rookery.llm.spelling import count_words, hashes_without, near_words, spelling_groups

SMALL = "abcdefghijklmnopqrstuvwxyz"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_counts(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    keys, rows = {}, []
    for w in counts:
        for i in range(len(w)):
            keys.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    around = {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            around[w] |= keys[w[:i], w[i + 1 :]] - {w}
            if w[:i] + w[i + 1 :] in counts:
                around[w].add(w[:i] + w[i + 1 :])
                around[w[:i] + w[i + 1 :]].add(w)
    form = {}
    for w, n in counts.items():
        best = min(around[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(around[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_documents_against_brute_force(spark):
    from rookery.llm.queries import op12_spelling

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(brute_counts(docs))
    assert len(want) > 1000 and any(r[1] for r in want)
    assert rows_of(op12_spelling(spark, sf)) == want


def test_sql_twin_against_brute_force():
    import duckdb

    from rookery.llm.queries import ORACLES

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = brute(brute_counts(con.execute("SELECT doc_id, text FROM documents").fetchall()))
    assert sorted(con.execute(ORACLES["op12_spelling"]).fetchall()) == want


def test_near_words_of_every_kind(spark):
    rng = random.Random(7)
    words = {"aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaa", "aaaaab", "àaaaaa", "àaaaaÿ", "ßßßßßß", "ßßßßßßß"}
    while len(words) < 1500:
        w = "".join(rng.choices("abcàÿ", k=rng.randint(6, 8)))
        words.add(w)
    for size in (30, 31, 32, 33, 34, 40, 200):  # around the last level, and far beyond
        base = "".join(rng.choices("abé", k=size))
        words.add(base)
        for _ in range(12):
            at = rng.randrange(size)
            words.add(base[:at] + base[at + 1 :])
            words.add(base[:at] + rng.choice("abcé") + base[at + 1 :])
            words.add(base[:at] + rng.choice("abcé") + base[at:])
    counts = {w: rng.choice([5, 6, 30, 200, 9000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    want = {(a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) <= 1 and near(a, b)}
    got = [(r.word, r.near) for r in near_words(df).collect()]
    assert len(got) == len(set(got)) == 2 * len(want)
    assert {tuple(sorted(p)) for p in got} == want


def test_chains_follow_to_the_last_form(spark):
    # each word is one letter longer and six times as frequent
    docs, text = [], []
    word = "spellin"
    for i in range(5):
        text += [word] * (5 * 6**i)
        word += "gxyzw"[i]
    docs = [(3, " ".join(text)), (1, None), (2, "")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, word string")
    got = rows_of(spelling_groups(df))
    assert got == brute(brute_counts(docs))
    assert sum(r[1] is not None for r in got) >= 3 and len({r[2] for r in got}) < len(got)


def test_edges_of_texts(spark):
    long = "ab" * 50_000
    docs = [(1, "ÀÉ×÷ÿß Straße STRASSE straße"), (2, " ".join(["Éclair", "éclair", "ECLAIR"] * 9)), (3, long), (3, long), (4, long + " " + long), (5, long), (6, " ".join([long[:-1]] * 40)), (7, "a" * 100_000 + "1" + "日本語テキスト" * 10)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert rows_of(spelling_groups(df)) == brute_long(docs, long)
    none = spelling_groups(df.limit(0))
    assert none.columns == ["word", "form", "root", "n", "n_near", "form_n"] and none.collect() == []
    assert spelling_groups(df.where("doc_id = 1")).collect() == []
    assert dict(count_words(df).where("n >= 5").collect()) == brute_counts(docs)


def brute_long(docs, long):
    counts = brute_counts(docs)
    short = [r for r in brute({w: n for w, n in counts.items() if len(w) < 1000})]
    a, b = long, long[:-1]
    form = a if counts[a] >= 5 * counts[b] else b if counts[b] >= 5 * counts[a] else None
    rows = []
    for own, other in ((a, b), (b, a)):
        led = form == other
        rows.append((own, other if led else None, other if led else own, counts[own], 1, counts[other] if led else None))
    return sorted(short + rows)


@pytest.mark.parametrize("word", ["aabbcc", "aaaaaa", "abcdef", "ÿaÿaÿa"])
def test_hashes_without(word):
    full, gap, short, at = hashes_without(word)
    assert len(gap) == len(word) and at.tolist() == [i for i in range(len(word)) if i == 0 or word[i] != word[i - 1]]
    for value, i in zip(short, at, strict=True):
        assert value == hashes_without(word[:i] + word[i + 1 :])[0]
    for i in range(len(word)):
        other = word[:i] + "q" + word[i + 1 :]
        assert hashes_without(other)[1][i] == gap[i] and hashes_without(other)[0] != full
