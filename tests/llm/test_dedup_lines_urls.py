import hashlib

import numpy as np
import pytest
from compare import assert_same, connect

from rookery.llm import exact_dedup, line_dedup, url_filter
from rookery.llm.queries import ORACLES, QUERIES, RULES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, digest string, n long, h1 long, raw string"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), ORACLES[name])


def test_filter_has_no_false_negative():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 70000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        made = exact_dedup.build_filter(keys)
        assert exact_dedup.maybe_contains(made, keys).all() if n else True
        other = rng.integers(0, 2**63, 20000).astype(np.uint64)
        assert exact_dedup.maybe_contains(made, other).mean() < 0.02
        assert n < 1000 or len(made["bits"]) < 1.5 * n


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_dedup_edge_rows(spark, batches):
    rows = [(1, "a"), (2, None), (3, ""), (4, "a"), (4, "a"), (None, "b"), (9, "b "), (7, "x" * 500_000), (8, "x" * 500_000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame([(*r, "x", 1, 1, "x") for r in rows], DOCS), batches).collect()
    want = []
    for d, t in rows:
        group = [r[0] for r in rows if (r[1] or "") == (t or "")]
        keep = max((g for g in group if g is not None), default=None)
        want.append((d, keep, len(group), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("screened", [exact_dedup.SCREENED, 0])
def test_byte_check_counts_texts(spark, screened):
    """With the filters and, where digests are too many for them, without."""
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    digests = {i: hashlib.sha256(f"text {i}".encode()).hexdigest() for i in range(700)}
    repeated = spark.createDataFrame([(digests[i],) for i in range(300)], "digest string")
    got = {r.digest: r.texts for r in exact_dedup.byte_check(texts, repeated, screened, 50).collect()}
    assert all(got[digests[i]] == 1 for i in range(300)) and len(got) <= (700 if not screened else 320)


@pytest.mark.parametrize("batches", [1, 4, 5])
def test_line_dedup_edge_rows(spark, batches):
    line = "A line that is Long enough to be counted as one"
    rows = [(i, f"first {i}\n  {line.upper()}\t\nshort\n") for i in range(1, 6)] + [(6, None), (7, ""), (8, "\n\n"), (None, "x " * 90000), (9, line[:39])]
    frame = spark.createDataFrame([(*r, "x", 1, 1, "x") for r in rows], DOCS)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_frequent_lines(frame, batches=batches).collect()}
    assert got[5] == (4, 0, rows[4][1]) and got[1] == (4, 1, "first 1\nshort\n") and got[8] == (3, 0, "\n\n")
    assert got[6] == got[7] == (1, 0, "") and len(got) == len(rows)
    assert line_dedup.drop_frequent_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_url_rules_and_reputation(spark):
    urls = ["http://A.example.com/en/x?q", "https://www.example.com/en/", "http://x.net/es/1", "http://x.net/de/1", "http://net/fr/", None, "no scheme", "http://example.com", "ftp://h.org?a/b#c", "http://badexample.com/en/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    bad = [("bad.org", True)] * 40 + [("fine.org", False)] * 40 + [("h.org", None), (None, True)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, spark.createDataFrame(bad, "host string, bad boolean"), RULES).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3][2:] == (None, "allow") and got[4][2:] == ("net/fr/", "block")
    assert got[5] == ("", "", None, "allow") == got[6] and got[7][:3] == ("example.com", "", None)
    assert got[8] == ("h.org", "", None, "allow") and got[9][2:] == ("com/", "allow")
    more = spark.createDataFrame([(1, "http://bad.org/"), (2, "http://sub.bad.org/"), (3, "http://fine.org/")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.host_rate) for r in url_filter.judge_urls(more, spark.createDataFrame(bad, "host string, bad boolean"), RULES).collect()}
    assert got[1][0] == "block" and got[3][0] == "allow" and got[3][1] < got[2][1] < got[1][1]
    none = url_filter.judge_urls(pages.limit(0), spark.createDataFrame([], "host string, bad boolean"), RULES)
    assert none.collect() == []
    assert url_filter.judge_urls(pages, spark.createDataFrame([], "host string, bad boolean"), []).where("verdict = 'block'").count() == 0
