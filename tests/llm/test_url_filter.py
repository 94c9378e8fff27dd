import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rookery.llm.queries import QUERIES, RULES, page_outcomes
from rookery.llm.url_filter import SPAM_WORDS, domain_of, judge_urls, suffix_of


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :])[0]


def plain_rule(host, path, rules):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_posteriors(counts):
    """host -> (rate, low) by moments, level by level; the hosts of the tables have three or more labels."""
    names = {h: (".".join(h.split(".")[-2:]), h.split(".")[-1]) for h in counts}
    total = [sum(c[k] for c in counts.values()) for k in (0, 1)]
    parent = {h: total[1] / total[0] if total[0] else 0.0 for h in counts}
    for level in ("suffix", "domain", "host"):
        unit = {h: names[h][1] if level == "suffix" else names[h][0] if level == "domain" else h for h in counts}
        sums = defaultdict(lambda: [0, 0])
        for h, c in counts.items():
            sums[unit[h]][0] += c[0]
            sums[unit[h]][1] += c[1]
        units = {unit[h]: (*sums[unit[h]], parent[h]) for h in counts if sums[unit[h]][0]}
        n = sum(u[0] for u in units.values())
        strength = 1.0
        if n:
            spread = sum((b / m - p) ** 2 * m for m, b, p in units.values())
            between = (spread - sum(p * (1 - p) for _, _, p in units.values())) / n
            within = sum(p * (1 - p) * m for m, _, p in units.values()) / n
            strength = 1000.0 if between <= within / 1000 else min(1000.0, max(1.0, within / between - 1))
        if level == "host":
            out = {}
            for h, (m, b) in counts.items():
                x, y = strength * parent[h] + b, strength * (1 - parent[h]) + m - b
                out[h] = (x / (x + y), x / (x + y) - 1.645 * math.sqrt(x * y / ((x + y) ** 2 * (x + y + 1))))
            return out
        parent = {h: (strength * parent[h] + sums[unit[h]][1]) / (strength + sums[unit[h]][0]) for h in counts}


@pytest.mark.parametrize(("sf", "rules"), [("sf0.01", RULES), ("sf0.1", [])])
def test_whole_query_equals_plain_python(spark, sf, rules):
    sf = f"/root/testdata/{sf}"
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    labels = {r.doc_id: r.quality == 0 or r.toxic == 1 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    counts = defaultdict(lambda: [0, 0])
    for _, url in pages:
        host, at = cut(url)[0], re.search("/[a-z]{2}/([0-9]{1,18})", url or "")
        bad = True if set(re.split("[.-]", host)) & set(SPAM_WORDS) else labels.get(int(at[1])) if at else None
        counts[host][0] += bad is not None
        counts[host][1] += bad is True
    known = plain_posteriors(counts)
    want = {}
    for page, url in pages:
        host, path = cut(url)
        rule, verdict = plain_rule(host, path, rules)
        want[page] = (host, path, rule, verdict or ("block" if known[host][1] > 0.5 else "allow"), *(round(x, 9) for x in known[host]))
    frame = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    without = judge_urls(frame, page_outcomes(frame, spark.read.parquet(f"{sf}/labels.parquet")), [])
    got = (QUERIES["op10_url_filter"](spark, sf) if rules else without).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict, round(r.host_rate, 9), round(r.host_low, 9)) for r in got} == want
    if not rules:  # where no rule allows them, the method blocks the hosts whose outcomes are bad and no others
        blocked = {r.host for r in got if r.verdict == "block"}
        assert blocked == {h for h in counts if set(re.split("[.-]", h)) & set(SPAM_WORDS)} != set()


def test_edge_rows(spark):
    rows = [(None, "http://a.org/"), (1, "http://a.org/" + "x" * 300_000), (1, "http://a.org/y"), (1, "http://a.org/y"), (2, None)]
    pages = spark.createDataFrame([(*r, 0.1, 0.2) for r in rows], "page_id long, url string, host_rate double, host_low double")
    bad = spark.createDataFrame([("a.org", True)] * 60 + [("b.net", False)] * 60, "host string, bad boolean")
    got = judge_urls(pages, bad, RULES).collect()
    assert sorted((r.page_id or 0, len(r.path), r.verdict) for r in got) == [(0, 1, "block"), (1, 2, "block"), (1, 2, "block"), (1, 300_001, "block"), (2, 0, "allow")]


def test_registered_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.shop.co.uk:8080": ("shop.co.uk", "co.uk"), "me@www.net:1": ("www.net", "net"), "local": ("local", "local"), "": ("", "")}
    frame = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", domain_of(F.col("h")).alias("d"), suffix_of(F.col("h")).alias("s"))
    assert {r.h: (r.d, r.s) for r in frame.collect()} == hosts
