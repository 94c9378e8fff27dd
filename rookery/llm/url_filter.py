"""URL rules, and host reputation by empirical Bayes.

Labelled page outcomes (bad or not) are counted for each host and shrunk through beta-binomial
priors from suffix to registered domain to host: the suffix is shrunk to the overall rate, the
domain to its suffix, the host to its domain. The strength of each prior is fitted by moments to
the spread of rates between siblings. A page is blocked if the lower bound of its host's posterior
bad rate is over a limit.

Scale: one aggregation by host (partial on the map side, so a host with a third of all pages is one
row a task); priors are sums over hosts. The host table joins back to the pages by host: a shuffle
join that AQE splits when skewed, or a broadcast when Spark has measured it as small. Rules are a
parameter list of at most MAX_RULES, evaluated as one expression; no shuffle.

Defined results: a null url or one without `://` has empty host and path, fits no rule and is judged
by the overall rate; outcomes with a null label or host are left out; with no outcomes nothing is
blocked; pages that repeat are judged alike. `rule` is null where none fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1000
#: Words that advertising, betting and counterfeit sites carry in their names.
SPAM_WORDS = ["ads", "bet", "bets", "casino", "loans", "pills", "poker", "porn", "replica", "spam", "track", "xxx"]
#: Second-level labels under which names are registered (co.uk and the like).
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]


def host_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(rest, F.lit(""))


def _name_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    labels = F.split(_name_of(host), r"\.")
    n = F.size(labels)
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    return F.when((n > 2) & second.isin(SECOND_LEVEL) & (F.length(last) == 2), F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """The registered domain: one label before the suffix; a bare name is its own domain."""
    second = "|".join(SECOND_LEVEL)
    name = _name_of(host)
    found = F.regexp_extract(name, rf"([^.]+\.(?:(?:{second})\.[^.]{{2}}|[^.]+))$", 1)
    return F.when(found == "", name).otherwise(found)


def has_word(host: Column, words: list[str]) -> Column:
    """Whether one of the words stands between dots, hyphens or the ends of the host."""
    return host.rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with its path.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; join larger lists by host suffix")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, n, bad, rate, low: posterior of each host's bad rate, from outcomes (host, bad boolean).

    A row with a null `bad` only names a host; a host with no outcomes has its domain's rate.
    """
    bad = F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))
    hosts = outcomes.where("host IS NOT NULL").groupBy("host").agg(F.count("bad").alias("n"), bad.alias("bad"))
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    p = (whole["bad"] or 0) / (whole["n"] or 1)
    out, parent, counts = hosts, F.lit(p), ("n", "bad")
    for level in ("suffix", "domain", "host"):
        if level == "host":
            level_counts = counts
        else:
            sums = hosts.groupBy(level).agg(F.sum("n").alias(f"n_{level}"), F.sum("bad").alias(f"bad_{level}"))
            out, level_counts = out.join(sums, level), (f"n_{level}", f"bad_{level}")
        n, bad = (F.col(c) for c in level_counts)
        units = out.select(level, n.alias("n"), bad.alias("bad"), parent.alias("p")).distinct()
        fit = units.where("n > 0").agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("k"),
            F.sum(F.pow(F.col("bad") / F.col("n") - F.col("p"), 2) * F.col("n")).alias("spread"),
            F.sum(F.col("p") * (1 - F.col("p"))).alias("sampling"),
            F.sum(F.col("p") * (1 - F.col("p")) * F.col("n")).alias("within"),
        ).first()
        strength = _strength(fit)
        rate = (strength * parent + bad) / (strength + n)
        if level != "host":
            out = out.withColumn(f"rate_{level}", rate)
            parent = F.col(f"rate_{level}")
        else:
            a, b = strength * parent + bad, strength * (1 - parent) + n - bad
            sd = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
            out = out.withColumns({"rate": rate, "low": rate - z * sd})
    return out.select("host", "domain", "suffix", "n", "bad", "rate_suffix", "rate_domain", "rate", "low")


def _strength(fit, least: float = 1.0, most: float = 1000.0) -> float:
    """Pseudo-counts of a beta prior whose spread explains what sampling alone does not."""
    if not fit["n"]:
        return least
    between = (fit["spread"] - fit["sampling"]) / fit["n"]
    within = fit["within"] / fit["n"]
    return most if between <= within / most else min(most, max(least, within / between - 1))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], limit: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, host_rate, host_low for every row of `pages` (page_id, url).

    `outcomes`: (host, bad). A host without outcomes of its own is judged by its domain, and so on up.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = outcomes.select("host", "bad").unionByName(parts.select("host", F.lit(None).cast("boolean").alias("bad")))
    known = host_reputation(named).select("host", F.col("rate").alias("host_rate"), F.col("low").alias("host_low"))
    fitted = parts.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    judged = fitted.join(known, "host", "left")
    by_host = F.when(F.col("host_low") > limit, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_host).alias("verdict"), "host_rate", "host_low"
    )
