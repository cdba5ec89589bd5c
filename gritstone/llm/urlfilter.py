"""URL filters: rules by host and path, and for the rest an empirical-Bayes reputation of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import save

#: Labels under a country's two letters that domains are registered below (as in co.uk); any other suffix is the last label.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
TWO_LABEL_SUFFIX, ADDRESS = rf"^({'|'.join(SECOND_LABELS)})\.[a-z]{{2}}$", r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"

#: The least and largest strength of a prior, in pages; and that of a level whose counts say nothing of it.
STRENGTHS, UNTOLD = (1.0, 1000.0), 20.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? or #. Both empty for null or without ://."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix above it; a host of fewer labels is its own, and so is a numeric address, whose suffix is `ip`. User
    names, ports and last dots have no part in either."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    two = F.substring_index(name, ".", -2)
    long, address = two.rlike(TWO_LABEL_SUFFIX), name.rlike(ADDRESS)
    domain = F.when(address, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(address, "ip").when(long, two).otherwise(F.substring_index(name, ".", -1))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule (host and path in one string) and verdict of the longest rule that fits, else null: a rule fits its host and all hosts below it where
    the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tested first
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def strength(level: DataFrame) -> float:
    """How many pages the prior of a level's members is worth, by the method of moments, from n (outcomes), g (good ones) and p (the prior's mean) of
    each.

    In a beta-binomial of that mean and a strength s, the variance of g is n p (1 - p) (1 + (n - 1) / (s + 1)). What the members' squared distances
    from n p have beyond n p (1 - p) gives s; it is kept within STRENGTHS. Where no member has two outcomes, or all of them are sure, it is UNTOLD.
    """
    even = F.col("n") * F.col("p") * (1 - F.col("p"))
    gone = F.pow(F.col("g") - F.col("n") * F.col("p"), 2) - even
    beyond, room = level.agg(F.sum(gone), F.sum(even * (F.col("n") - 1))).first()  # one row
    if not room:
        return UNTOLD
    return min(max(room / beyond - 1, STRENGTHS[0]), STRENGTHS[1]) if beyond > 0 else STRENGTHS[1]


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host and bound: the lower posterior bound of the share of good pages for each host of pages.

    pages: page_id, host, domain, suffix. outcomes: page_id, good (0 or 1; others do not count). The share of good pages at a level has a beta prior
    centred on the level above's posterior mean: all pages (their own share, (g + 1/2) / (n + 1)), then suffix, registered domain, host. How many
    pages a level's prior is worth is estimated from the counts of that level. The bound approximates the posterior's lower quantile: the beta's
    log-odds are taken for normal, with mean ln(a / b) and variance 1/a + 1/b, and z standard deviations go off.

    Counts are made by host before anything else is shuffled, so a host with a third of all pages costs a row a task; each level up works on the sums
    of the level below.
    """
    good = F.when(F.col("good") == 1, 1).otherwise(0)
    known = outcomes.where(F.col("good").isin(0, 1)).select("page_id", good.alias("good"))
    host = pages.join(known, "page_id", "left").groupBy("host", "domain", "suffix").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g")
    )
    host = save(host, "hosts")
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    n, g = suffix.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0))).first()

    def mean(level: DataFrame, worth: float) -> Column:
        return (F.col("g") + F.col("p") * worth) / (F.col("n") + F.lit(worth))

    suffix = suffix.withColumn("p", F.lit((g + 0.5) / (n + 1)))
    suffix = suffix.select("suffix", mean(suffix, strength(suffix)).alias("p"))
    domain = domain.join(suffix, "suffix")
    domain = domain.select("domain", "suffix", mean(domain, strength(domain)).alias("p"))
    host = host.join(domain, ["domain", "suffix"])
    worth = strength(host)
    a, b = F.col("g") + F.col("p") * worth, F.col("n") - F.col("g") + (1 - F.col("p")) * worth
    return host.select("host", (1 / (1 + F.exp(F.lit(z) * F.sqrt(1 / a + 1 / b) - F.log(a / b)))).alias("bound"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], least: float = 0.7, z: float = 1.645
) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), bound for every row of pages (page_id, url).

    Where a rule fits, the longest one says the verdict; else a host is allowed where the lower posterior bound of its share
    of good pages is at least `least`. A null url or one without :// has empty host and path, which are a host like any other.
    Pages without outcome count nothing. Repeated pages are judged one by one. Other columns are not looked at.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    domain, suffix = domain_and_suffix(F.col("host"))
    bounds = reputation(pages.select("page_id", "host", domain.alias("domain"), suffix.alias("suffix")), outcomes, z)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    out = pages.join(bounds, "host").withColumn("rule", rule)
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("bound") >= least, "allow").otherwise("block")).alias("verdict"),
        F.round("bound", 9).alias("bound")
    )
