"""URL filtering by rules and by empirical-Bayes host reputation.

Labelled page outcomes (good or not) are summed per host, registered domain and
suffix. At each level a beta-binomial prior is centred on the level above, with a
strength from the method of moments over that level's rates, so that a host with
few labelled pages is judged mostly by its domain, and a domain by its suffix. A host
without a rule is blocked if even the upper posterior bound of its rate of good pages
stays below ``least_good``.

A rule fits its host and all subdomains if the url's path starts with the rule's;
the longest rule wins and overrides the reputation.

Everything is a DataFrame expression; per page there is one join by page id and
one by host, whose hot keys adaptive execution splits.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is judged as a host of its own (the empty one). Outcomes that
are null are ignored, several for a page count each; pages without one count for
nothing. Null page ids pass through. With no outcomes at all nothing is blocked
but by rules. Added columns replace columns of their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import without

Z = 1.645
LEAST_GOOD = 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, str(r)).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _strength(table: DataFrame, good: str, seen: str) -> DataFrame:
    """One row ``k``: the beta prior's strength by the method of moments over rates of one level."""
    n, s = F.col(seen).cast("double"), F.col(good).cast("double")
    sums = table.where(F.col(seen) > 0).agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.count("*").alias("m"), F.sum(s * s / n).alias("q"))
    p = F.col("s") / F.col("n")
    within = p * (1 - p)
    # expected sum of n (rate - p)^2 is within * (m - 1) plus the spread between groups times n
    spread = (F.col("q") - F.col("n") * p * p - within * (F.col("m") - 1)) / F.col("n")
    k = F.when((F.col("m") > 1) & (spread > 0), within / spread - 1)
    return sums.select(F.least(F.greatest(F.coalesce(k, F.lit(1000.0)), F.lit(1.0)), F.lit(1000.0)).alias("k"), F.coalesce(p, F.lit(1.0)).alias("p"))


def reputations(counts: DataFrame, z: float = Z) -> DataFrame:
    """``host, pages_seen, mean, upper`` from ``host, good, seen``."""
    hosts = counts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "good", "seen")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("good").alias("d_good"), F.sum("seen").alias("d_seen"))
    suffixes = domains.groupBy("suffix").agg(F.sum("d_good").alias("s_good"), F.sum("d_seen").alias("s_seen"))
    # the three strengths are one row each
    s_prior = _strength(suffixes, "s_good", "s_seen").withColumnsRenamed({"k": "s_k", "p": "all_p"})
    d_prior, h_prior = _strength(domains, "d_good", "d_seen").select(F.col("k").alias("d_k")), _strength(hosts, "good", "seen").select(F.col("k").alias("h_k"))
    prior = s_prior.join(F.broadcast(d_prior)).join(F.broadcast(h_prior))
    top = suffixes.join(F.broadcast(prior)).select("suffix", "d_k", "h_k", ((F.col("s_k") * F.col("all_p") + F.col("s_good")) / (F.col("s_k") + F.col("s_seen"))).alias("s_mean"))
    middle = domains.join(top, "suffix").select("domain", "h_k", ((F.col("d_k") * F.col("s_mean") + F.col("d_good")) / (F.col("d_k") + F.col("d_seen"))).alias("d_mean"))
    total = F.col("h_k") + F.col("seen")
    low = hosts.join(middle, "domain").select("host", "seen", ((F.col("h_k") * F.col("d_mean") + F.col("good")) / total).alias("mean"), total.alias("total"))
    return low.select("host", F.col("seen").alias("pages_seen"), "mean", (F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("total") + 1))).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], url: str = "url", page_id: str = "page_id", z: float = Z, least_good: float = LEAST_GOOD) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and the host's posterior ``upper`` bound.

    ``outcomes`` has ``page_id`` and ``good`` (0 or 1).
    """
    own = without(pages, "host", "path", "rule", "verdict", "upper")
    placed = own.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    labelled = outcomes.where(F.col("good").isNotNull()).select(F.col("page_id").alias("__page"), F.col("good").cast("long").alias("good"))
    thin = pages.select(F.col(page_id).alias("__page"), host_of(F.col(url)).alias("host"))
    known = thin.join(labelled, "__page").groupBy("host").agg(F.sum("good").alias("good"), F.count("*").alias("seen"))
    # a host without labelled pages still gets its domain's rate
    every = thin.groupBy("host").agg(F.count("*").alias("__n")).join(known, "host", "left").select("host", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("seen", F.lit(0)).alias("seen"))
    upper = reputations(every, z).select(F.col("host").alias("__host"), "upper")
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    joined = placed.join(upper, F.col("host") == F.col("__host"), "left").drop("__host")
    by_method = F.when(F.col("upper") < least_good, "block").otherwise("allow")
    return joined.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_method))
