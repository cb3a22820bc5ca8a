"""URL filter: rules first, then the reputation of the host by empirical Bayes.

Labelled pages are outcomes (bad or not). The rate of a host is a beta-binomial
posterior whose prior is the rate of its registered domain, whose prior is that of
the suffix, whose prior is the rate of all pages. How far a level leans on the one
above is estimated from the labelled outcomes too: by moments, from how much its
groups vary around their priors. A page is blocked if even the lower bound of its
host's rate is above what is tolerated, so hosts with few outcomes pass.

The last label of a host is taken as its suffix and the last two as its registered
domain; no list of public suffixes is needed or read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainmetrics.llm.common import staged

#: (rule, verdict): a host, then the start of a path.
Rules = Sequence[tuple[str, str]]

#: A host is blocked if the lower bound of its bad rate is above this ...
TOLERATED = 0.5
#: ... where the bound lies so many posterior standard deviations below the mean.
DEVIATIONS = 1.645
#: Bounds of the estimated correlation within a group; prior weight is 1 / rho - 1.
RHO = (0.001, 0.999)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEVELS = ("suffix", "domain", "host")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        site, _, start = name.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit(f".{site}"))) & F.startswith(path, F.lit(f"/{start}"))
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _rho(groups: DataFrame) -> float:
    """Correlation of outcomes within groups (n, bad) around their prior means (m)."""
    inner = F.col("n") * (F.col("bad") / F.col("n") - F.col("m")) ** 2 / (F.col("m") * (1 - F.col("m")))
    row = (
        groups.where("n > 0 and m > 0 and m < 1")
        .agg(F.sum(inner).alias("v"), F.count("*").alias("g"), F.sum("n").alias("n"))
        .first()
    )
    if not row.g or row.n == row.g:
        return RHO[0]
    return min(RHO[1], max(RHO[0], (row.v - row.g) / (row.n - row.g)))


def reputations(outcomes: DataFrame) -> DataFrame:
    """``(host, mean, deviation)`` of the bad rate of every host of ``outcomes(host, n, bad)``.

    A row of ``outcomes`` is one host with its number of labelled and of bad pages, both
    of which may be zero. Without any labelled page all means are null.
    """
    last = F.regexp_extract("host", r"[^.]*$", 0)
    two = F.regexp_extract("host", r"[^.]*(\.[^.]*)?$", 0)
    hosts = outcomes.withColumns({"suffix": last, "domain": two})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = total.bad / total.n if total.n else None
    level = suffixes.withColumn("m", F.lit(rate).cast("double"))
    for name, below in (("suffix", domains), ("domain", hosts), ("host", None)):
        weight = 1 / _rho(level) - 1
        a = F.col("bad") + F.lit(weight) * F.col("m")
        b = F.col("n") - F.col("bad") + F.lit(weight) * (1 - F.col("m"))
        posterior = level.withColumns({"a": a, "b": b})
        if below is None:
            spread = F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b") + 1)) / (F.col("a") + F.col("b"))
            return posterior.select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), spread.alias("deviation"))
        prior = posterior.select(name, (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
        level = below.join(prior, name)
    raise AssertionError


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Rules = (),
    key: str = "page_id",
    url: str = "url",
    tolerated: float = TOLERATED,
    deviations: float = DEVIATIONS,
) -> DataFrame:
    """``(key, host, path, rule, verdict)`` for each row of ``pages``.

    ``outcomes`` has the same key and a boolean ``bad`` for the labelled pages; a null
    ``bad`` counts as unlabelled, and a page labelled twice as two outcomes, as does each
    of repeated rows. Rules go before reputation, the longest first. A null URL, or one
    without ``://``, has an empty host and path, and the reputation of the empty host.
    """
    host, path = parts(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    marked = outcomes.select(F.col(key).alias("key"), F.col("bad")).where("bad is not null")
    labelled = (
        rows.select("key", "host")
        .join(marked, "key")
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    )
    # Written once: every level of the hierarchy reads it.
    hosts = staged(rows.select("host").distinct().join(labelled, "host", "left").na.fill(0, ["n", "bad"]))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    bound = F.col("mean") - deviations * F.col("deviation")
    by_host = F.when(bound > tolerated, "block").otherwise("allow")
    return rows.join(reputations(hosts), "host", "left").select(
        F.col("key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict")
    )
