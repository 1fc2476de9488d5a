"""URL filters: fixed rules first, then empirical-Bayes host reputation.

A page whose url fits a rule takes the longest rule's verdict.  For all other
pages, labelled page outcomes (bad or not) give each host a posterior bad rate.
A host's few outcomes are shrunk by a beta prior centred on its registered
domain's rate, the domain's by one centred on its suffix, the suffix's by the
overall rate.  The prior strengths come from the data (moments of the
beta-binomial per level).  A page is blocked when the lower credible bound of its
host's rate lies above ``block_rate``.

Plan: counts are pre-aggregated per host before any shuffle, so a host with a
third of all pages is one row there; the pages then join the reputation table
on host (skew-splittable; Spark broadcasts it by itself only when it is small).

Defined cases: null url or no ``://``: empty host and path, no rule, the overall
prior decides; hosts without outcomes: their domain's, suffix's or the overall
posterior; no outcomes at all: uniform prior Beta(1, 1), all allowed; repeated
pages are judged row by row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import ascii_lower

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# second-level suffixes under which names are registered (fixed values)
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def suffix_of(host: Column) -> Column:
    """Last label, or last two where these are a known long suffix; no port."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting ``(verdict, "host/path")`` rule as struct(rule, verdict).

    Of equally long rules the first given wins.
    """
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(children: DataFrame, n: str, k: str, centre: str) -> float:
    """Prior strength of a level: how alike the children of one parent are.

    Method of moments: with children of n outcomes around the parent's rate p, the
    sum of (k - n p)^2 / n is p(1-p)(1 + (n-1) rho) on average; strength is 1/rho - 1.
    """
    p, size, hits = F.col(centre), F.col(n), F.col(k)
    noise = p * (1 - p)
    row = (
        children.where(size > 0)
        .agg(
            F.sum((hits - size * p) * (hits - size * p) / size).alias("s"),
            F.sum(noise).alias("a"),
            F.sum(noise * (size - 1)).alias("b"),
        )
        .first()
    )
    if not row["b"]:
        return 1.0
    rho = min(max((row["s"] - row["a"]) / row["b"], 1e-4), 0.5)
    return round(1 / rho - 1, 6)


def _with_bound(df: DataFrame, tail: float, grid: int) -> DataFrame:
    """Adds ``bound``: the lower ``tail`` quantile of Beta(a, b), on an even grid."""
    a, b = F.col("a"), F.col("b")
    x = lambda i: (i - F.lit(0.5)) / F.lit(float(grid))
    log = lambda i: (a - 1) * F.log(x(i)) + (b - 1) * F.log(1 - x(i))
    steps = F.sequence(F.lit(1), F.lit(grid))
    # the weights are scaled by the largest, then summed; each step in a column of its own
    df = df.withColumn("_log", F.transform(steps, log)).withColumn("_top", F.array_max("_log"))
    df = df.withColumn("_w", F.transform("_log", lambda v: F.exp(v - F.col("_top"))))
    df = df.withColumn("_sum", F.aggregate("_w", F.lit(0.0), lambda s, w: s + w))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"))
    walked = F.aggregate(
        "_w", start,
        lambda s, w: F.struct((s["s"] + w).alias("s"), (s["i"] + F.when(s["s"] + w < tail * F.col("_sum"), 1).otherwise(0)).alias("i")),
    )
    return df.withColumn("bound", x(walked["i"] + 1)).drop("_log", "_top", "_w", "_sum")


def reputation(
    hosts: DataFrame, outcomes: DataFrame, tail: float = 0.05, grid: int = 1024
) -> DataFrame:
    """host, n_outcomes, n_bad, mean, bound for every distinct host of ``hosts``.

    ``outcomes`` has one row per labelled page: host, bad (0 or 1).
    """
    counts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    # hosts with outcomes count for their domain and suffix also when no page asks for them
    asked = hosts.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
    known = (
        asked.unionByName(counts).groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    )
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    overall = (total["k"] + 1) / (total["n"] + 2)

    suffixes = known.groupBy("suffix").agg(F.sum("n").alias("sn"), F.sum("k").alias("sk")).withColumn("p0", F.lit(overall))
    s0 = _strength(suffixes, "sn", "sk", "p0")
    suffixes = suffixes.withColumn("ps", (F.col("sk") + s0 * F.col("p0")) / (F.col("sn") + s0)).select("suffix", "ps")

    domains = known.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk")).join(suffixes, "suffix")
    s1 = _strength(domains, "dn", "dk", "ps")
    domains = domains.withColumn("pd", (F.col("dk") + s1 * F.col("ps")) / (F.col("dn") + s1)).select("domain", "pd")

    rated = known.join(domains, "domain")
    s2 = _strength(rated, "n", "k", "pd")
    a, b = F.col("k") + s2 * F.col("pd"), F.col("n") - F.col("k") + s2 * (1 - F.col("pd"))
    rated = rated.select("host", "n", "k", a.alias("a"), b.alias("b"))
    return _with_bound(rated, tail, grid).select(
        "host", F.col("n").alias("n_outcomes"), F.col("k").alias("n_bad"),
        F.round(F.col("a") / (F.col("a") + F.col("b")), 9).alias("mean"), F.round("bound", 9).alias("bound"),
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]],
    block_rate: float = 0.5, tail: float = 0.05,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's posterior mean and bound."""
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    rep = reputation(base, outcomes, tail)
    own = F.when(F.col("bound") > block_rate, "block").otherwise("allow")
    return base.join(rep, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), own).alias("verdict"),
        F.col("mean").alias("bad_rate"), F.col("bound").alias("bad_rate_bound"),
    )


def outcomes_from_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcome of a page: its document's labels.  The second path segment of a page's
    url is its document's id; bad: quality 0 or toxic 1.  Labels repeated for an id
    count once, as bad if any says so."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.groupBy("doc_id").agg(F.max(F.coalesce(bad, F.lit(False)).cast("int")).alias("bad"))
    number = F.regexp_extract(path_of(F.col("url")), r"^/[^/]*/([0-9]{1,18})(?:[^0-9]|$)", 1)
    ids = (
        pages.select(host_of(F.col("url")).alias("host"), number.alias("n")).where(F.col("n") != "")
        .select("host", F.col("n").cast("long").alias("doc_id"))
    )
    return ids.join(known, "doc_id").select("host", "bad")
