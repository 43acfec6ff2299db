"""Empirical-Bayes reputation of hosts, and URL rules; DataFrame functions only.

Labelled page outcomes (1 bad, 0 good) are counted per host, registered domain and suffix. Rates are shrunk downwards:
a suffix towards the whole table, a domain towards its suffix, a host towards its domain, each by a beta prior whose
strength is the beta-binomial moment estimate over that level. A host is blocked if the lower bound of its posterior bad
rate exceeds a threshold, fixed or a multiple of the whole table's rate, so that few outcomes block nobody.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import pin

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host/path prefix, verdict) that fits, and its verdict; nulls if none does."""
    named = verdict = None
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        of_host, slash, rest = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + rest)
        named = F.when(fits, F.lit(rule)).otherwise(F.lit(None).cast("string") if named is None else named)
        verdict = F.when(fits, F.lit(says)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    if named is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return named, verdict


def strength(children: DataFrame, low: float = 1.0, high: float = 1000.0) -> DataFrame:
    """One row with ``m``: the beta prior's strength by Kleinman's moments, from children ``n, k, parent`` (parent's rate)."""
    p, rate = F.col("k") / F.col("n"), F.col("parent")
    sums = children.where("n > 0").agg(
        F.count("*").alias("g"),
        F.sum("n").alias("all"),
        F.sum(F.col("n") * F.col("n")).alias("sq"),
        F.sum(F.col("n") * (p - rate) * (p - rate)).alias("s"),
        F.sum(F.col("n") * rate * (1 - rate)).alias("v"),
    )
    rate_var = F.col("v") / F.col("all")
    room = F.col("all") - F.col("sq") / F.col("all") - (F.col("g") - 1)
    rho = (F.col("s") - rate_var * (F.col("g") - 1)) / (rate_var * room)
    usable = (F.col("g") > 1) & (room > 0) & (rate_var > 0)
    # with too little to estimate from, parents count as little as may be
    rho = F.when(usable, F.least(F.lit(0.999), F.greatest(F.lit(0.0), rho))).otherwise(F.lit(1.0))
    return sums.select(F.least(F.lit(high), F.greatest(F.lit(low), (1 - rho) / F.greatest(rho, F.lit(1e-6)))).alias("m"))


def shrunk(level: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """``level(key, parent_key, n, k)`` with the ``prior`` rate and strength ``m`` of its beta prior.

    A prior comes from what the parent has besides the child itself, so no outcome counts twice on its way down.
    """
    above = parents.select(parent_key, *[F.col(c).alias(f"of_{c}") for c in ("n", "k", "prior", "m")])
    rest = F.col("of_n") - F.col("n") + F.col("of_m")
    prior = (F.col("of_k") - F.col("k") + F.col("of_m") * F.col("of_prior")) / rest
    known = level.join(above, parent_key).select(key, parent_key, "n", "k", prior.alias("prior"))
    m = strength(known.withColumnRenamed("prior", "parent")).first()["m"]  # one number
    return known.withColumn("m", F.lit(float(m)))


def host_reputation(
    pages: DataFrame,
    bad: Column,
    rules: Sequence[tuple[str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = 0.5,
    z: float = 1.96,
    lift: float | None = None,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, bad_rate, bad_low``.

    ``bad`` is the labelled outcome of a page: 1, 0, or null where it is unlabelled. The longest fitting rule decides;
    where none fits, a host is blocked if the lower bound (normal, ``z`` deviations) of its posterior bad rate is above
    ``threshold``, or with ``lift`` above so many times the bad rate of the whole table. A registered domain is the last two labels, a suffix the last one. Null urls and urls without "://" have
    empty host and path and share one reputation. With no labelled page the rate is 0.5 and nothing is blocked. Repeated
    pages count and are returned as often as they come, null ids too; an empty table gives an empty result.
    Counting is combined map-side, so a host with a third of all pages is one row when it travels.
    """
    url = F.col(url_col)
    seen = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), bad.cast("int").alias("bad"))
    hosts = seen.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
    hosts = hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    hosts = pin(hosts.withColumn("root", F.lit(".")), "hosts")  # one row per host, read for three levels
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    root = total(hosts, "root").select("*", F.lit(0.5).alias("prior"), F.lit(1.0).alias("m"))
    known_root = root.first()
    n, k = (known_root["n"], known_root["k"]) if known_root else (0.0, 0.0)
    table_rate = (k + 0.5) / (n + 1.0)
    suffixes = shrunk(total(hosts, "suffix", "root"), "suffix", root, "root")
    domains = shrunk(total(hosts, "domain", "suffix"), "domain", suffixes, "suffix")
    known = shrunk(hosts.select("host", "domain", "n", "k"), "host", domains, "domain")
    weight = F.col("n") + F.col("m")
    known = known.withColumns({"rate": (F.col("k") + F.col("m") * F.col("prior")) / weight, "weight": weight})
    low = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    known = known.select("host", F.col("rate").alias("bad_rate"), low.alias("bad_low"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_low") > (threshold if lift is None else lift * table_rate), F.lit("block")).otherwise(F.lit("allow"))
    judged = seen.drop("bad").join(known, "host").select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), method.alias("method"), "bad_rate", "bad_low")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("says", "method").alias("verdict"), "bad_rate", "bad_low")
