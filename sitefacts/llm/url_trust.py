"""URL filter: rules first, then trust and distrust spread over the link graph of hosts.

Hosts are joined by the links in their pages' html (absolute and protocol-relative ``href`` values),
counted per pair of hosts. Trust is a personalised PageRank from hosts that an allow rule names;
distrust is one over reversed links from hosts that a block rule covers from the root, so a host that
links to blocked ones gathers distrust. A host is blocked when its distrust is more than its trust and
at least ``min_share`` of what every host would start with if all were seeds. Everything is relational; ranks are landed per round,
and rounds go on until what is left to spread is below a thousandth of the least distrust that blocks.

Rules for odd input: a null url or one without ``://`` has an empty host and path; hosts without links
keep only what seeds give them; links of a host to itself do not count, and a host without outgoing
links passes nothing on; null html has no links. Repeated rows are judged alike and count their links
again. Empty tables give an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import land

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a host covers its subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, MIN_SHARE, TOLERANCE, PRECISION = 0.85, 0.5, 1e-9, 1e-3
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def parted(pages: DataFrame) -> DataFrame:
    rest = after_scheme(F.coalesce(F.col("url").cast("string"), F.lit("")))
    return pages.select("page_id", host_of(rest).alias("host"), path_of(rest).alias("path"))


def rules_by_host(hosts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, rules): the rules of each host and of the domains above it, longest first. Hosts meet rules by equality."""
    spark = hosts.sparkSession
    known = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, domain string, path string")
    labels = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    met = hosts.select("host", F.explode(above).alias("domain")).join(known, "domain")
    fit = F.struct((-F.length("domain") - F.length("path")).alias("rank"), F.concat("domain", "path").alias("rule"), "path", "verdict", (F.col("path") == "/").alias("whole"))
    return met.groupBy("host").agg(F.sort_array(F.collect_set(fit)).alias("rules"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted in the map tasks first."""
    rest = after_scheme(F.coalesce(F.col("url").cast("string"), F.lit("")))
    found = F.explode(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(LINK), F.lit(1))).alias("link")
    links = pages.select(host_of(rest).alias("src"), found).select("src", host_of(F.regexp_extract("link", r"//(.*)$", 1)).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank from seeds (host, share) over links (src, dst, n).

    A round's change shrinks by ``damping`` at least, so all later rounds together change the ranks by
    change * damping / (1 - damping) at most; that has to be below ``tolerance``. Unless ``rounds``
    are given, their number is only bounded by where this holds for any links.
    """
    if rounds is None:
        rounds = math.ceil(math.log(tolerance * (1 - damping) / 2) / math.log(damping)) + 1
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    edges = land(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("weight")), "host-edges")
    start = land(seeds.select("host", F.col("share").cast("double").alias("share")), "seeds")
    ranks = start.select("host", F.col("share").alias("rank"))
    if edges.isEmpty():
        return ranks.withColumn("rank", F.col("rank") * (1 - damping))
    for _ in range(rounds):
        passed = edges.join(ranks, edges.src == ranks.host).select(F.col("dst").alias("host"), (F.col("rank") * F.col("weight") * damping).alias("rank"))
        own = start.select("host", (F.col("share") * (1 - damping)).alias("rank"))
        new = land(passed.unionByName(own).groupBy("host").agg(F.sum("rank").alias("rank")), "ranks")
        change = new.join(ranks.withColumnRenamed("rank", "old"), "host", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        ranks = new
        if (change or 0.0) * damping / (1 - damping) < tolerance:
            break
    return ranks


def host_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING, rounds: int | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, rules, trust, distrust, blocked) for each host of the pages."""
    links = land(host_links(pages), "host-links")
    hosts = parted(pages).select("host").where("host <> ''").distinct()
    linked = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    every = land(hosts.unionByName(linked).distinct(), "hosts")
    fit = land(rules_by_host(every, rules), "host-rules")

    def shares(kind: Column) -> DataFrame:
        chosen = fit.where(F.exists("rules", lambda r: kind(r))).select("host")
        n = chosen.count()
        return chosen.withColumn("share", F.lit(1.0 / max(1, n)))

    least = min_share * (1 - damping) / max(1, every.count())
    tolerance = min(TOLERANCE, PRECISION * least) if least > 0 else TOLERANCE
    trust = spread(shares(lambda r: r["verdict"] == "allow"), links, damping, rounds, tolerance)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(shares(lambda r: (r["verdict"] == "block") & r["whole"]), back, damping, rounds, tolerance)
    joined = every.join(fit, "host", "left").join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
    filled = joined.select("host", "rules", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return filled.withColumn("blocked", (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING, rounds: int | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of ``pages``."""
    verdicts = land(host_verdicts(pages, rules, damping, rounds, min_share), "host-verdicts").withColumnRenamed("host", "of_host")
    joined = parted(pages).join(verdicts, F.col("host") == F.col("of_host"), "left")
    fit = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    own = joined.withColumn("fit", fit)
    verdict = F.when(F.col("fit").isNotNull(), F.col("fit.verdict")).otherwise(F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow"))
    return own.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
