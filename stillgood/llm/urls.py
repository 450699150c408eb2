"""URL filter: rules first, then trust and distrust that spread over the links between hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import LOWER, UPPER, broadcast_if_small

HREF = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_rule(rules: tuple[Rule, ...], what) -> Column:
    """Value of the longest rule that fits host and path; null without one."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        out = F.when(fits & F.col("path").startswith(rule.path), F.lit(what(rule))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``(src, dst, n)``: links between different hosts; relative links stay on their host and give none."""
    links = F.filter(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1)), lambda x: x.contains("://") | x.startswith("//"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return (
        pages.select(url_host(F.col(url)).alias("src"), F.explode(links).alias("link")).select("src", url_host(absolute).alias("dst"))
        .where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    )


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, max_rounds: int = 1_000) -> DataFrame:
    """``(host, trust, distrust)`` from ``seeds(host, trusted, blocked)``, both as shares of 0 to 1.

    Trust is a PageRank personalised on the trusted seeds, along links; distrust one on the blocked
    seeds against them. Both are given in units of what a seed alone would have. A round passes on
    what the one before added, ``damping`` times as much at most over all hosts, so no score is more
    than ``tolerance`` short when what is still to come sums up to less. Every round is written, so
    its lineage is short. Hosts whose pages nobody read have no seeds.
    """
    edges = written(edges, "edges")
    out, back = edges.groupBy("src").agg(F.sum("n").alias("all_out")), edges.groupBy("dst").agg(F.sum("n").alias("all_in"))
    edges = written(edges.join(out, "src").join(back, "dst").select("src", "dst", (F.col("n") / F.col("all_out")).alias("along"), (F.col("n") / F.col("all_in")).alias("against")), "edges")
    hosts = seeds.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    seeds = written(hosts.join(seeds, "host", "left").select("host", F.coalesce("trusted", F.lit(0.0)).alias("trusted"), F.coalesce("blocked", F.lit(0.0)).alias("blocked")), "seeds")
    ranks = seeds.select("host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust"), F.col("trusted").alias("more_trust"), F.col("blocked").alias("more_distrust"))
    if not edges.limit(1).count():
        return ranks.select("host", "trust", "distrust")
    for _ in range(max_rounds):
        trust = (
            edges.join(ranks.where("more_trust > 0").select(F.col("host").alias("src"), "more_trust"), "src")
            .groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("more_trust") * F.col("along"))).alias("more_trust"))
        )
        distrust = (
            edges.join(ranks.where("more_distrust > 0").select(F.col("host").alias("dst"), "more_distrust"), "dst")
            .groupBy(F.col("src").alias("host")).agg((damping * F.sum(F.col("more_distrust") * F.col("against"))).alias("more_distrust"))
        )
        more = {c: F.coalesce(c, F.lit(0.0)) for c in ("more_trust", "more_distrust")}
        ranks = written(
            ranks.select("host", "trust", "distrust").join(trust, "host", "left").join(distrust, "host", "left")
            .select("host", (F.col("trust") + more["more_trust"]).alias("trust"), (F.col("distrust") + more["more_distrust"]).alias("distrust"),
                    *(c.alias(name) for name, c in more.items())), "ranks")
        added = ranks.agg(F.greatest(F.sum("more_trust"), F.sum("more_distrust"))).first()[0]
        if added * damping / (1 - damping) < tolerance:
            return ranks.select("host", "trust", "distrust")
    raise RuntimeError("trust and distrust did not settle")


def judge_pages(pages: DataFrame, rules: tuple[Rule, ...], page_id: str = "page_id", url: str = "url", html: str = "html",
                min_distrust: float = 0.5, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` per page.

    The longest rule that fits decides. A host's seeds are the shares of its pages that rules allow
    and block. Other pages are blocked if the distrust of their host is ``min_distrust`` or more and
    above its trust, else allowed. Null urls and urls without ``://`` have an empty host and path and
    are allowed; null or empty html has no links; repeated pages count again; an empty table gives no
    rows; other columns are not read.
    """
    parts = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    ruled = parts.withColumn("rule", _by_rule(rules, str)).withColumn("verdict", _by_rule(rules, lambda r: r.verdict))
    share = lambda verdict: F.avg(F.when(F.col("verdict") == verdict, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    ranks = broadcast_if_small(written(propagate(seeds, host_edges(pages, url, html), damping, tolerance), "ranks"))
    spread = F.when((F.col("distrust") >= min_distrust) & (F.col("distrust") > F.col("trust")), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(ranks, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", spread).alias("verdict"), "trust", "distrust")
