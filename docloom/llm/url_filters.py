"""URL filters by link-graph propagation.

Rules decide the urls that they fit. For the others the host decides: trust is a
personalised PageRank from the hosts whose pages the rules allow, distrust the same
walk on reversed links from the hosts whose pages they block, so distrust reaches
those who link to blocked hosts. A seed's weight is the share of its pages that the
rules allow (block). A host is blocked when its distrust reaches ``limit`` times what
a fully blocked seed gets by its own and exceeds its trust; else it is allowed.

Host edges come from absolute and protocol-relative links of the pages' html, once a
pair of different hosts, and all weigh alike. Each step of the walk is one join and
one sum with map-side combination. The scores of up to BROADCAST_HOSTS hosts are
broadcast, so the edges, dealt once by their source, stay where they are; beyond, both
sides are shuffled and hub hosts split by the adaptive skew join. Every step is a table
in the shared folder. The walk ends when the scores move by less than ``tolerance`` in
total, or at once in a graph without edges between hosts; one that still moves so after
``steps`` steps is an error. Mass at hosts without links goes back to the seeds, each by
its weight: that makes all scores larger by one factor, which is applied at the end.

Null url or one without ``://``: empty host and path, no rule, allowed. Null html: no
links. Repeated pages count for each row. Ties of rules of one length: the longer
host, then the smaller string. Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import Workspace

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links of a page that name a host.
_LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


#: Hosts whose scores are broadcast in a step.
BROADCAST_HOSTS = 300_000


@dataclass(frozen=True)
class Rule:
    """``host/path`` with a verdict; it fits the host, its subdomains and the paths below."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def url_host(url: Column) -> Column:
    found = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits, else nulls."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), len(r.host), [-ord(c) for c in r.pattern])):
        fits = rule.fits(host, path)
        pattern = F.when(fits, rule.pattern).otherwise(pattern)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return pattern, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (src, dst) between different hosts."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(_LINK), 1)
    found = pages.select(url_host(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.transform(links, lambda x: url_host(F.concat(F.lit(":"), F.regexp_replace(x, "^[A-Za-z]*:", "")))))).alias("dst"))
    return found.filter("src <> '' and dst <> '' and src <> dst").distinct()


def walk(edges: DataFrame, seeds: DataFrame, damping: float, steps: int, tolerance: float, ws: Workspace, name: str) -> tuple[DataFrame, float]:
    """(host, score) of a walk along (src, dst) that restarts at ``seeds`` (host, weight), and the score of a lone seed of weight 1.

    The scores of all hosts add up to the seeds' weights.
    """
    start = seeds.filter("weight > 0").select("host", (F.col("weight") * (1 - damping)).alias("base"))
    now = ws.save(start.select("host", F.col("base").alias("score")), f"{name}-0")
    change = 0.0
    if edges.take(1):
        hosts = edges.select(F.explode(F.array("src", "dst")).alias("host")).unionByName(start.select("host")).distinct().count()
        fan = edges.groupBy("src").agg(F.count(F.lit(1)).alias("fan"))
        weighted = ws.save(edges.join(fan, "src"), f"{name}-edges")
        for k in range(1, steps + 1):
            here = now.withColumnRenamed("host", "src")
            met = weighted.join(F.broadcast(here) if hosts <= BROADCAST_HOSTS else here, "src")
            moved = met.groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("score") / F.col("fan")) * damping).alias("in"))
            after = moved.join(start, "host", "full").select("host", (F.coalesce("in", F.lit(0.0)) + F.coalesce("base", F.lit(0.0))).alias("score"))
            after = ws.save(after, f"{name}-{k}")
            change = (
                after.select("host", "score")
                .unionByName(now.select("host", (-F.col("score")).alias("score")))
                .groupBy("host")
                .agg(F.abs(F.sum("score")).alias("d"))
                .agg(F.coalesce(F.sum("d"), F.lit(0.0)))
                .first()[0]
            )
            ws.drop(f"{name}-{k - 1}")
            now = after
            if change < tolerance:
                break
        else:
            raise RuntimeError(f"the {name} walk still moves by {change} after {steps} steps")
    given, held = start.agg(F.sum("base")).first()[0], now.agg(F.sum("score")).first()[0]
    factor = given / (1 - damping) / held if held else 1.0
    return now.select("host", (F.col("score") * factor).alias("score")), (1 - damping) * factor


def url_filter(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = 0.85,
    steps: int = 300,
    tolerance: float = 1e-6,
    limit: float = 0.5,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every page."""
    ws = Workspace(pages.sparkSession, "urls")
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    parsed = pages.select(id_col, host.alias("host"), path.alias("path"))
    pattern, verdict = matched_rule(rules, F.col("host"), F.col("path"))
    judged = parsed.select("*", pattern.alias("rule"), verdict.alias("by_rule"))

    seeds = ws.save(
        judged.filter("host <> ''")
        .groupBy("host")
        .agg(F.avg(F.expr("int(by_rule <=> 'allow')")).alias("allowed"), F.avg(F.expr("int(by_rule <=> 'block')")).alias("blocked")),
        "seeds",
    )
    edges = ws.save(host_edges(pages, url_col, html_col), "edges")
    trust, _ = walk(edges, seeds.select("host", F.col("allowed").alias("weight")), damping, steps, tolerance, ws, "trust")
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust, alone = walk(turned, seeds.select("host", F.col("blocked").alias("weight")), damping, steps, tolerance, ws, "distrust")

    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    scored = judged.join(scores, "host", "left").select(
        id_col, "host", "path", "rule", "by_rule", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
    bad = (F.col("distrust") >= limit * alone - 1e-9) & (F.col("distrust") > F.col("trust"))
    return scored.select(id_col, "host", "path", "rule", F.coalesce("by_rule", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
