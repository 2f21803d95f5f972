"""URL filters by propagation over the host link graph.

Rules judge the urls they fit; the longest wins. For urls without a rule the method decides by host: trust spreads from
hosts with allowed pages along links (personalised PageRank), distrust spreads from hosts with blocked pages against
the links, as who links to bad hosts is suspect. A host of which distrust exceeds trust times a factor is blocked.

The graph has one weighted edge for each pair of hosts, summed before anything is joined, so a host with a third of all
pages is a few rows. Each step is a join and a sum with partial sums over edges and hosts; nothing reaches the driver.

Defined cases: a null url or one without "://" has an empty host and path, takes no part in the graph and is allowed; a
null page has no links; links without a host stay within their own host and don't count; repeated rows count as pages;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._base import cut, release

DAMPING = 0.85
STEPS = 100
TOLERANCE = 1e-6
FACTOR = 1.0
#: Hosts of which the scores are small enough to be sent to every executor; more are joined by host.
FEW_HOSTS = 200_000


@dataclass(frozen=True)
class Rule:
    """A host (with its subdomains) and a path prefix."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


#: The rules of the registered query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, from the href attributes of pages (host, html)."""
    hrefs = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(r"""(?is)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))).alias("href"))
    to = hrefs.select(F.col("host").alias("src"), host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), "href")).otherwise(F.col("href"))).alias("dst"))
    return to.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(host, rank): personalised PageRank of seeds (host, seed), which sum to 1, along edges (src, dst, share).

    What reaches a host without links out of it goes back to the seeds. With that the ranks are those of a walk that
    simply loses it, scaled to a sum of 1, so the steps need no sum over the lost part. They end when a step changes the
    ranks by less than TOLERANCE in all.
    """
    rank = cut(seeds.select("host", F.col("seed").alias("rank")))
    for _ in range(steps):
        moved = edges.join(rank.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("share") * F.col("rank")) * damping).alias("rank"))
        both = moved.withColumn("old", F.lit(0.0)).unionByName(seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank"), F.lit(0.0).alias("old"))).unionByName(rank.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("old")))
        new = cut(both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")))
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        release(rank)
        rank = new
        if change < TOLERANCE:
            break
    total = rank.agg(F.sum("rank")).first()[0] or 1.0
    return rank.select("host", (F.col("rank") / total).alias("rank"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url", html: str = "html", factor: float = FACTOR) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust: one row for each row of pages."""
    where = F.col(f"`{url}`")
    named = pages.select(F.col(f"`{key}`").alias("page_id"), host_of(where).alias("host"), path_of(where).alias("path"), F.col(f"`{html}`").alias("html"))
    longest = sorted(rules, key=lambda r: -len(r.name))
    rule, verdict = F, F
    for r in longest:
        rule, verdict = rule.when(r.fits(), r.name), verdict.when(r.fits(), r.verdict)
    ruled = named.withColumns({"rule": rule, "ruled": verdict}) if rules else named.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
    hosts = cut(ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")))
    edges = cut(links(named))
    total = hosts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    trust = hosts.where("good > 0").select("host", (F.col("good") / F.lit(float(total["good"] or 1))).alias("seed"))
    doubt = hosts.where("bad > 0").select("host", (F.col("bad") / F.lit(float(total["bad"] or 1))).alias("seed"))
    if edges.isEmpty():
        # Without links all goes back to the seeds at once.
        trust, doubt = (x.select("host", F.col("seed").alias("rank")) for x in (trust, doubt))
    else:
        out = edges.groupBy("src").agg(F.sum("n").alias("t"))
        into = edges.groupBy("dst").agg(F.sum("n").alias("t"))
        trust = spread(trust, cut(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("t")).alias("share"))))
        doubt = spread(doubt, cut(edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("t")).alias("share"))))
    scores = hosts.select("host").join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(doubt.withColumnRenamed("rank", "distrust"), "host", "left").na.fill(0.0, ["trust", "distrust"])
    scores = F.broadcast(scores) if hosts.count() <= FEW_HOSTS else scores
    judged = ruled.drop("html").join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") > F.col("trust") * factor, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
