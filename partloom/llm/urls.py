"""URL filters: rules by host and path, and trust and distrust propagated over the links between hosts."""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from partloom.llm.common import ROWS_PER_TASK, cut, fresh, join_spread


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits; null if none does."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits))


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n): pages of host src with an absolute link to another host dst."""
    lower = lambda x: F.translate(x, string.ascii_uppercase, string.ascii_lowercase)
    links = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/"'?#\s>]+)"""), F.lit(1))
    return (
        pages.where((F.col(host) != "") & F.col(html).isNotNull())
        .select(F.col(host).alias("src"), F.explode(F.array_distinct(F.transform(links, lower))).alias("dst"))
        .where("src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, check_every: int = 4, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Personalised PageRank of (kind, host) from seeds (kind, host, seed).

    Trust flows along links and distrust against them; each kind's seeds sum to 1. A host without
    links of its kind passes nothing on. It ends when scores move by `tolerance` or less in all; each round moves at most `damping` of what the
    one before moved, so that log(tolerance / 2) / log(damping) rounds are enough, and a few more for the rounding of sums. Every check_every rounds the
    lineage is cut in the shared folder. The edges of a host that has over per_task of them are dealt to several tasks, to each of which its score
    is copied; the list of such hosts, at most one for each per_task edges, is what is broadcast.
    """
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    both = cut(both)
    fan = F.count(F.lit(1))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"), fan.alias("fan"), fan.alias("n_rows"))
    met = join_spread(both, out, ["kind", "src"], "n_rows", ["dst"], per_task=per_task)
    splits = F.ceil(F.col("fan") / per_task).cast("int")
    edges = cut(
        met.select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share"), F.pmod(F.xxhash64("dst"), splits).cast("int").alias("salt"))
    )
    hubs = cut(out.where(F.col("fan") > per_task).select("kind", F.col("src").alias("host"), splits.alias("splits")))
    spread = not hubs.isEmpty()
    start = cut(seeds)
    ranks = start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score"))
    for _ in range(check_every, int(math.log(tolerance / 2) / math.log(damping)) + 4 * check_every, check_every):
        before = ranks
        for _ in range(check_every):
            copies = ranks.join(F.broadcast(hubs), ["kind", "host"], "left") if spread else ranks.withColumn("splits", F.lit(1))
            salts = F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)).alias("salt")
            flow = (
                copies.select("kind", "host", "score", salts).join(edges, ["kind", "host", "salt"])
                .groupBy("kind", F.col("dst").alias("host"))
                .agg((damping * F.sum(F.col("score") * F.col("share"))).alias("score"))
            )
            jumps = start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score"))
            ranks = jumps.unionByName(flow).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        ranks = cut(ranks)
        moved = (
            ranks.unionByName(before.select("kind", "host", (-F.col("score")).alias("score")))
            .groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("d")).agg(F.sum("d")).first()[0]
        )
        if (moved or 0.0) <= tolerance:
            break
    return ranks


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules: tuple[UrlRule, ...] = RULES, most_distrust: float = 0.5) -> DataFrame:
    """pages with host, path, rule and verdict (`allow` or `block`).

    Rules decide first, the longest that fits. Their pages seed the propagation: a host's trust seed is its
    share of all allowed pages, its distrust seed its share of all blocked ones. Other pages follow
    their host: blocked if distrust / (trust + distrust) > most_distrust, else allowed, as are hosts
    that neither reaches. A null url, or one without `://`, has an empty host and path and is
    allowed; ties, of equal trust and distrust, are allowed too. Null or empty html has no links; of a very long one all links count.
    Repeated rows are judged alike, and count each. An empty table gives an empty one. Other columns stay, but for those named as the new ones.
    """
    fit = fresh(pages, "_fit")[0]
    rows = pages.drop("rule", "verdict").withColumns({"host": host_of(pages[url]), "path": path_of(pages[url])})
    rows = rows.withColumn(fit, matched(F.col("host"), F.col("path"), rules))
    kind = F.when(F.col(f"{fit}.verdict") == "allow", "trust").otherwise("distrust")
    hits = rows.where(F.col(fit).isNotNull()).groupBy(kind.alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    totals = hits.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = hits.join(totals, "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed"))
    scores = propagate(host_links(rows, "host", html), seeds)
    score = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    bad, n_rows = fresh(rows, "_bad", "_n_rows")
    blocked = score("distrust") > most_distrust * (score("trust") + score("distrust"))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias(n_rows)).join(scores.groupBy("host").agg(blocked.alias(bad)), "host", "left")
    verdict = F.coalesce(F.col(f"{fit}.verdict"), F.when(F.col(bad), "block"), F.lit("allow"))
    joined = join_spread(rows, hosts, ["host"], n_rows, ["path"], "left")
    return joined.withColumn("rule", F.col(f"{fit}.rule")).withColumn("verdict", verdict).drop(fit, bad)
