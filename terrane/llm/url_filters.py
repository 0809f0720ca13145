"""URL filters: rules on hosts and paths, and for the rest trust and distrust carried over links between hosts.

A host whose pages the rules allow or block is a seed, weighted by the share of its pages. Trust is a personalised
PageRank along the links from trusted seeds; distrust then runs along reversed links from blocked seeds, for who links to
blocked hosts is suspect. A linker takes over what the hosts that it links to have of distrust beyond their trust, by the
share of its own links, so its verdict does not depend on how many others link there; hosts trusted on balance pass no
distrust on. Pages without a rule are blocked if their host's distrust exceeds its trust by a threshold. Masses are integers (a seed's whole is 10**12), so sums do not depend on the order of rows.

Defined results: a null url, or one without ``://``, has empty host and path and no rule; the empty host is never a
seed or an end of a link, so such pages are allowed; null html has no links; repeated pages count as often as they occur.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.tables import dropped, salted_join, written

#: Share of the mass that follows links, rounds, whole of a seed, and how far distrust must exceed trust (shares of a seed).
FOLLOW, ROUNDS, WHOLE, THRESHOLD = 0.85, 20, 10**12, 0.5
#: Rounds between two tables that cut the lineage.
CUT_EVERY = 5
_LINK = r"(?i)(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule], value: str) -> Column:
    """The text or action of the longest rule that fits, else null. The list is a parameter, so its chain is bounded."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.lit(getattr(rule, value))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """source, target, n: pages of a host that link to another host, counted before they are shuffled."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1), lowered))
    ends = pages.filter(F.col("html").contains("//")).select(F.col("host").alias("source"), F.explode(targets).alias("target"))
    return ends.filter((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))).groupBy("source", "target").agg(F.count("*").alias("n"))


def flows(links: DataFrame) -> DataFrame:
    """source, target, share: the share of the source's links that go to the target."""
    out = links.groupBy("source").agg(F.sum("n").alias("all_out"))
    return links.join(out, "source").select("source", "target", (F.col("n") / F.col("all_out")).alias("share"))


def propagated(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, follow: float = FOLLOW) -> DataFrame:
    """host, trust, distrust (in WHOLE of a seed), from seeds (host, trust, distrust as shares) over links."""
    spark = seeds.sparkSession
    start = seeds.select("host", (F.col("trust") * WHOLE).cast("long").alias("trust"), (F.col("distrust") * WHOLE).cast("long").alias("distrust"))
    start, start_at = written(start)
    moved, moved_at = written(flows(links))
    if moved.isEmpty():
        return start
    trust, trust_at = _rounds(start.select("host", F.col("trust").alias("mass")), start.limit(0).select("host", F.col("trust").alias("against")), moved.select(F.col("source").alias("origin"), F.col("target").alias("goal"), "share"), rounds, follow)
    distrust, distrust_at = _rounds(start.select("host", F.col("distrust").alias("mass")), trust.select("host", F.col("mass").alias("against")), moved.select(F.col("target").alias("origin"), F.col("source").alias("goal"), "share"), rounds, follow)
    both = trust.select("host", F.col("mass").alias("trust"), F.lit(0).cast("long").alias("distrust")).unionAll(distrust.select("host", F.lit(0).cast("long").alias("trust"), F.col("mass").alias("distrust")))
    ranks, _ = written(both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    dropped(spark, start_at, moved_at, trust_at, distrust_at)
    return ranks


def _rounds(start: DataFrame, against: DataFrame, moves: DataFrame, rounds: int, follow: float) -> tuple[DataFrame, str]:
    """host, mass after some rounds, and its table: in each, what a host's mass exceeds ``against`` by goes from origins to goals."""
    spark = start.sparkSession
    # What a host keeps back does not change, so it is joined to the moves once.
    held = moves.join(against.withColumnRenamed("host", "origin"), "origin", "left").withColumn("against", F.coalesce("against", F.lit(0)))
    fixed, fixed_at = written(held)
    ranks, last = start, None
    for k in range(1, rounds + 1):
        part = F.floor((F.col("r.mass") - F.col("f.against")) * F.col("f.share") * follow).cast("long")
        sent = fixed.alias("f").join(ranks.alias("r"), F.col("f.origin") == F.col("r.host")).select(F.col("f.goal").alias("host"), part.alias("mass"))
        ranks = start.unionAll(sent.filter("mass > 0")).groupBy("host").agg(F.sum("mass").alias("mass"))
        if k % CUT_EVERY == 0 or k == rounds:
            ranks, at = written(ranks)
            if last:
                dropped(spark, last)
            last = at
    dropped(spark, fixed_at)
    return ranks, last


def judge_pages(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; also the masses that decided where no rule did."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    host, path = F.col("host"), F.col("path")
    seen = split.select("page_id", "host", "path", ruled(host, path, rules, "text").alias("rule"), ruled(host, path, rules, "action").alias("action"))
    share = lambda action: F.sum(F.when(F.col("action") == action, 1).otherwise(0)) / F.count("*")
    seeds = seen.filter(host != "").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    ranks = propagated(seeds, host_links(split))
    verdict = F.when(F.coalesce("distrust", F.lit(0)) - F.coalesce("trust", F.lit(0)) > F.lit(int(threshold * WHOLE)), "block").otherwise("allow")
    judged = salted_join(seen, ranks, "host", "page_id")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", verdict).alias("verdict"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
