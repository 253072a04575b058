"""URL filters: rules first, then trust and distrust carried over the link graph of hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import passing, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts of absolute and scheme-relative links in a page.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""
#: (verdict, rule); of the rules that fit, the longest wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def split_url(url: str) -> tuple[F.Column, F.Column]:
    """Host and path columns of a url column; both empty for null or without ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host, path, rules=RULES) -> F.Column:
    """The longest rule whose host is ``host`` or a parent domain and whose path begins ``path``; null if none."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts, from pages with host and html.

    Links are first counted within each page, so the shuffle carries one row per
    page and target host at most, combined again before it.
    """
    return (
        pages.where("host <> ''")
        .select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
        .withColumn("dst", F.translate("dst", UPPER, LOWER))
        .where("src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("links"))
    )


def _shares(edges: DataFrame, part_edges: int) -> tuple[DataFrame, DataFrame]:
    """(kind, host, part, to, share) of links, and (kind, host, part): a host has one part for each ``part_edges`` of its links.

    Links are counted and know their host's sums by (host, salt), so no task gets all links of a hub.
    """
    edges = stored(edges)  # pages are read for links once
    trust = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links")
    both = trust.union(edges.select(F.lit("distrust"), "dst", "src", "links"))
    both = both.withColumn("salt", F.pmod(F.xxhash64("to"), F.lit(64)).cast("int"))
    salted = both.groupBy("kind", "host", "salt").agg(F.sum("links").alias("links"), F.count(F.lit(1)).alias("n"))
    hosts = salted.groupBy("kind", "host").agg(F.sum("links").alias("all"), F.ceil(F.sum("n") / part_edges).cast("int").alias("parts"))
    known = both.join(salted.select("kind", "host", "salt").join(hosts, ["kind", "host"]), ["kind", "host", "salt"])
    part = F.pmod(F.xxhash64("to", F.lit(3)), F.col("parts")).cast("int")
    steps = known.select("kind", "host", part.alias("part"), "to", (F.col("links") / F.col("all")).alias("share"))
    return stored(steps), stored(hosts.select("kind", "host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 15, cut_every: int = 5, part_edges: int = 10_000) -> DataFrame:
    """(kind, host, score): personalised PageRank of each kind of seed.

    seeds: kind, host, seed (sums to 1 within a kind). Trust flows along links,
    distrust against them. Mass that reaches a host without further links is
    not handed on. Every fifth step is written to the shared folder. A host's rank
    first goes to its parts of ``part_edges`` links each, and from there along them.
    """
    steps, parts = _shares(edges, part_edges)
    seeds = stored(seeds)
    rank = seeds.select("kind", "host", F.col("seed").alias("score"))
    if steps.isEmpty():
        return rank
    for i in range(iterations):
        moved = rank.join(parts, ["kind", "host"]).join(steps, ["kind", "host", "part"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        back = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
        rank = moved.union(back).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if (i + 1) % cut_every == 0:
            rank = stored(rank)
    return rank


@passing("page_id", "url", "html")
def judge_pages(pages: DataFrame, rules=RULES, threshold: float = 0.5, salts: int = 32) -> DataFrame:
    """pages (page_id, url, html, more) with host, path, rule, trust, distrust and verdict.

    A page that a rule fits gets the rule's verdict. Hosts of allowed pages seed
    trust and hosts of blocked pages seed distrust, each by its number of such
    pages. The method's verdict on another page is ``block`` if distrust makes
    more than ``threshold`` of its host's trust and distrust together, else
    ``allow``; a host that neither reaches is allowed.

    Edge cases: a null url or one without ``://`` has empty host and path, no
    rule, and is allowed; null html has no links; repeated pages count again as
    seeds and links; an empty table gives an empty result; other columns pass
    through (html doesn't), but the names added here are replaced.
    """
    pages = pages.drop("host", "path", "rule", "trust", "distrust", "verdict")
    host, path = split_url("url")
    pages = pages.withColumn("host", host).withColumn("path", path)
    pages = pages.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for verdict, rule in rules:
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    pages = pages.withColumn("_said", said)
    counts = pages.where("rule IS NOT NULL").groupBy(F.when(F.col("_said") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = counts.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed"))  # two rows at most
    ranks = propagate(host_edges(pages), seeds)
    hosts = ranks.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust"),
    )
    # A hot host's pages are dealt to many tasks; its one row goes to each of them.
    dealt = pages.drop("html").withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    spread = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    judged = dealt.join(spread, ["host", "_salt"], "left")
    bad = F.coalesce(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit(False))
    verdict = F.coalesce("_said", F.when(bad, "block").otherwise("allow"))
    return judged.withColumn("verdict", verdict).drop("_salt", "_said")
