"""URL filters: rules on host and path, and trust that spreads over the host graph.

Hosts link to hosts where a page of one holds a link to the other. Trust is personalised
PageRank from the hosts of allowed pages along the links; distrust is the same from the
hosts of blocked pages against the links, as those who link to bad hosts are suspect. A
seed weighs as many pages as a rule judges on it. A page that no rule fits follows its
host: it is blocked where distrust less trust, both counted in pages, exceeds a share of
the host's own pages. Both walks go on until a block of steps adds less than a 10^-9 part;
a step adds at most ``damping`` times what the step before added, so 128 steps are always
enough.

Defined cases: a null url, or one without ``://``, has an empty host and path, which no
rule fits and no link reaches, so it is allowed; a null html has no links; repeated pages
count as often as they occur; an empty table gives an empty result; links of a host to
itself carry nothing; other columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biparta.session import materialize

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i:href)\s*=\s*["']([^"'<>]*)["']"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
# The walk ends when a block of steps adds less than this share.
SETTLED = 1e-9
# Steps between two written tables: a plan never spans more.
BLOCK = 8
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct ``(rule, action)`` of the longest rule that fits, or null."""
    found = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,action:string>")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, action`` of each page."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return split.withColumn("m", matching_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "m.rule", "m.action")


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, w``: number of links between two different hosts, relative links left out."""
    out = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))).alias("link"))
    out = out.filter(F.contains("link", F.lit("//"))).withColumn("link", F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")))
    out = out.select("src", host_of(F.col("link")).alias("dst")).filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return out.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def most_steps(damping: float = DAMPING, settled: float = SETTLED) -> int:
    """Steps after which a walk has settled, whatever the links."""
    return math.ceil(math.log(settled) / math.log(damping))


def host_scores(hosts: DataFrame, links: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """``host, trust, distrust``, each counted in pages.

    ``hosts``: ``host, allowed, blocked`` (pages judged by rules). Both walks run as two
    directions of one table, so a step is one join and one sum. What reaches a host
    without links in the walk's direction returns to the seeds: that walk is a multiple of
    the one that loses it, so the latter is run and scaled to the sum of the seeds.
    """
    seeds = hosts.select(
        "host", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("allowed").alias("seed")), F.struct(F.lit(1).alias("way"), F.col("blocked").alias("seed")))).alias("x")
    ).select("host", "x.way", F.col("x.seed").cast("double").alias("seed"))
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.lit(1).alias("way"), F.col("dst").alias("a"), F.col("src").alias("b"))))
    arcs = links.select(ways.alias("x"), "w").select("x.*", "w")
    shares = arcs.join(arcs.groupBy("way", "a").agg(F.sum("w").alias("total")), ["way", "a"]).select("way", F.col("a").alias("host"), "b", (F.col("w") / F.col("total")).alias("p"))
    shares = materialize(shares, "host-arcs")
    missing = shares.select(F.col("b").alias("host"), "way").distinct().join(seeds.select("host", "way"), ["host", "way"], "left_anti").withColumn("seed", F.lit(0.0))
    nodes = seeds.unionByName(missing.select("host", "way", "seed"))
    nodes = materialize(nodes, "host-nodes")
    # a fixed table between two blocks: what a walk holds only grows, so the growth of its sum is its change
    score, steps, held = nodes.withColumn("x", F.col("seed")), most_steps(damping, settled), None
    for step in range(1, steps + 1):
        moved = score.join(shares, ["host", "way"]).groupBy(F.col("b").alias("host"), "way").agg(F.sum(F.col("x") * F.col("p")).alias("got"))
        score = nodes.join(moved, ["host", "way"], "left").select("host", "way", "seed", (F.col("seed") + damping * F.coalesce("got", F.lit(0.0))).alias("x"))
        if step % BLOCK == 0 or step == steps:
            score = materialize(score, "host-scores")
            now = {r["way"]: (r["x"], r["seed"]) for r in score.groupBy("way").agg(F.sum("x").alias("x"), F.sum("seed").alias("seed")).collect()}
            before = held or {way: (seed, seed) for way, (_, seed) in now.items()}
            if all(x - before[way][0] <= settled * x for way, (x, _) in now.items()):
                break
            held = now
    # back to the sum of the seeds: two rows, one for each way
    scale = score.groupBy("way").agg(F.coalesce(F.try_divide(F.sum("seed"), F.sum("x")), F.lit(0.0)).alias("scale"))
    score = score.join(F.broadcast(scale), "way").withColumn("x", F.col("x") * F.col("scale"))
    return score.groupBy("host").agg(F.sum(F.when(F.col("way") == 0, F.col("x")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("way") == 1, F.col("x")).otherwise(0.0)).alias("distrust"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict, host_score`` of each page."""
    pages = pages.select("page_id", "url", "html")
    rows = judged(pages, rules)
    hosts = rows.filter(F.col("host") != "").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("blocked")
    )
    hosts = materialize(hosts, "hosts")
    scores = host_scores(hosts, host_links(pages))
    rate = F.round((F.col("distrust") - F.col("trust")) / F.col("n_pages"), 6)
    verdicts = materialize(hosts.join(scores, "host").select("host", rate.alias("host_score")), "host-verdicts")
    out = rows.join(verdicts, "host", "left")
    by_host = F.when(F.col("host_score") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", by_host).alias("verdict"), "host_score")
