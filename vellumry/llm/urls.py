"""URL filters: host and path rules, and link-graph propagation for the hosts they leave open.

Hosts are nodes; a link from a page of one host to another is an edge (links within a host are
edges to itself).  Trust starts at hosts with allowed pages and follows the links; distrust starts
at hosts with blocked pages and follows them backwards, since linking to bad hosts is what makes a
host suspect.  Both are personalised PageRanks, iterated together on one aggregated edge table until
they stand still.  Each walk starts with the mass 1, however many pages the rules name, and ends with
it: what hosts without links would hand on returns to the seeds.  A host is blocked if its distrust
outweighs its trust and is large for its share of the pages.  Everything is DataFrame functions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: (verdict, rule); a rule is a host, a slash and the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DAMPING = 0.85
#: Rounds go on until all that is still to come moves no more than this share of a walk's mass.
SETTLED = 1e-6
#: A round moves at most DAMPING times what the round before moved, so no walk takes longer.
MOST_ROUNDS = math.ceil(math.log(SETTLED * (1 - DAMPING)) / math.log(DAMPING)) + 1
#: Rounds between stored tables, which cut the lineage and tell how far the mass moved.
STORE_EVERY = 8
#: A host is blocked at this much distrust per share of all pages, if trust is not greater.
DENSITY = 0.2

#: What holds no links: comments, scripts and other raw text, up to their ends.
HIDDEN = "(?is)<!--.*?(?:-->|$)|<(script|style|textarea|template|noscript)\\b.*?(?:</\\1\\b|$)"
LINK = "(?i)<a(?=\\s)[^>]*?\\shref\\s*=\\s*[\"']?([^\"'\\s>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end; empty without ://."""
    at = F.locate("://", url)
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", 0)
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.translate(host, UPPER, LOWER))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    at = F.locate("://", url)
    path = F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*([^?#]*)", 1)
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(path)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and the number of links, counted per task before they meet.  Relative links stay on
    the page's host; links to anchors, to other schemes and inside HIDDEN parts are left out, as are
    attributes that only end in href."""
    shown = F.regexp_replace("html", HIDDEN, " ")
    links = F.filter(F.regexp_extract_all(shown, F.lit(LINK), F.lit(1)), lambda x: ~x.startswith("#"))

    def target(x: Column) -> Column:
        full = F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x)
        return F.when(full.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(full)).when(full.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit("")).otherwise(F.col("src"))

    named = pages.select(host_of(F.col("url")).alias("src"), F.coalesce(links, F.array().cast("array<string>")).alias("links")).where("src != ''")
    return named.select("src", F.explode(F.transform("links", target)).alias("dst")).where("dst != ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """walk, host and mass: personalised PageRank of both walks, each of mass 1.

    edges (src, dst, links) are walked forward by `trust` and backward by `distrust`; seeds (walk,
    host, mass) restart them.  Mass that hosts without links would hand on returns to the seeds.
    That only scales the result, so the walk is made without it and divided by its total in the end.
    A walk without seeds has no rows.
    """
    both = edges.select(F.lit("trust").alias("walk"), "src", "dst", "links").unionByName(
        edges.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    out = both.groupBy("walk", "src").agg(F.sum("links").alias("out"))
    steps = stash(both.join(out, ["walk", "src"]).select("walk", "src", "dst", (F.col("links") / F.col("out")).alias("share")), "link-steps")
    whole = seeds.groupBy("walk").agg(F.sum("mass").alias("_all"))
    start = stash(seeds.join(whole, "walk").select("walk", "host", (F.col("mass") / F.col("_all")).alias("mass")), "link-seeds")
    restart = start.select("walk", "host", (F.col("mass") * (1 - DAMPING)).alias("mass"))

    def step(now: DataFrame) -> DataFrame:
        moved = now.withColumnRenamed("host", "src").join(steps, ["walk", "src"]).select("walk", F.col("dst").alias("host"), (F.col("mass") * F.col("share") * DAMPING).alias("mass"))
        return moved.unionByName(restart).groupBy("walk", "host").agg(F.sum("mass").alias("mass"))

    now = start
    for _ in range(0, MOST_ROUNDS, STORE_EVERY):
        for _ in range(STORE_EVERY - 1):
            now = step(now)
        now = stash(now, "link-mass")  # the last round starts from a stored table, so both its ends are known
        after = stash(step(now), "link-mass")
        change = after.unionByName(now.withColumn("mass", -F.col("mass"))).groupBy("walk", "host").agg(F.abs(F.sum("mass")).alias("d")).groupBy("walk").agg(F.sum("d").alias("d")).agg(F.max("d")).first()[0]
        now = after
        if change is None or change < SETTLED * (1 - DAMPING):
            break
    totals = now.groupBy("walk").agg(F.sum("mass").alias("_all"))
    return now.join(totals, "walk").select("walk", "host", (F.col("mass") / F.col("_all")).alias("mass"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages.

    A rule's verdict stands; pages without one get their host's.  Null urls and urls without ://
    have an empty host and path, fit no rule and are allowed.  Rows that repeat are pages each; a
    null html has no links, as pages have where they have no html column; tags that are never closed
    end with the page.  A host whose trust and distrust are equal is allowed.  An empty table gives
    no rows; other columns than page_id, url and html are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    rows = stash(named.select("page_id", "host", "path", rule.alias("rule"), fixed.alias("fixed")), "url-rules")
    per_host = stash(rows.where("host != ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("fixed") == "allow").alias("allowed"), F.count_if(F.col("fixed") == "block").alias("blocked")), "url-hosts")
    total = per_host.agg(F.sum("pages")).first()[0] or 1
    seeds = reduce(DataFrame.unionByName, (per_host.where(F.col(c) > 0).select(F.lit(walk).alias("walk"), "host", (F.col(c) / total).alias("mass")) for walk, c in (("trust", "allowed"), ("distrust", "blocked"))))
    mass = propagate(host_edges(pages), seeds)
    scores = mass.groupBy("host").agg(F.sum(F.when(F.col("walk") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("walk") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust"))
    bad = per_host.join(scores, "host").where((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= DENSITY * F.col("pages") / total)).select("host", F.lit("block").alias("by_links"))
    judged = rows.join(bad, "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("fixed", "by_links", F.lit("allow")).alias("verdict"))
