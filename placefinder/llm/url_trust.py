"""Operator 7: URL filter by rules and link-graph propagation (DataFrame functions only).

Rules decide the urls they fit. For the others, trust flows from hosts that rules allow along host
links, and distrust flows from hosts that rules block against the links - who links to a blocked host
is suspect. Both are personalised PageRank over host edges gathered from the pages' own links; a host
is blocked if its distrust reaches the threshold and exceeds its trust.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule, sends no
links and is allowed; null html has no links; relative links stay on the host and are no edge;
repeated pages add to a host's share of pages and links like others; a null page_id keeps its row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import discard, save



#: (verdict, host, path), fixed by the task.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Walks go on until no host's score moves by SETTLED or more in a round; what is left to come is then under
#: SETTLED * DAMPING / (1 - DAMPING) = 6e-6 for the host that moves most. Every round takes the rest of all walks down to
#: DAMPING of what it was, so they settle: after some 90 rounds for a score of 1, and 100 more for ten million hosts that
#: all end in one.
DAMPING, SETTLED = 0.85, 1e-6
#: Distrust is in units of a host all of whose pages are blocked and that nothing else reaches.
BLOCK_AT = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest rule that fits; null without one."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    pick = lambda value: F.coalesce(*(F.when(f, F.lit(value(r))) for f, r in zip(fits, ordered)))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct links (source, target) between hosts. Counted on the map side first, so that a host
    with a third of all pages sends each of its edges once per task."""
    hrefs = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    links = pages.select(host_of(F.col(url_col)).alias("source"), F.explode(hrefs).alias("href"))
    absolute = F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), F.col("href"))).otherwise(F.col("href"))
    return links.select("source", host_of(absolute).alias("target")).filter("source <> '' AND target <> '' AND source <> target").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None, settled: float = SETTLED) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, trust, distrust) over ``edges`` (source, target).

    Both walks run in one table: a row per walk and host. Mass at hosts without links leaves the
    graph. Every fifth round the largest change is looked at, between two saved tables; the walks end when they
    are settled (or after ``rounds`` rounds, where given).
    """
    walks = save(
        edges.select(F.lit("trust").alias("walk"), F.col("source").alias("at"), F.col("target").alias("to"))
        .unionByName(edges.select(F.lit("distrust").alias("walk"), F.col("target").alias("at"), F.col("source").alias("to")))
    )
    start = save(seeds.select(F.col("host").alias("to"), F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("walk", "seed")))
    if walks.isEmpty():
        discard(walks)
        score = start.select("walk", "to", F.col("seed").alias("score"))
    else:
        spread = walks.groupBy("walk", "at").agg(F.count(F.lit(1)).alias("links"))
        weighed = save(walks.join(spread, ["walk", "at"]).select("walk", "at", "to", (F.lit(damping) / F.col("links")).alias("share")))
        discard(walks)
        score = start.select("walk", "to", F.col("seed").alias("score"))
        n = 0
        kept: list[DataFrame] = []
        while rounds is None or n < rounds:
            moved = weighed.join(score.withColumnRenamed("to", "at"), ["walk", "at"]).select("walk", "to", (F.col("score") * F.col("share")).alias("score"))
            new = moved.unionByName(start.select("walk", "to", F.col("seed").alias("score"))).groupBy("walk", "to").agg(F.sum("score").alias("score"))
            n += 1
            if n % 5 in (4, 0):
                new = save(new)
            if n % 5 == 0:
                change = new.join(score.withColumnRenamed("score", "old"), ["walk", "to"], "left").agg(F.max(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))))).first()[0]
                discard(*kept, score)
                kept = [new]
                score = new
                if change is None or change < settled:
                    break
            score = new
    return score.groupBy(F.col("to").alias("host")).agg(*(F.sum(F.when(F.col("walk") == w, F.col("score")).otherwise(0.0)).alias(w) for w in ("trust", "distrust")))


def url_verdicts(pages: DataFrame, page_id: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES, block_at: float = BLOCK_AT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, decided = rule_for(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", rule.alias("rule"), decided.alias("decided"))
    share = lambda v: F.avg(F.when(F.col("decided") == v, 1.0).otherwise(0.0))
    seeds = judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = save(propagate(seeds, host_edges(pages, url_col, html_col)))
    out = judged.join(scores, "host", "left")
    blocked = (F.coalesce("distrust", F.lit(0.0)) >= block_at) & (F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)))
    method = F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
