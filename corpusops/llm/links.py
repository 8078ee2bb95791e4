"""URL filtering: longest-match rules, and trust carried along the links between hosts for the rest.

Pages that a rule judges make their host a seed, by number of pages: allowed ones a trusted, blocked
ones a distrusted seed; a host can be both. Personalised PageRank carries trust from the trusted seeds
along the links, and distrust from the distrusted seeds against them, since who links to bad hosts
deserves suspicion but not who is linked by them. What ends at hosts without links returns to the
seeds. A host is blocked if its distrust exceeds its trust by the threshold.

Edges are the distinct links of each page to other hosts, counted per pair of hosts, and a pair of
edges between a host and its parent domain if both have pages. Both walks are one table and one
join per round, until nothing noticeable moves; only a sum every few rounds reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.contracts import DatasetError
from corpusops.session import cut_lineage

DAMPING = 0.85
MOST_ROUNDS = 2_000
ROUNDS_PER_LOOK = 5
SMALL_EDGES = 100_000
TOLERANCE = 1e-6
THRESHOLD = 1.0

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?is)<[a-z][^>]*?\shref\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"
LINKED_HOST = r"(?s)^[^/]*//([^/?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits as a struct of rule and verdict, or null.

    A rule is ``host/path``; it fits that host and its subdomains if the path begins with the rule's
    (from its slash on). Of equally long rules the first by code point wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, html: str) -> DataFrame:
    """``source, target, weight``: pages of a host that link to another one."""
    hosts = F.transform(
        F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), 1),
        lambda link: F.translate(F.regexp_extract(link, LINKED_HOST, 1), UPPER, LOWER),
    )
    linked = pages.filter("host != ''").select(F.col("host").alias("source"), F.explode(F.array_distinct(hosts)).alias("target"))
    return linked.filter((F.col("target") != "") & (F.col("target") != F.col("source"))).groupBy("source", "target").agg(F.count("*").alias("weight"))


def site_links(hosts: DataFrame) -> DataFrame:
    """Both ways between a host and its parent domain, if the parent has pages too."""
    parent = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("parent")).filter("parent != ''")
    known = parent.join(hosts.select(F.col("host").alias("parent")), "parent")
    one = F.lit(1).cast("long").alias("weight")
    return known.select(F.col("host").alias("source"), F.col("parent").alias("target"), one).unionAll(
        known.select(F.col("parent").alias("source"), F.col("host").alias("target"), one)
    )


def propagate(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``host, kind, score``: both walks, each normalised to the number of its seed pages.

    ``seeds(host, kind, mass)``; ``edges(source, target, weight)``. Kind 0 follows the edges, kind 1
    goes against them. A round moves what arrived in the last one, damped, one link further, so a host at
    any distance is reached. It ends when less than ``tolerance`` of all mass still moves, after some 85 rounds if
    everything lies in cycles; ``most_rounds`` without that is an error.
    """
    both = edges.select(F.lit(0).alias("kind"), "source", "target", "weight").unionAll(
        edges.select(F.lit(1).alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    )
    both = both.groupBy("kind", "source", "target").agg(F.sum("weight").alias("weight"))
    out = both.groupBy("kind", "source").agg(F.sum("weight").alias("_all"))
    walk = cut_lineage(both.join(out, ["kind", "source"]).select("kind", "source", "target", (F.col("weight") / F.col("_all") * damping).alias("part")))
    # Counted once: a small graph is sent to the scores of each round, a large one meets them by shuffle.
    if walk.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES:
        walk = F.broadcast(walk)
    start = seeds.filter("mass > 0").select("host", "kind", F.col("mass").cast("double").alias("moving"), F.lit(0.0).alias("settled"))
    state = cut_lineage(start)
    totals = {r["kind"]: r["s"] for r in state.groupBy("kind").agg(F.sum("moving").alias("s")).collect()}
    left, done = sum(totals.values()), 0
    while left > tolerance * sum(totals.values()):
        if done >= most_rounds:
            raise DatasetError(f"scores still move by {left:g} after {done} rounds")
        for _ in range(ROUNDS_PER_LOOK):
            moving = state.filter("moving > 0").select(F.col("host").alias("source"), "kind", "moving")
            moved = moving.join(walk, ["source", "kind"]).select(F.col("target").alias("host"), "kind", (F.col("moving") * F.col("part")).alias("moving"), F.lit(0.0).alias("settled"))
            stays = state.select("host", "kind", F.lit(0.0).alias("moving"), (F.col("settled") + F.col("moving")).alias("settled"))
            summed = moved.unionByName(stays).groupBy("host", "kind").agg(F.sum("moving").alias("moving"), F.sum("settled").alias("settled"))
            state, done = cut_lineage(summed), done + 1
        left = state.agg(F.sum("moving")).collect()[0][0] or 0.0
    # The mass that left at the ends is returned to the seeds: a factor a walk.
    reached = {r["kind"]: r["s"] for r in state.groupBy("kind").agg(F.sum("settled").alias("s")).collect()}
    factors = [F.lit(x) for kind, mass in reached.items() for x in (kind, totals[kind] / mass)]
    if not factors:
        return state.select("host", "kind", F.col("settled").alias("score"))
    return state.select("host", "kind", (F.col("settled") * F.element_at(F.create_map(*factors), F.col("kind"))).alias("score"))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    url: str = "url",
    html: str = "html",
    page_id: str = "page_id",
    threshold: float = THRESHOLD,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust``, one row per row of ``pages``.

    ``rules`` lists (``host/path``, ``allow`` or ``block``). Pages without a fitting rule get the verdict of
    their host: blocked if ``distrust > threshold * trust``. Null urls and urls without ``://`` have
    neither host nor path, fit no rule, take no part in the graph and are allowed, as are hosts that
    nothing reaches. Null or empty html has no links. Repeated pages count as often as they occur;
    other columns are not read. An empty table gives no rows.
    """
    address = F.col(f"`{url}`")
    host, path = host_of(address), path_of(address)
    judged = pages.select(
        F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"), F.col(f"`{html}`").alias("html")
    ).withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    per_host = cut_lineage(
        judged.filter("host != ''")
        .groupBy("host")
        .agg(F.count_if(F.col("r.verdict") == ALLOW).alias("good"), F.count_if(F.col("r.verdict") == BLOCK).alias("bad"))
    )
    seeds = per_host.select("host", F.lit(0).alias("kind"), F.col("good").alias("mass")).unionAll(
        per_host.select("host", F.lit(1).alias("kind"), F.col("bad").alias("mass"))
    )
    edges = host_links(judged, "html").unionAll(site_links(per_host.select("host")))
    score = propagate(seeds, edges, damping, tolerance)
    hosts = score.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == 1, F.col("score")).otherwise(0.0)).alias("distrust"),
    )
    bad = F.coalesce(F.col("distrust") > threshold * F.col("trust"), F.lit(False))
    return judged.drop("html").join(hosts, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(bad, BLOCK).otherwise(ALLOW)).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
