"""URL filter by link-graph propagation, in DataFrame operations only.

Trust starts at hosts that the rules mostly allow and follows links forwards (personalised
PageRank); distrust starts at hosts that they mostly block and follows links backwards, since who
links to a bad host shares its blame.  Both spread in one loop over host edges.  Masses are whole
numbers of a fixed total, so results don't depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import checkpoint, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOTAL = 1 << 60
#: what follows ``//`` in links that name a host, with or without a scheme
LINK = r"""(?i)\shref\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^"'<>\s]+)"""
#: rules up to which they are compiled into the plan; more are joined by host, with the same results
COMPILED = 1000
Rules = Sequence[tuple[str, str, str]]


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ordered(rules: Rules) -> list[tuple[str, str, str]]:
    """Longest first; of rules as long as each other, the one first in text order; one verdict for each."""
    return list({(h, p): (verdict, h, p) for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r), reverse=True)}.values())[::-1]


def best_rule(host: Column, path: Column, rules: Rules) -> Column:
    """Struct(rule, verdict) of the longest fitting rule, or null, as one expression.  rules: (verdict, host, path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(_ordered(rules)):
        fits = ((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rule(urls: DataFrame, rules: Rules) -> DataFrame:
    """urls(host, path, ...) with ``best``, the longest fitting rule.

    Many rules are a table that meets each host and its parent domains by key; whether it is sent to
    executors or shuffled follows from its size.  Each different host and path is looked up once.
    """
    if len(rules) <= COMPILED:
        return urls.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    listed = urls.sparkSession.createDataFrame([(i, h, p, h + p, verdict) for i, (verdict, h, p) in enumerate(_ordered(rules))], "turn long, domain string, start string, rule string, verdict string")
    parts = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = urls.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("domain"))
    fits = each.join(listed, "domain").where(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), "turn").alias("best"))
    return urls.join(best, ["host", "path"], "left")


def host_edges(pages: DataFrame, rules: Rules = ()) -> DataFrame:
    """(src, dst, vote): each pair of hosts that a link in ``html`` joins; links within a host don't count.

    vote: 1 if of the links' targets the rules allow more than they block, -1 if they block more, else 0.
    """
    target = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("target"))
    links = target.select("src", F.translate(F.regexp_extract("target", "^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract("target", "^[^/?#]*([^?#]*)", 1).alias("path"))
    ruled = with_rule(links.where("src <> host and src <> '' and host <> ''"), rules)
    return ruled.groupBy("src", F.col("host").alias("dst")).agg(F.signum(F.sum(weight())).cast("int").alias("vote"))


def weight() -> Column:
    return F.when(F.col("best.verdict") == "allow", 1).when(F.col("best.verdict") == "block", -1).otherwise(0)


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 16, every: int = 4) -> DataFrame:
    """(host, kind, mass): personalised PageRank with restart 0.15 at the seeds.

    seeds(host, kind): kind 0 spreads along src to dst, kind 1 along dst to src.  Each kind's seeds
    share TOTAL.  A host divides 0.85 of its mass among its edges; a host without any keeps it out
    of circulation.  A busy host's many edges are one row each, and a skewed join splits them.
    """
    ways = edges.select("src", "dst", F.lit(0).alias("kind")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("kind")))
    degree = ways.groupBy("src", "kind").agg(F.count(F.lit(1)).alias("degree"))
    ways = table(ways.join(degree, ["src", "kind"]), "ways")
    share = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    restart = checkpoint(seeds.join(F.broadcast(share), "kind").select("host", "kind", F.expr(f"{TOTAL}L div n").alias("mass")))  # share has two rows
    start = restart.select("host", "kind", F.expr("mass div 20 * 3").alias("mass"))
    mass = restart
    for k in range(rounds):
        sent = mass.withColumnRenamed("host", "src").join(ways, ["src", "kind"]).select(F.col("dst").alias("host"), "kind", F.expr("(mass - mass div 20 * 3) div degree").alias("mass"))
        mass = sent.unionByName(start).groupBy("host", "kind").agg(F.sum("mass").alias("mass"))
        if (k + 1) % every == 0:
            mass = checkpoint(mass)
    return mass


def judge(pages: DataFrame, rules: Rules, rounds: int = 16, ratio: int = 1) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    rules: (verdict, host, path).  The verdict is the longest fitting rule's; without one the page's
    host is blocked if its distrust exceeds ``ratio`` times its trust, else allowed.  Hosts that most
    rules on their pages block are seeds of distrust, those that most allow are seeds of trust, ties
    are neither.  For a host without pages of its own, each host that links to it has one vote, by
    the rules on the targets of its links.

    Null or malformed urls have an empty host and path, no rule, no edges and are allowed.  Null
    html has no links, and html of any length is searched as a whole.  Repeated pages are judged each, and add to no edge twice.  An empty table
    gives an empty result.  Other columns are ignored.
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.expr("html"))
    named = with_rule(seen.select("page_id", "host", "path"), rules)
    edges = table(host_edges(seen, rules), "edges")
    own = named.where("host <> ''").groupBy("host").agg(F.sum(weight()).alias("lean"))
    linked = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("vote").alias("votes"))
    lean = own.join(linked, "host", "full").select("host", F.coalesce("lean", "votes").alias("lean"))
    seeds = table(lean.where("lean <> 0").select("host", F.when(F.col("lean") > 0, 0).otherwise(1).alias("kind")), "seeds")
    mass = propagate(edges, seeds, rounds)
    scores = mass.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("mass")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("kind") == 1, F.col("mass")).otherwise(0)).alias("distrust"),
    )
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    return named.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(distrust / F.lit(ratio) > trust, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
