"""URL filtering by rules and by trust and distrust that travel over the graph of hosts.

A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest
rule wins. Hosts of which at least SEED of the pages fall under allow rules are trusted seeds, under block rules
blocked seeds, weighted by their pages. Edges lead from a host to the hosts that its pages link to, and between a
host and its parent domain where both have pages. Personalised PageRank carries trust along the edges from the
trusted seeds, and distrust against them from the blocked ones, step by step until what is still on its way is less
than TOLERANCE of each. A url that no rule fits gets its host's verdict:
block where distrust is more than THRESHOLD of trust and distrust together, else allow.

Cases: a null url, or one without ``://``, has an empty host and path; it fits no rule, is in no graph and is
allowed. A null html has no links. Rows without page_id and repeated rows are judged like others. Dangling hosts
send what they have back to the seeds, which scales all scores alike. An empty table gives no rows, and without seeds of a kind there is none of
it. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The share of a host's pages that makes it a seed, the share of distrust above which it is blocked.
SEED, THRESHOLD = 0.5, 0.5
DAMPING, TOLERANCE = 0.85, 1e-3

Rule = tuple[str, str, str]  # block or allow, host, path with its first /


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null; of equally long ones, the first in order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def edges(pages: DataFrame) -> DataFrame:
    """Distinct (source, target) hosts of (host, html): links to other hosts, and subdomains with their parents."""
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1)), lambda x: parts(F.concat(F.lit("x:"), F.regexp_replace(x, "^[^/]*", "")))[0]))
    linked = pages.filter("host <> ''").select(F.col("host").alias("source"), F.explode(links).alias("target")).distinct()
    hosts = pages.filter("host <> ''").select("host").distinct()
    near = hosts.select(F.col("host").alias("source"), F.regexp_replace("host", r"^[^.]*\.", "").alias("target"))
    near = near.join(hosts.select(F.col("host").alias("target")), "target", "left_semi").select("source", "target")
    both = near.union(near.select("target", "source"))
    return linked.union(both).filter("source <> target AND target <> ''").distinct()


def propagate(seeds: DataFrame, graph: DataFrame) -> DataFrame:
    """(kind, host, score) by personalised PageRank from seeds (kind, host, weight) over graph (kind, source, target).

    What starts at the seeds moves on along the links, DAMPING of it in each step; a host's score is the sum of all that
    came by, and is scaled to a sum of 1 for each kind. A step handles only what is still on its way.
    """
    total = lambda rows, value: rows.groupBy("kind").agg(F.sum(value).alias("total"))  # noqa: E731  two rows: one for each kind
    scaled = lambda rows, value: rows.join(F.broadcast(total(rows, value)), "kind").withColumn(value, F.col(value) / F.col("total")).drop("total")
    moving = written(scaled(seeds, "weight").withColumnRenamed("weight", "score"), "seeds", free=False)
    degree = graph.groupBy("kind", "source").agg(F.count(F.lit(1)).alias("degree"))
    shares = written(graph.join(degree, ["kind", "source"]).select("kind", F.col("source").alias("host"), "target", (DAMPING / F.col("degree")).alias("share")), "shares")
    passed = moving
    while any(r["total"] > TOLERANCE for r in total(moving, "score").collect()):
        sent = moving.join(shares, ["kind", "host"])
        moving = written(sent.groupBy("kind", F.col("target").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("score")), "scores", free=False)
        passed = passed.unionByName(moving)
    return scaled(passed.groupBy("kind", "host").agg(F.sum("score").alias("score")), "score")


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust for every row of (page_id, url, html)."""
    host, path = parts(F.col("url"))
    ruled = pages.select("page_id", "html", host.alias("host"), path.alias("path")).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    counts = ruled.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_rule")["verdict"] == v).alias(v) for v in ("allow", "block")])
    counts = written(counts, "hosts")
    seed = lambda v: counts.filter(F.col(v) >= SEED * F.col("n")).filter(F.col(v) > 0).select(F.lit(v).alias("kind"), "host", F.col(v).cast("double").alias("weight"))
    links = written(edges(ruled), "links")
    graph = links.select(F.lit("allow").alias("kind"), "source", "target").union(links.select(F.lit("block").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target")))
    score = propagate(seed("allow").union(seed("block")), graph).groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(c) for k, c in (("allow", "trust"), ("block", "distrust"))])
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(distrust > THRESHOLD * (trust + distrust), "block").otherwise("allow")
    verdict = F.coalesce(F.col("_rule")["verdict"], by_host)
    return ruled.drop("html").join(score, "host", "left").select("page_id", "host", "path", F.col("_rule")["rule"].alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
