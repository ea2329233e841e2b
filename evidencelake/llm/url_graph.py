"""URL verdicts: explicit rules, and for the rest trust and distrust propagated over the host link graph.

Trust is a personalised PageRank that starts from the hosts with allowed pages and follows links: a trusted host vouches for those it links to. Distrust
starts from the hosts with blocked pages and follows links backwards: who links to a blocked host is suspect. Both starts are spread by page counts. A host is
blocked when its distrust exceeds its trust and is at least ``threshold`` times its share of all pages.

All of it is DataFrame and SQL expressions over one row per host and one per pair of linked hosts; the text of a page is read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.line_dedup import ASCII_LOWER, ASCII_UPPER, host_of, path_of
from evidencelake.session import materialise

#: Hosts of absolute links.
LINK = r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'> ]+)"

#: Characters of the longest name a host can have.
LONGEST_HOST = 253

#: (verdict, rule): a rule is a host and the start of a path.
Rules = Sequence[tuple[str, str]]


def _longest_first(rules: Rules) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1]), r[1]))


def rule_of(host: Column, path: Column, rules: Rules) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path starts the url's; else null."""
    out = F.lit(None).cast("string")
    for _, rule in reversed(_longest_first(rules)):
        name, start = rule.split("/", 1)
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{start}"))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: Rules) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def ancestors_of(host: Column) -> Column:
    """The parent domains of a host that have a dot themselves. Numeric addresses, and names too long to be a host's, have none."""
    parts = F.split(host, r"\.")
    size = F.size(parts)
    named = (size > 2) & (F.length(host) <= LONGEST_HOST) & ~host.rlike(r"^[0-9.]+(:[0-9]*)?$")
    return F.when(named, F.transform(F.sequence(F.lit(2), size - 1), lambda i: F.array_join(F.slice(parts, i, size), "."))).otherwise(F.array().cast("array<string>"))


def host_edges(pages: DataFrame, site_weight: float = 1.0) -> DataFrame:
    """(src, dst, weight) between different hosts, from (host, links): pages of src that link to dst. A host and its parent host link to each other
    with ``site_weight``, so that the hosts of one site are connected; a parent with a dot in its name takes part whether it has pages or not, any other
    only if it has pages."""
    linked = pages.select("host", F.explode(F.array_distinct("links")).alias("dst")).filter("host <> '' and host <> dst")
    by_link = linked.groupBy(F.col("host").alias("src"), "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.select("host").filter("host <> ''").distinct()
    nodes = hosts.select(F.explode(F.concat(F.array("host"), ancestors_of(F.col("host")))).alias("host")).distinct()
    parent = F.regexp_extract("host", r"^[^.]*\.(.*)$", 1)
    pairs = nodes.withColumn("parent", parent).join(nodes.select(F.col("host").alias("parent")), "parent").filter("parent <> ''")
    both = F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")), F.struct(F.col("parent").alias("src"), F.col("host").alias("dst"))))
    by_site = pairs.select(both.alias("e")).select("e.src", "e.dst", F.lit(float(site_weight)).alias("weight"))
    return by_link.unionByName(by_site).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.6, rounds: int = 8) -> DataFrame:
    """(host, trust, distrust) by power iteration from (host, trust, distrust) shares; what reaches a host without links ends there.

    After ``rounds`` rounds at most ``damping ** rounds`` of either mass (under 2 % as set) has not found its place.
    """
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "weight")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), "weight")
    steps = forward.unionByName(backward)
    sums = steps.groupBy("kind", "at").agg(F.sum("weight").alias("whole"))
    steps = materialise(steps.join(sums, ["kind", "at"]).select("kind", "at", "to", (F.col("weight") / F.col("whole")).alias("share")), "steps")
    kinds = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("seed"))))
    seeds = materialise(seeds.select("host", kinds.alias("k")).select("k.kind", F.col("host").alias("at"), "k.seed").filter("seed > 0"), "seeds")
    mass = seeds.select("kind", "at", F.col("seed").alias("mass"))
    for _ in range(rounds):
        moved = mass.join(steps, ["kind", "at"]).select("kind", F.col("to").alias("at"), (F.col("mass") * F.col("share") * damping).alias("mass"))
        mass = materialise(seeds.select("kind", "at", (F.col("seed") * (1 - damping)).alias("mass")).unionByName(moved).groupBy("kind", "at").agg(F.sum("mass").alias("mass")), "mass")
    by_kind = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0)).alias(k)
    return mass.groupBy(F.col("at").alias("host")).agg(by_kind("trust"), by_kind("distrust"))


def judge_urls(
    pages: DataFrame, rules: Rules, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", threshold: float = 1.0, damping: float = 0.6, rounds: int = 8, site_weight: float = 1.0
) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), verdict (allow or block), trust and distrust (its host's).

    Null urls and those without ``://`` have an empty host and path; they are in no graph and allowed unless a rule fits. Null or link-less pages add no edges. Hosts that
    neither mass reaches are allowed. Repeated rows count as pages of their own. Other columns are ignored. Without allowed or blocked pages that mass is zero everywhere.
    """
    url, html = F.col(url_column), F.coalesce(F.col(html_column), F.lit(""))
    own = pages.select(F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda h: F.translate(h, ASCII_UPPER, ASCII_LOWER)).alias("links"))
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    own = materialise(own.withColumn("ruled", verdict_of(F.col("rule"), rules)), "urls")
    counts = own.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    counts = materialise(counts, "hosts")
    whole = counts.agg(F.sum("pages").alias("pages"), F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    seeds = counts.select("host", (F.col("allowed") / F.lit(float(whole.allowed or 1))).alias("trust"), (F.col("blocked") / F.lit(float(whole.blocked or 1))).alias("distrust"))
    scores = propagate(seeds, host_edges(own, site_weight), damping, rounds).join(counts.select("host", "pages"), "host")
    scores = materialise(scores.withColumn("bad", (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * F.col("pages") / F.lit(float(whole.pages or 1)))).drop("pages"), "scores")
    judged = own.drop("links").join(scores, "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
