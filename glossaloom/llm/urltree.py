"""URL filter: explicit rules first, else a tree of path templates per host, judged by the labels of its pages.

At each node of a host's tree the segments that follow are counted.  A segment with a large enough share of the node's pages
stays as it is; all others are variable and become a wildcard of their kind (digits, letters or both, before any extension).
Branches whose labelled shares differ by less than a Hoeffding bound are merged and go on as one node.  A page is blocked if
the smoothed share of good labels at its template is too small.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.llm.batches import written

ALLOW, BLOCK = "allow", "block"
#: What a template is told by: names of kept segments begin with "=", wildcards with "*"; a path that ends is "$".
KEPT, END = "=", "$"


@dataclass(frozen=True)
class TreeRules:
    """``levels``: segments that are told apart, deeper ones share the template.  A segment is kept if it has ``least_rows``
    pages and ``least_share`` of its node's, so a node has at most 1 / least_share kept branches whatever its size.
    ``risk``: chance at which the bound calls equal branches different.  ``strength``: labels that the parent's purity counts
    for.  ``least_purity``: below it a template is blocked; ``prior``: purity without any label."""

    levels: int = 8
    least_rows: int = 5
    least_share: float = 0.02
    risk: float = 0.05
    strength: float = 10.0
    least_purity: float = 0.5
    prior: float = 0.8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z lower-cased; empty for null or no ://."""
    host = F.regexp_extract(url, r"\A(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (rule, verdict) that fits, else nulls; rules are a short list of settings.

    A rule ``net/es/`` fits the host net and its subdomains where the path starts with /es/.  Of equal length, block wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, told in sorted(set(rules), key=lambda r: (len(r[0]), r[1] == BLOCK, r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, told).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", bad_col: str = "bad", settings: TreeRules = TreeRules()) -> DataFrame:
    """(id, host, path, rule, template, purity, verdict) for every row of ``pages`` (id, url, bad).

    ``bad``: true or false where a page is labelled, else null.  The tree counts all pages, those under a rule too.  Pages
    without a host share one tree.  Repeated rows count again; an empty table gives an empty table.
    """
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(bad_col).cast("boolean").alias("bad"))
    rows = written(rows, "urls")
    tree = fit(rows, settings)
    # Equal paths take one way through the tree; only they are joined back to the pages.
    ways = rows.select("host", "path").distinct()
    ways = place(ways, tree, settings)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    told = rows.join(ways, ["host", "path"]).withColumns({"rule": rule, "told": verdict})
    tree_verdict = F.when(F.col("purity") < settings.least_purity, BLOCK).otherwise(ALLOW)
    return told.select(id_col, "host", "path", "rule", "template", "purity", F.coalesce("told", tree_verdict).alias("verdict"))


def _segments(path: Column, settings: TreeRules) -> Column:
    return F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, settings.levels)


def _with_segment(rows: DataFrame, level: int) -> DataFrame:
    """Columns segment (null: the path has ended) and kind (the wildcard's name, or the end's at the place where it ends)."""
    name = F.regexp_replace(F.get("segments", F.lit(level)), r"\.[A-Za-z0-9]{1,5}\z", "")
    kind = F.when(F.regexp_like(name, F.lit(r"\A[0-9]+\z")), "*digits").when(F.regexp_like(name, F.lit("[0-9]")), "*mixed").otherwise("*letters")
    rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
    return rows.withColumn("kind", F.when(F.col("segment").isNotNull(), kind).when(F.size("segments") == level, END))


def fit(rows: DataFrame, settings: TreeRules = TreeRules()) -> list[DataFrame]:
    """The tree of ``rows`` (host, path, bad): for each level (host, node, branches: map of name to (branch, purity)).

    All rows of a host's level are added up by segment before anything else, so a hot host costs one row per segment and task.
    """
    counted = F.count("*").alias("n"), F.count("bad").alias("labels"), F.count(F.when(F.col("bad"), 1)).alias("bads")
    paths = rows.groupBy("host", "path").agg(*counted).withColumn("segments", _segments(F.col("path"), settings))
    summed = [F.sum(c).alias(c) for c in ("n", "labels", "bads")]
    paths = paths.groupBy("host", "segments").agg(*summed)
    hosts = paths.groupBy("host").agg(*summed).select("host", _purity(F.lit(settings.prior), settings).alias("purity"))
    paths = written(paths.join(hosts, "host").withColumn("node", F.lit("")), "paths")
    tree: list[DataFrame] = []
    for level in range(settings.levels):
        going = _with_segment(paths, level)
        if not going.limit(1).count():
            break
        tree.append(written(_branches(going, settings), "branches"))
        if level + 1 < settings.levels:
            paths = written(_step(going.where("segment is not null"), tree[-1]).select("host", "segments", "n", "labels", "bads", "node", "purity"), "paths")
    return [written(hosts, "hosts"), *tree]


def _purity(above: Column, settings: TreeRules) -> Column:
    return (F.col("labels") - F.col("bads") + settings.strength * above) / (F.col("labels") + settings.strength)


def _branches(rows: DataFrame, settings: TreeRules) -> DataFrame:
    """(host, node, branches) of one level's rows (host, node, purity, segment, kind, n, labels, bads)."""
    node = ["host", "node"]
    summed = [F.sum(c).alias(c) for c in ("n", "labels", "bads")]
    segments = rows.groupBy(*node, "segment", "kind").agg(*summed, F.first("purity").alias("above"))
    whole = segments.groupBy(*node).agg(F.sum("n").alias("whole"))
    kept = F.col("segment").isNotNull() & (F.col("n") >= settings.least_rows) & (F.col("n") >= settings.least_share * F.col("whole"))
    named = segments.join(whole, node).withColumn("name", F.when(kept, F.concat(F.lit(KEPT), "segment")).otherwise(F.col("kind")))
    names = named.groupBy(*node, "name").agg(*summed, F.first("above").alias("above")).withColumn("purity", _purity(F.col("above"), settings))
    # The end of a path stands alone; the others, of which a node has few, are merged in order of their purity.
    rank = F.struct("purity", "name", "labels", "bads")
    gathered = names.groupBy(*node).agg(F.sort_array(F.collect_list(F.when(F.col("name") != END, rank))).alias("ranks"))
    merged = gathered.select(*node, F.explode(F.arrays_zip(F.col("ranks.name").alias("name"), _clusters(F.col("ranks"), settings).alias("cluster"))).alias("of"))
    merged = merged.select(*node, "of.*").unionByName(names.where(F.col("name") == END).select(*node, "name", F.lit(-1).alias("cluster")))
    merged = merged.join(names, [*node, "name"]).groupBy(*node, "cluster").agg(
        F.min("name").alias("branch"), F.collect_list("name").alias("names"), *summed, F.first("above").alias("above")
    )
    merged = merged.withColumn("branch", F.struct("branch", _purity(F.col("above"), settings).alias("purity"))).select(*node, F.explode("names").alias("name"), "branch")
    return merged.groupBy(*node).agg(F.map_from_entries(F.collect_list(F.struct("name", "branch"))).alias("branches"))


def _clusters(ranks: Column, settings: TreeRules) -> Column:
    """The cluster of each of ``ranks`` (labels, bads) in turn: the next one is new if its share of bad labels differs from
    that of the cluster before by the sum of both Hoeffding bounds; branches without labels differ from none."""
    bound = math.sqrt(0.5 * math.log(2 / settings.risk))

    def step(state: Column, x: Column) -> Column:
        far = F.abs(state["bads"] / state["labels"] - x["bads"] / x["labels"]) > F.lit(bound) * (1 / F.sqrt(state["labels"]) + 1 / F.sqrt(x["labels"]))
        new = F.when((state["labels"] == 0) | (x["labels"] == 0), False).otherwise(far)
        labels = F.when(new, x["labels"]).otherwise(state["labels"] + x["labels"])
        bads = F.when(new, x["bads"]).otherwise(state["bads"] + x["bads"])
        at = state["at"] + F.when(new, 1).otherwise(0)
        return F.struct(labels.alias("labels"), bads.alias("bads"), at.alias("at"), F.concat(state["all"], F.array(at)).alias("all"))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("labels"), zero.alias("bads"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(ranks, start, step, lambda state: state["all"])


def _step(rows: DataFrame, level: DataFrame) -> DataFrame:
    """``rows`` (host, node, purity, segment, kind) one level down; a row whose branch the tree lacks stays where it is."""
    met = rows.join(level, ["host", "node"], "left")
    branch = F.coalesce(F.try_element_at("branches", F.concat(F.lit(KEPT), "segment")), F.try_element_at("branches", "kind"))
    met = met.withColumn("branch", branch).drop("branches")
    return met.withColumns({
        "node": F.when(F.col("branch").isNotNull(), F.concat("node", F.lit("/"), "branch.branch")).otherwise(F.col("node")),
        "purity": F.coalesce("branch.purity", "purity"),
    })


def place(paths: DataFrame, tree: list[DataFrame], settings: TreeRules = TreeRules()) -> DataFrame:
    """(host, path, template, purity) for ``paths`` (host, path): the template that each falls under; a host that the tree does
    not know has the prior's purity."""
    hosts, *levels = tree
    rows = paths.select("host", "path", _segments(F.col("path"), settings).alias("segments"), F.lit("").alias("node"))
    rows = rows.join(hosts, "host", "left").withColumn("purity", F.coalesce("purity", F.lit(settings.prior)))
    for level, branches in enumerate(levels):
        rows = _step(_with_segment(rows, level), branches).select("host", "path", "segments", "node", "purity")
    return rows.select("host", "path", F.col("node").alias("template"), "purity")
