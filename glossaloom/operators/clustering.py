"""Greedy leader clustering, component by component.

Scanning names in order, a name not yet taken becomes a leader and takes every later related name.  A scan never crosses from
one connected component of the relation to another, so components are found first and each is scanned by itself in a task.
Only a component too large for a task is decided by rounds of joins, until the links that are still open fit a task.

Relations come as ``pairs(novel, lo, hi)`` and as ``cliques(novel, name, clique)`` whose members are all related to each other;
a clique costs one row per member however large it is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaloom.plans.components import components
from glossaloom.plans.lineage import cut

#: Links (pairs and clique memberships) of a component that one task scans; it holds some 200 bytes a link.
TASK_LINKS = 2_000_000


def leader_clusters(names: DataFrame, pairs: DataFrame, cliques: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``novel, name, leader`` for every name; a leader leads itself.

    A name belongs to its smallest related leader below it, and is a leader when it has none.
    """
    return leaders_and_components(names, pairs, cliques, task_links).drop("component")


def leaders_and_components(names: DataFrame, pairs: DataFrame, cliques: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """As ``leader_clusters``, with ``component``, the first name of all that links lead to."""
    keys = ["novel", "name"]
    links = cut(_links(pairs, cliques).distinct())
    if links.count() <= task_links:
        # No component can be too large for a task: a novel is scanned as a whole.
        found = cut(links.groupBy("novel").applyInPandas(_scan, _FOUND))
    else:
        vertex = lambda grouped, value: F.struct("novel", grouped.alias("grouped"), value.alias("value"))
        edges = links.select(vertex(F.lit(False), F.col("name")).alias("a"), vertex(F.col("grouped"), F.col("other")).alias("b"))
        # Names sort before cliques, so the least vertex of a component is its first name.
        of = cut(components(edges).where("not node.grouped").select("node.novel", F.col("node.value").alias("name"), F.col("component.value").alias("component")))
        linked = cut(links.join(of, keys))
        part = ["novel", "component"]
        large = cut(linked.groupBy(*part).agg(F.count("*").alias("n")).where(F.col("n") > task_links).select(*part))
        found = cut(linked.join(large, part, "left_anti").groupBy(*part).applyInPandas(_scan, _FOUND))
        if not large.isEmpty():
            rest = linked.join(large, part, "left_semi")
            decided = _by_rounds(
                rest.where("not grouped").select("novel", F.col("name").alias("lo"), F.col("other").alias("hi")),
                rest.where("grouped").select("novel", "name", F.col("other").alias("clique")),
                task_links,
            )
            found = found.unionByName(decided.join(of, keys))
    lonely = names.select(*keys).distinct().join(found, keys, "left_anti").withColumns({"leader": F.col("name"), "component": F.col("name")})
    return found.unionByName(lonely)


def _links(pairs: DataFrame, cliques: DataFrame) -> DataFrame:
    """One shape for both relations: a name linked to a name or to a clique."""
    return pairs.select("novel", F.col("lo").alias("name"), F.lit(False).alias("grouped"), F.col("hi").alias("other")).unionByName(
        cliques.select("novel", "name", F.lit(True).alias("grouped"), F.col("clique").alias("other"))
    )


_FOUND = "novel string, name string, leader string, component string"


def _scan(links: pd.DataFrame) -> pd.DataFrame:
    """The scan over whole components, names and cliques as numbers; every link is looked at once, as a clique has at most one
    leader that takes from it."""
    grouped = links["grouped"].to_numpy(bool)
    codes, names = pd.factorize(pd.concat([links["name"], links["other"][~grouped]], ignore_index=True))
    # In the order in which Spark sorts strings: by their UTF-8 bytes, which is the order of code points.
    order = np.argsort(names.to_numpy(object), kind="stable")
    names, place = names.to_numpy(object)[order], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[codes]
    own, others = codes[: len(links)], codes[len(links) :]
    cliques, kinds = pd.factorize(links["other"][grouped])
    later, later_from = _listed(own[~grouped], others, len(names))
    groups, groups_from = _listed(own[grouped], cliques, len(names))
    members, members_from = _listed(cliques, own[grouped], len(kinds))
    leader, taken = np.full(len(names), -1), np.zeros(len(kinds), bool)
    for name in range(len(names)):
        if leader[name] >= 0:
            continue
        leader[name] = name
        reach = [later[later_from[name] : later_from[name + 1]]]
        for group in groups[groups_from[name] : groups_from[name + 1]]:
            if not taken[group]:
                taken[group] = True
                reach.append(members[members_from[group] : members_from[group + 1]])
        for met in reach:
            met = met[(met > name) & (leader[met] < 0)]
            leader[met] = name
    parts = names[_least_linked(len(names), len(kinds), own[~grouped], others, own[grouped], cliques)]
    return pd.DataFrame({"novel": links["novel"].iloc[0], "name": names, "leader": names[leader], "component": parts})


def _listed(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``values`` by key, and the place where the values of each key begin."""
    return values[np.argsort(keys, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))])


def _least_linked(n: int, n_cliques: int, lo: np.ndarray, hi: np.ndarray, member: np.ndarray, clique: np.ndarray) -> np.ndarray:
    """The least name linked to each of ``n`` names; a clique links its members to the first of them."""
    first = np.full(n_cliques, n)
    np.minimum.at(first, clique, member)
    a, b = np.concatenate([lo, first[clique]]), np.concatenate([hi, member])
    least = np.arange(n)
    while len(a):
        # Both ends get the lesser label, then each label that of its own name until none changes.
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (above := least[least]).tobytes() != least.tobytes():
            least = above
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    return least


def _by_rounds(pairs: DataFrame, cliques: DataFrame, task_links: int) -> DataFrame:
    """The same outcome by joins: each round decides every name whose smaller neighbours allow it, at least the smallest.

    Links to decided names and from followers are dropped after a round; once the rest fits a task, it is scanned: a leader
    of an earlier round has no link from below left, so it leads there too.
    """
    keys = ["novel", "name"]
    pairs, cliques = cut(pairs), cut(cliques)
    linked = (
        cliques.select(*keys)
        .unionByName(pairs.select("novel", F.col("lo").alias("name")))
        .unionByName(pairs.select("novel", F.col("hi").alias("name")))
        .distinct()
    )
    # leader: null while undecided.
    state = cut(linked.withColumn("leader", F.lit(None).cast("string")))

    while True:
        open_name = F.when(F.col("leader").isNull(), F.col("name"))
        lead_name = F.when(F.col("leader") == F.col("name"), F.col("name"))
        active = state.where(F.col("leader").isNull() | (F.col("leader") == F.col("name")))
        undecided = state.where(F.col("leader").isNull()).select(*keys)

        by_clique = (
            cliques.join(active, keys)
            .groupBy("novel", "clique")
            .agg(F.min(open_name).alias("first_open"), F.min(lead_name).alias("lead"))
        )
        from_cliques = (
            cliques.join(undecided, keys, "left_semi")
            .join(by_clique, ["novel", "clique"])
            .select(
                *keys,
                F.when(F.col("first_open") < F.col("name"), F.col("first_open")).alias("first_open"),
                F.when(F.col("lead") < F.col("name"), F.col("lead")).alias("lead"),
            )
        )
        from_pairs = pairs.join(active.withColumnRenamed("name", "lo"), ["novel", "lo"]).select(
            "novel",
            F.col("hi").alias("name"),
            F.when(F.col("leader").isNull(), F.col("lo")).alias("first_open"),
            F.when(F.col("leader").isNotNull(), F.col("lo")).alias("lead"),
        )
        news = (
            from_cliques.unionByName(from_pairs)
            .groupBy(*keys)
            .agg(F.min("first_open").alias("first_open"), F.min("lead").alias("lead"))
        )
        decided = (
            F.when(
                F.col("lead").isNotNull() & (F.col("first_open").isNull() | (F.col("lead") < F.col("first_open"))),
                F.col("lead"),
            ).when(F.col("lead").isNull() & F.col("first_open").isNull(), F.col("name"))
        )
        state = cut(
            state.join(news, keys, "left").select(*keys, F.coalesce("leader", decided).alias("leader"))
        )
        undecided = state.where(F.col("leader").isNull()).select(*keys)
        if undecided.isEmpty():
            return state
        active = state.where(F.col("leader").isNull() | (F.col("leader") == F.col("name"))).select(*keys)
        pairs = pairs.join(undecided.withColumnRenamed("name", "hi"), ["novel", "hi"], "left_semi")
        pairs = cut(pairs.join(active.withColumnRenamed("name", "lo"), ["novel", "lo"], "left_semi"))
        cliques = cut(cliques.join(active, keys, "left_semi"))
        if pairs.count() + cliques.count() <= task_links:
            rest = _links(pairs, cliques).groupBy("novel").applyInPandas(_scan, _FOUND).select(*keys, F.col("leader").alias("_rest"))
            # Who has no link left is led by none.
            return state.join(rest, keys, "left").select(*keys, F.coalesce("leader", "_rest", "name").alias("leader"))
