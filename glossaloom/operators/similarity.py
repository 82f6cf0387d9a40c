"""Which names resemble each other: candidate pairs and cliques without comparing all pairs.

Every relation is reached by an equi-join whose one side is unique per name, or by what two similar strings have in common
once each has lost a few letters, so no group of names that grows with the data is multiplied with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.functions import text as X

_EPS = 1e-9


def _budget(length: Column, threshold: float) -> Column:
    """Edits allowed when the longer string has ``length`` characters."""
    return F.floor(length * threshold + _EPS).cast("int")


#: Budgets up to this are met by deleting letters from the whole name; beyond it names are cut into parts.
WHOLE = 2


def _shorter(s: Column) -> Column:
    """Every string that ``s`` becomes by losing one character."""
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, F.length(s))))


def _less(s: Column, most: Column) -> Column:
    """``s`` with up to ``most`` (0 to 2) characters deleted."""
    none = F.array().cast("array<string>")
    once = F.when((most >= 1) & (F.length(s) >= 1), _shorter(s)).otherwise(none)
    twice = F.when((most >= 2) & (F.length(s) >= 2), F.flatten(F.transform(_shorter(s), _shorter))).otherwise(none)
    return F.array_distinct(F.concat(F.array(s), once, twice))


def _part(length: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Start and size of part ``i`` when ``length`` characters are cut into even ``parts``."""
    base = F.floor(length / parts).cast("int")
    short = parts - (length - base * parts)
    start = F.when(i < short, i * base).otherwise(short * base + (i - short) * (base + 1))
    return start, F.when(i < short, base).otherwise(base + 1)


def _parts(d: Column) -> Column:
    """So many parts that d edits leave one of them with at most one."""
    return F.floor(d / 2).cast("int") + 1


def _one_listed(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str, only: DataFrame | None) -> DataFrame:
    """``a`` joined with ``b`` on ``keys``; with ``only(novel, name)`` just rows whose ``left`` or ``right`` is listed.

    Both sides are exploded names, which Spark takes for as small as the names themselves (and compressed well, for small
    after a shuffle too): without the hint it sends one of them through the driver as a broadcast.
    """
    b = b.hint("merge")
    if only is None:
        return a.join(b, keys)
    listed = lambda df, side: df.join(only.select("novel", F.col("name").alias(side)), ["novel", side], "left_semi")
    return listed(a, left).join(b, keys).unionByName(a.join(listed(b, right).hint("merge"), keys))


def edit_pairs(names: DataFrame, threshold: float, strict: bool = False, min_length: int = 1, only: DataFrame | None = None) -> DataFrame:
    """Pairs ``novel, lo, hi`` of ``names(novel, name)`` with edit distance / longer length <= threshold (at most 0.5).

    Names within d edits become equal when each loses d letters, so both list what is left of them and meet there.  From
    three edits on the shorter name is cut into d/2 + 1 parts, of which one must stand in the longer name, about at its
    place, with at most one edit; again both list what is left after one deletion.  What meets in a key differs from it by
    few letters, so no key grows with the vocabulary beyond what the alphabet allows.  ``strict`` makes the comparison ``<``;
    ``only(novel, name)`` asks just for pairs of which one name is listed.
    """
    base = names.select("novel", "name", F.length("name").alias("n")).where(F.col("n") >= max(min_length, 1)).distinct()
    length, key = F.col("n"), ["novel", "l", "d", "i", "seg"]
    no_part = [F.lit(0).alias(c) for c in ("l", "d", "i")]

    # Budgets of all longer names that a name may be the shorter one of.
    budgets = F.array_distinct(
        F.transform(F.sequence(length, F.floor(length / (1.0 - threshold) + _EPS).cast("int")), lambda longest: _budget(longest, threshold))
    )
    able = base.withColumn("budgets", F.filter(budgets, lambda d: d >= 1)).where(F.size("budgets") > 0)
    whole = able.where(F.array_min("budgets") <= WHOLE).withColumn("most", F.least(F.array_max("budgets"), F.lit(WHOLE)))
    index = whole.select("novel", F.col("name").alias("short"), *no_part, F.explode(_less(F.col("name"), F.col("most"))).alias("seg"))
    parts = able.select("novel", "name", "n", F.explode(F.filter("budgets", lambda d: d > WHOLE)).alias("d")).withColumn("m", _parts(F.col("d")))
    parts = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
    start, size = _part(length, F.col("m"), F.col("i"))
    parts = parts.withColumns({"start": start, "size": size}).withColumn("part", F.substring("name", F.col("start") + 1, F.col("size")))
    index = index.unionByName(parts.select("novel", F.col("name").alias("short"), length.alias("l"), "d", "i", F.explode(_less(F.col("part"), F.lit(1))).alias("seg")))

    asking = base.withColumn("d", _budget(length, threshold)).where("d >= 1")
    near_whole = asking.where(F.col("d") <= WHOLE)
    probes = near_whole.select("novel", F.col("name").alias("long"), *no_part, F.explode(_less(F.col("name"), F.col("d"))).alias("seg"))
    places = asking.where(F.col("d") > WHOLE).withColumn("m", _parts(F.col("d")))
    places = places.select("*", F.explode(F.sequence(F.greatest(length - F.col("d"), F.lit(1)), length)).alias("l"))
    places = places.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
    start, size = _part(F.col("l"), F.col("m"), F.col("i"))
    places = places.withColumns({"start": start, "size": size}).select("*", F.explode(F.array(*[F.lit(x) for x in (-1, 0, 1)])).alias("more"))
    # A part shifted by s, and what lies behind it by the rest of the difference, cost so many edits at least.
    places = places.select("*", F.explode(F.sequence(-F.col("d"), F.col("d"))).alias("s"), (length - F.col("l")).alias("gap"))
    at, wide = F.col("start") + F.col("s"), F.col("size") + F.col("more")
    places = places.where((F.abs("s") + F.abs(F.col("gap") - F.col("s") - F.col("more")) + F.abs("more") <= F.col("d")) & (at >= 0) & (wide >= 0) & (at + wide <= length))
    places = places.withColumn("piece", F.substring("name", at + 1, wide))
    # A piece shorter than the part is what the part may be left with; of the others, one letter less.
    left = F.when(F.col("more") < 0, F.array("piece")).when(F.length("piece") >= 1, _shorter(F.col("piece")))
    probes = probes.unionByName(places.select("novel", F.col("name").alias("long"), "l", "d", "i", F.explode(left).alias("seg")))

    # The bounded distance gives up (-1) as soon as more edits are sure than the longer name may have.
    edits = F.call_function("levenshtein", F.col("short"), F.col("long"), _budget(F.length("long"), threshold))
    distance = edits / F.length("long")
    near = (edits >= 0) & (distance < threshold if strict else distance <= threshold)
    ordered = (F.length("short") < F.length("long")) | (F.col("short") < F.col("long"))
    return (
        _one_listed(index, probes, key, "short", "long", only)
        .where(ordered & near)
        .select("novel", F.least("short", "long").alias("lo"), F.greatest("short", "long").alias("hi"))
        .distinct()
    )


def substring_pairs(names: DataFrame, min_length: int = 4, only: DataFrame | None = None) -> DataFrame:
    """``novel, short, long``: names contained in longer names; with ``only(novel, name)`` pairs of which one is listed.

    The longer side lists its substrings and looks them up, so the work is linear in the names.
    """
    base = names.select("novel", "name").distinct()
    length = F.length("name")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(min_length), length - 1),
            lambda n: F.transform(F.sequence(F.lit(1), length - n + 1), lambda p: F.substring(F.col("name"), p, n)),
        )
    )
    longer = base.where(length > min_length).select(
        "novel", F.col("name").alias("long"), F.explode(F.array_distinct(inner)).alias("short")
    )
    shorter = base.where(length >= min_length).select("novel", F.col("name").alias("short"))
    found = _one_listed(shorter, longer, ["novel", "short"], "short", "long", only).select("novel", "short", "long")
    return found if only is None else found.distinct()


def shared_cliques(members: DataFrame) -> DataFrame:
    """Drop cliques of one from ``members(novel, name, clique)``."""
    sizes = members.groupBy("novel", "clique").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return members.join(sizes, ["novel", "clique"], "left_semi")
