"""Near duplicates by BagMinHash.

Texts are multisets of five-word shingles; two are near duplicates if their weighted Jaccard similarity is 0.8 or more.
Every shingle owns a Poisson process over (weight, time), built hierarchically over dyadic intervals of the discretised
weight axis; a text sees the points at weights up to the shingle's multiplicity.  Each point also falls to one component of
the signature, and the earliest point seen in a component is its value, so components of two texts agree with a probability
equal to their similarity.  A text needs its points up to the time at which every component has one, about
m log m in all however long it is.

Bands of the signature make buckets.  In a bucket, texts are compared with a leader; verified links are connected into
classes.  Those that stay outside the leader's class meet the others by what they changed against the leader: two similar
texts share rare changes, so versions of one text that changed different things are never paired.  Signatures of four bits a
component differ in few places if two texts are similar, which spares most of the remaining comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.llm.batches import slices, texts_of, written
from glossaloom.llm.links import components
from glossaloom.llm.shingles import mixed, numbered_copies, shingled, word_hashes, words_of

BANDS, ROWS = 50, 7
SIMILARITY = 0.8
#: Deviations above the mean number of differing components that a link may have: three in a million have more.
SPARE_DEVIATIONS = 4.5


def _points(shingles: np.ndarray, level: int, until: float, cover: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(times, identities) of the points of a dyadic weight interval before ``until``, for each shingle that reaches it.

    Level 0 is the weights (0, 1], level k is (2^(k-1), 2^k].  ``cover``: how many unit weights of the interval are seen, None
    for all; a point's place in the interval is given by its halvings, one bit each.
    """
    length = 1 if level == 0 else 1 << (level - 1)
    seeds = mixed(shingles ^ mixed(np.asarray([level + 1], np.uint64)))
    now, first = np.zeros(len(seeds)), 0
    width = int(until * length) + 1
    times, names = [], []
    while len(seeds):
        place = np.arange(first, first + width, dtype=np.uint64)
        drawn = mixed(seeds[:, None] + place[None, :] * np.uint64(0x9E3779B97F4A7C15))
        gaps = -np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        arrivals = now[:, None] + np.cumsum(gaps, axis=1)
        early = arrivals < until
        found, at = mixed(drawn[early] ^ np.uint64(0xD6E8FEB86659FD93)), arrivals[early]
        if cover is not None:
            cell = mixed(found) >> np.uint64(64 - (level - 1)) if level > 1 else np.zeros(len(found), np.uint64)
            seen = cell < np.broadcast_to(cover[:, None], early.shape)[early]
            found, at = found[seen], at[seen]
        times.append(at)
        names.append(found)
        going = early[:, -1]
        seeds, now, first = seeds[going], arrivals[going, -1], first + width
        cover = cover[going] if cover is not None else None
    return (np.concatenate(times), np.concatenate(names)) if times else (np.zeros(0), np.zeros(0, np.uint64))


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The BagMinHash signature of a non-empty multiset of shingles: the identity of the first point of each component."""
    kinds, weights = np.unique(shingles, return_counts=True)
    until = size / len(shingles) * (np.log(size) + 5)
    while True:
        times, names = [], []
        for level in range(int(weights.max() - 1).bit_length() + 1):
            low, high = (0, 1) if level == 0 else (1 << (level - 1), 1 << level)
            for chosen, cover in ((weights >= high, None), ((weights > low) & (weights < high), weights - low)):
                if chosen.any():
                    t, n = _points(kinds[chosen], level, until, None if cover is None else cover[chosen].astype(np.uint64))
                    times.append(t)
                    names.append(n)
        at, name = np.concatenate(times), np.concatenate(names)
        component = (name % np.uint64(size)).astype(np.int64)
        first = np.full(size, np.inf)
        np.minimum.at(first, component, at)
        if np.isfinite(first).all():
            wins = at == first[component]
            made = np.zeros(size, np.uint64)
            made[component[wins]] = name[wins]
            return made
        until *= 2


def band_keys(made: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    rows = made.reshape(bands, -1)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows.shape[1]):
        total = mixed(total ^ rows[:, i])
    return total.view(np.int64)


def short_signature(made: np.ndarray) -> np.ndarray:
    """Four bits of each component, 16 components in a 64-bit integer."""
    halves = np.zeros(-(-len(made) // 16) * 16, np.uint8)
    halves[: len(made)] = mixed(made) & np.uint64(15)
    return (halves[0::2] | halves[1::2] << 4).astype(np.uint8).view("<i8")


def _differing(a: str, b: str, components: int) -> Column:
    """In how many components two short signatures differ."""
    total = F.lit(0)
    for i in range(-(-components // 16)):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    return total


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, digest, key, size, bands, short): hash of the text, hash of its words, number of shingles, band keys, short
    signature; the last two and the hash of the words are null for texts without words."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = [words_of(t) for t in texts_of(batch, "text")]
            keys = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words]
            bags = [shingled(h) for h in word_hashes(words)]
            made = [signature(b, bands * rows) if len(b) else None for b in bags]
            told = [pa.array([None if m is None else f(m) for m in made], pa.list_(pa.int64())) for f in (lambda m: band_keys(m, bands), short_signature)]
            columns = [pa.array(keys, pa.binary()), pa.array([len(b) for b in bags], pa.int64()), *told]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("digest"), *columns], names=["id", "digest", "key", "size", "bands", "short"]
            )

    named = _texts(docs, id_col, text_col)
    kind = named.schema["id"].dataType.simpleString()
    return named.mapInArrow(apply, f"id {kind}, digest long, key binary, size long, bands array<long>, short array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, text): ids may be null or repeated, so a row is found again by its id and a hash of its text."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))


def _bags(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, bag): shingles of the wanted texts (id, digest, node, key), copies numbered."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = [words_of(t) for t in texts_of(batch, "text")]
            same = [xxhash.xxh3_128_digest(b" ".join(w)) == k for w, k in zip(words, batch.column("key").to_pylist())]
            bags = [numbered_copies(shingled(h)).view(np.int64) if ok else None for ok, h in zip(same, word_hashes(words))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bags, pa.list_(pa.int64()))], names=["node", "bag"])

    named = wanted.select(F.col("id").alias("wanted_id"), F.col("digest").alias("wanted_digest"), "node", "key")
    same = F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("digest") == F.col("wanted_digest"))
    texts = _texts(docs, id_col, text_col).join(named, same).select("node", "key", "text")
    return texts.mapInArrow(apply, "node long, bag array<long>").where("bag is not null").dropDuplicates(["node"])


def _similarities(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b, value): weighted Jaccard similarity of pairs (a, b)."""
    both = pairs.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b").join(
        bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a"
    )
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    return both.select("a", "b", (shared / (F.size("bag_a") + F.size("bag_b") - shared)).alias("value"))


def _sharing_changes(told: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: pairs of different components that may be similar, of which one lies outside the component of a common leader.

    ``told``: (leader, leader_size, node, size, value, component, main), a row for each leader and node that met it.  The changes
    of a text are the shingles that it or its leader holds alone.  Similar texts differ in at most ``apart`` x their sizes
    shingles, so of their changes they share at least half of what exceeds that, at least one if one of them is not similar to
    the leader.  In an order from the rarest change on, the first that they share leaves as many to come in both.
    """
    apart = (1 - similarity) / (1 + similarity)
    own, led = (bags.select(F.col("node").alias(n), F.col("bag").alias(f"{n}_bag")) for n in ("node", "leader"))
    changed = F.concat(F.array_except("node_bag", "leader_bag"), F.array_except("leader_bag", "node_bag"))
    changes = written(told.join(own, "node").join(led, "leader").select("leader", "node", changed.alias("changes")), "changes")
    each = changes.select("leader", "node", F.explode("changes").alias("change"))
    # a change that one text alone has comes first and meets nothing: only its place counts
    spread = each.groupBy("leader", "change").agg(F.count("*").alias("texts")).where("texts > 1")
    placed = each.join(spread, ["leader", "change"]).groupBy("leader", "node").agg(F.sort_array(F.collect_list(F.struct("texts", "change"))).alias("common"))
    placed = placed.join(changes.select("leader", "node", F.size("changes").alias("n")), ["leader", "node"]).join(told, ["leader", "node"])
    placed = placed.select("leader", "node", "size", "leader_size", "value", "component", "main", "n", F.posexplode("common").alias("at", "change"), (F.col("n") - F.size("common")).alias("alone"))
    placed = written(placed.select("*", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), F.col("change.change").alias("shared")).drop("at", "alone", "change"), "placed")
    held = ["node", "size", "value", "component", "n", "left"]
    named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in held]
    # a similar text has the other changes but for ``size`` x (1 / similarity - 1) at most
    outside = placed.where((F.col("component") != F.col("main")) & (F.col("left") >= F.col("n") - F.col("size") * (1 / similarity - 1) - 1e-6))
    every = placed.where(2 * F.col("left") >= F.col("n") + apart * (F.col("leader_size") - F.col("size")) - 1e-6)
    met = outside.select("leader", "shared", *named("x")).join(
        every.select("leader", "shared", *named("y"), (F.col("component") == F.col("main")).alias("inside")), ["leader", "shared"]
    ).where(
        (F.col("component_x") != F.col("component_y")) & (F.col("inside") | (F.col("node_x") < F.col("node_y")))
        & (F.least("size_x", "size_y") >= similarity * F.greatest("size_x", "size_y"))
        & F.coalesce(F.abs(F.col("value_x") - F.col("value_y")) <= 1 - similarity + 1e-9, F.lit(True))
        & (2 * F.least("left_x", "left_y") >= F.col("n_x") + F.col("n_y") - apart * (F.col("size_x") + F.col("size_y")) - 1e-6)
    )
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(id, class_id, n_shingles, kept) for every row: its class is named by the least id in it.

    Classes are the connected components of the links between texts of similarity ``similarity`` or more; at that similarity
    a link escapes the bands with a probability of (1 - s^rows)^bands, under 1 in 100,000 by default.  Texts equal in all
    words (ASCII case and white space apart) are one node throughout.  Texts of under five words are one shingle; null texts
    and texts without words are classes of their own (rows of one such id share its class), all kept.  A class in which every
    id is null has a null name.  ``kept`` marks the row with the least id of its class, a null id coming last; of several texts
    with that id, the one with the least hash of its words; repeated rows of that text are each marked.  Extra columns are
    ignored; an empty table gives no rows.

    The texts are read twice: for the sketches, and for the bags of texts that share a bucket with another text.
    """
    sketches = written(sketch(docs, id_col, text_col, bands, rows), "sketches")
    worded = sketches.where("key is not null")
    firsts = worded.groupBy("key").agg(F.min("id").alias("least"))
    nodes = written(
        worded.join(firsts.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")) & F.col("id").eqNullSafe(F.col("least")))
        .dropDuplicates(["key"]).select(F.monotonically_increasing_id().alias("node"), "key", "id", "digest", "size", "bands", "short"), "nodes",
    )
    slots = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    slots = written(slots.join(shared, "bucket"), "members")
    # texts in many full buckets lie in the middle of their group and lead
    weight = slots.groupBy("node").agg(F.sum("members").alias("weight"))
    near_nodes = written(nodes.join(weight, "node").select("node", "id", "digest", "key", "size", "short", "weight"), "near")
    bags = written(_bags(docs, near_nodes.select("id", "digest", "node", "key"), id_col, text_col), "bags")
    members = slots.select("bucket", "node").join(near_nodes.select("node", "size", "weight"), "node")
    leaders = members.groupBy("bucket").agg(F.max_by(F.struct("node", "size"), F.struct("weight", "node")).alias("leader"))
    led = written(members.join(leaders, "bucket").select("bucket", "node", "size", F.col("leader.node").alias("leader"), F.col("leader.size").alias("leader_size")), "led")
    close = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b)
    first = led.where((F.col("node") != F.col("leader")) & close("size", "leader_size")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    to_leader = written(_similarities(first, bags), "similar")
    links = to_leader.where(F.col("value") >= similarity).select("a", "b")
    label = written(components(links, near_nodes.select("node")), "components")

    # texts outside their leader's component, against the others that met the leader
    value = to_leader.select(F.col("a").alias("leader"), F.col("b").alias("node"), "value")
    told = led.where("node != leader").select("leader", "leader_size", "node", "size").distinct().join(value, ["leader", "node"], "left").join(label, "node")
    told = told.join(label.select(F.col("node").alias("leader"), F.col("component").alias("main")), "leader")
    told = told.join(told.where("component != main").select("leader").distinct(), "leader", "left_semi")
    met = _sharing_changes(written(told, "told"), bags, similarity)
    size = bands * rows
    odds = 15 / 16 * (1 - similarity)
    most = size * odds + SPARE_DEVIATIONS * (size * odds * (1 - odds)) ** 0.5
    for side in "ab":
        met = met.join(near_nodes.select(F.col("node").alias(side), F.col("short").alias(f"short_{side}")), side)
    rest = written(met.where(_differing("short_a", "short_b", size) <= most).select("a", "b"), "rest")
    more = written(_similarities(rest, bags), "similar").where(F.col("value") >= similarity).select("a", "b")
    if not more.isEmpty():
        label = components(links.unionByName(more), near_nodes.select("node"))
    placed = near_nodes.join(label, "node")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("first")
    least = placed.groupBy("component").agg(first)
    linked = placed.join(least, "component").select("key", F.col("first.id").alias("class_id"), F.col("first.key").alias("first_key"))
    alone = nodes.join(near_nodes.select("node"), "node", "left_anti").select("key", F.col("id").alias("class_id"), F.col("key").alias("first_key"))
    named = alone.unionByName(linked).withColumnRenamed("key", "named_key")
    out = sketches.select("id", "key", "size").join(named, F.col("key") == F.col("named_key"), "left")
    out = out.withColumn("class_id", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")))
    kept = F.col("id").eqNullSafe(F.col("class_id")) & F.col("key").eqNullSafe(F.col("first_key"))
    return out.select(F.col("id").alias(id_col), "class_id", F.col("size").alias("n_shingles"), kept.alias("kept"))
