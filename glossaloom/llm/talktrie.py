"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations become one weighted sequence with a list of the conversations that end there.  Sequences that are a
proper prefix of another are found by anti-join; the rest are the leaves.  Prefixes of the distinct sequences are then
aggregated with their weights.  A prefix is known by the running sum of hashes of (place, role, text), so a conversation is
never gathered into a row, and a sum over a subtree is a sum of suffix sums, each node being owned by one sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossaloom.llm.batches import hash_class, written
from glossaloom.plans.ordered import ranked

#: Places of a conversation that one window adds up; longer conversations are carried from span to span.
SPAN = 1 << 12
#: Neighbouring ids that share a block of an end list, as a power of two.
BLOCK_BITS = 10
#: Most turns that a conversation can take over from the head of its group.
LENT, HEADS = 9, 5
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, digest, bytes): the turns of every conversation, numbered from 0 in their order.

    Order: turn, null first; turns of one number stand by role, then by the SHA-256 of their text.  A null role or text is
    empty.  Rows without a conv_id belong to no conversation.  Texts are replaced by their digest, so they are not shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return ranked(turns, "conv_id", order, "place").select("conv_id", (F.col("place") - 1).alias("place"), "role", "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start as the head of their group of five does: (turns, conversations with their length).

    The first h turns of c are those of c - c % 5 (all if there are fewer, none if it is absent), h being crc32 of c in
    decimals modulo 9; then come c's own turns from the h-th on.  % keeps the sign of c.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    plan = sizes.select("conv_id", "size", hash_class("conv_id", LENT).alias("h"), (F.col("conv_id") - F.col("conv_id") % HEADS).alias("head"))
    heads = sizes.select(F.col("conv_id").alias("head"), F.col("size").alias("head_size"))
    plan = plan.join(heads, "head", "left").withColumn("lent", F.least("h", F.coalesce("head_size", F.lit(0))))
    plan = plan.select("conv_id", "head", "h", "lent", (F.col("lent") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length"))
    plan = written(plan, "rebuilding")
    fields = ["role", "digest", "bytes"]
    own = turns.join(plan, "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), *fields)
    lent = turns.where(F.col("place") < LENT).withColumnRenamed("conv_id", "head").join(plan, "head").where("place < h")
    return own.unionByName(lent.select("conv_id", "place", *fields)), plan.select("conv_id", "length")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (turns, conversations with their length)."""
    return turns, turns.groupBy("conv_id").agg(F.count("*").alias("length"))


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns, from the root (no turn) down.

    ``turns``: conv_id, place (from 0, without gaps), role, digest, bytes.  ``lengths``: conv_id, length (0: no turn).
    Returns conv_id (the smallest member), depth, parent_conv_id, role and text_sha256 of the last turn (null for the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  Without conversations there is no node, not even the root.
    """
    prefixes = written(_prefixes(written(turns, "turns")), "prefixes")
    ends = prefixes.join(lengths, "conv_id").where("depth = length").select("conv_id", "key", "length")
    ends = ends.unionByName(lengths.where("length = 0").select("conv_id", _root().alias("key"), "length"))
    ends = written(ends, "ends")
    sequences = ends.groupBy("key").agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"), F.first("length").alias("length"))

    # From here on only one conversation of each distinct sequence is looked at, with the weight of all.
    kept = prefixes.join(sequences.select("conv_id", "weight", "length"), "conv_id")
    top = sequences.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), _root().alias("key"), F.lit(None).cast(prefixes.schema["parent"].dataType).alias("parent"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"), "weight", "length",
    )
    kept = written(kept.unionByName(top), "sequences")
    nodes = kept.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"),
        *[F.first(c).alias(c) for c in ("depth", "parent", "role", "digest", "bytes")],
    )
    nodes = written(nodes, "nodes")
    inner = kept.where("depth < length").select("key").distinct()
    leaves = sequences.join(inner, "key", "left_anti").select("conv_id", F.lit(1).alias("leaf"))

    # The smallest member owns a node, so (conv_id, depth) names it and no join meets a common prefix.
    owned = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    below = kept.join(owned, ["conv_id", "depth"], "left").join(leaves, "conv_id", "left")
    below = below.select("conv_id", "key", (F.col("length") - F.col("depth")).alias("up"), F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    below = running(written(below, "owned"), "conv_id", "up", ["saved"])
    below = below.groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").cast("long").alias("n_leaves"))

    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    made = nodes.join(below, "key").join(children, "key", "left").join(_end_lists(ends), "key", "left").join(above, "parent", "left")
    return made.select(
        "conv_id", "depth", "parent_conv_id", "role", F.lower(F.hex("digest")).alias("text_sha256"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def running(df: DataFrame, group: str, place: str, values: list[str]) -> DataFrame:
    """``df`` with each of ``values`` added up over the rows of ``group`` at places up to the row's own (from 0, no ties)."""
    df = df.withColumn("_span", F.floor(F.col(place) / SPAN))
    spans = df.groupBy(group, "_span").agg(*[F.sum(v).alias(v) for v in values])
    before = W.partitionBy(group).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.select(group, "_span", *[F.sum(v).over(before).alias(f"_{v}") for v in values]).where("_span > 0")
    inside = W.partitionBy(group, "_span").orderBy(place).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = df.withColumns({v: F.sum(v).over(inside) for v in values}).join(carried, [group, "_span"], "left")
    return summed.withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop("_span", *[f"_{v}" for v in values])


def _key(sums: list[Column]) -> Column:
    """128 bits for four sums of 32-bit hashes."""
    return F.struct(F.xxhash64(*sums).alias("a"), F.xxhash64(F.lit("b"), *reversed(sums)).alias("b"))


def _root() -> Column:
    return _key([F.lit(0).cast("long")] * 4)


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, role, digest, bytes): the prefix that ends at each turn and the prefix before it."""
    one, two = F.xxhash64("place", "role", "digest"), F.xxhash64(F.lit("two"), "digest", "role", "place")
    halves = {"h0": one.bitwiseAND(0xFFFFFFFF), "h1": F.shiftrightunsigned(one, 32), "h2": two.bitwiseAND(0xFFFFFFFF), "h3": F.shiftrightunsigned(two, 32)}
    hashed = turns.withColumns(halves).withColumns({f"s{i}": F.col(f"h{i}") for i in range(4)})
    summed = running(hashed, "conv_id", "place", [f"s{i}" for i in range(4)])
    return summed.select(
        "conv_id", (F.col("place") + 1).alias("depth"), _key([F.col(f"s{i}") for i in range(4)]).alias("key"),
        _key([F.col(f"s{i}") - F.col(f"h{i}") for i in range(4)]).alias("parent"), "role", "digest", "bytes",
    )


def _end_lists(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of the ascending ids of the conversations that end at a node.

    Ids are joined in blocks of at most 1,024 neighbours; the blocks of a node run through one hash in order, which only ever
    holds one batch of them.
    """
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    blocks = ends.groupBy("key", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(ids, ",").alias("ids"))
    dealt = blocks.select("key.a", "key.b", "block", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "block")

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for a, b, ids in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ids").to_pylist()):
                if node != (a, b):
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield _batch(done)
                done = []
        if node:
            yield _batch([(*node, state.hexdigest())])

    made = dealt.mapInArrow(digests, "a long, b long, ends_sha256 string")
    return made.select(F.struct("a", "b").alias("key"), "ends_sha256")


def _batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest, pa.string())], ["a", "b", "ends_sha256"])
