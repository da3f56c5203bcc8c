"""Conversation prefix trie: all prefixes aggregated at once by ROLLUP (numbered operator 12)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagesieve.llm.util import WORD_CLASS
from pagesieve.operators.skew import skewable_join
from pagesieve.session import materialize

BLOCK = 8  # turns side by side in columns; later turns go on in a row keyed by the node reached
SHARED = 3  # a conversation shares at most so many turns with the first of its family
FAMILY = 20
CHUNK = 1 << 20  # bytes of joined ids that travel as one row
TURN = "struct<id binary, words bigint>"
# A node is its depth and two hashes of its path: the exclusive-or over its turns of hashes of (position, turn).
NODE = ["depth", "x1", "x2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t(id, words): turns in their order, nulls first; equal turn numbers are ordered by
    role, then by the turn's id. The text itself stays behind."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    id_ = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    words = F.regexp_count(text, F.lit(WORD_CLASS)).cast("bigint")
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.struct(id_.alias("id"), words.alias("words")).alias("t"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "t")
    return turns.select("conv_id", F.row_number().over(order).alias("pos"), "t")


def rebuild(turns: DataFrame, family: int = FAMILY) -> DataFrame:
    """Conversations opened anew: c takes over the first h turns of conversation c - c % family, then goes on
    with its own after its first h; h is the unsigned crc32 of c's decimal form, modulo SHARED + 1. Each
    conversation also has a row with pos 0 and no turn, so one left without turns is still there."""
    convs = turns.filter("pos = 1").select("conv_id").withColumn(
        "h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).cast("int"))
    slots = [F.max(F.when(F.col("pos") == i, F.col("t"))).alias(f"head{i}") for i in range(1, SHARED + 1)]
    heads = turns.filter((F.col("pos") <= SHARED) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("first")).agg(*slots)
    opened = convs.withColumn("first", F.col("conv_id") - F.col("conv_id") % family).join(heads, "first", "left")
    head = F.filter(F.slice(F.array(*[f"head{i}" for i in range(1, SHARED + 1)]), 1, F.col("h")), lambda t: t.isNotNull())
    opened = opened.select("conv_id", "h", F.when(F.col("h") > 0, head).otherwise(F.lit(None)).alias("head")).withColumn(
        "shared", F.coalesce(F.size("head"), F.lit(0))).withColumn("shared", F.greatest("shared", F.lit(0)))
    taken = opened.select("conv_id", F.posexplode_outer("head")).select(
        "conv_id", (F.col("pos") + 1).alias("pos"), F.col("col").alias("t")).filter(F.col("t").isNotNull())
    own = turns.join(opened.select("conv_id", "h", "shared"), "conv_id").filter(F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "t")
    none = convs.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast(TURN).alias("t"))
    return none.unionByName(taken).unionByName(own)


def _hash(side: int, pos: Column, t: Column) -> Column:
    return F.when(t.isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.lit(side), pos.cast("int"), t["id"]))


def blocks(turns: DataFrame, width: int) -> DataFrame:
    """conv_id, key(block, x1, x2), t1..t<width>, reach: the turns of a conversation in rows of `width`, each keyed
    by the node at which the row before ended. reach is the number of turns in the row, width + 1
    when the conversation goes on. x1, x2 are hashes of the whole conversation in its last row."""
    order = Window.partitionBy("conv_id").orderBy("pos")
    path = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select(
        "conv_id", "pos", "t", F.lead("pos").over(order).isNull().alias("last"),
        *[F.bit_xor(_hash(s, F.col("pos"), F.col("t"))).over(path).alias(f"x{s}") for s in (1, 2)])
    rows = rows.withColumn("block", F.floor((F.greatest("pos", F.lit(1)) - 1) / width).cast("int")).withColumn(
        "slot", F.col("pos") - F.col("block") * width)
    # before the first turn of a row: the path without that turn
    before = [F.max(F.when(F.col("slot") <= 1, F.col(f"x{s}").bitwiseXOR(_hash(s, F.col("pos"), F.col("t"))))).alias(f"k{s}") for s in (1, 2)]
    columns = [F.max(F.when(F.col("slot") == i, F.col("t"))).alias(f"t{i}") for i in range(1, width + 1)]
    reach = F.max(F.when(F.col("last"), F.col("slot")).otherwise(F.when(F.col("slot") == width, width + 1)))
    ends = [F.max(F.when(F.col("last"), F.col(f"x{s}"))).alias(f"x{s}") for s in (1, 2)]
    wide = rows.groupBy("conv_id", "block").agg(*before, *columns, reach.cast("int").alias("reach"), *ends)
    return wide.select("conv_id", F.struct("block", F.col("k1").alias("x1"), F.col("k2").alias("x2")).alias("key"),
                       *[f"t{i}" for i in range(1, width + 1)], "reach", "x1", "x2")


def _rollup(rows: DataFrame, width: int, *aggregates: Column) -> DataFrame:
    """Aggregate rows by every prefix of (t1, ..., t<width>) within a key. `level` is the prefix's length,
    from grouping_id. Prefixes longer than a row are cut off below the aggregate, as the
    condition only reads grouping columns."""
    turns = [f"t{i}" for i in range(1, width + 1)]
    out = rows.rollup("key", *turns).agg(F.grouping_id().alias("cut"), *aggregates)
    real = F.coalesce(*[F.when(F.col("cut") == (1 << (width - i)) - 1, F.col(f"t{i}").isNotNull()) for i in range(1, width + 1)],
                      (F.col("cut") == (1 << width) - 1) & (F.col("key.block") == 0))
    level = F.lit(width) - F.bit_count("cut")
    return out.filter(real).withColumn("level", level.cast("int")).drop("cut")


def _paths(nodes: DataFrame, width: int) -> DataFrame:
    """Adds depth, x1, x2 of a node and p1, p2 of its parent from its key and turns."""
    first = F.col("key.block") * width
    for s in (1, 2):
        own, parent = F.col(f"key.x{s}"), F.col(f"key.x{s}")
        for i in range(1, width + 1):
            h = _hash(s, first + i, F.col(f"t{i}"))
            own = own.bitwiseXOR(h)
            parent = parent.bitwiseXOR(F.when(F.col("level") > i, h).otherwise(F.lit(0).cast("bigint")))
        nodes = nodes.withColumns({f"x{s}": own, f"p{s}": parent})
    return nodes.withColumn("depth", (first + F.col("level")).cast("bigint"))


def _below(nodes: DataFrame, width: int) -> DataFrame:
    """For each key (a node at which a row of columns ended): leaves and saved tokens of all that hangs below it,
    and its children. Totals over rows below rows double their distance each round, so the number
    of rounds is the logarithm of the longest conversation's rows."""
    rows = nodes.filter("level > 0").groupBy("key").agg(
        F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"), F.count(F.when(F.col("level") == 1, 1)).alias("children"))
    inner = nodes.filter(F.col("level") == width).select(
        F.struct((F.col("key.block") + 1).alias("block"), "x1", "x2").alias("key"), F.col("key").alias("up"))
    state = materialize(rows.join(inner, "key", "left"), "rows")
    deepest = state.agg(F.max("key.block")).first()[0] or 0
    for _ in range(math.ceil(math.log2(deepest + 1))):
        gain = state.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        far = state.select(F.col("key").alias("up"), F.col("up").alias("further"))
        state = materialize(skewable_join(state, far, ["up"], "left").join(gain, "key", "left").select(
            "key", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), "children", F.col("further").alias("up")), "rows")
    return state.drop("up")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted (node, conv_id): the decimal ids of a node, joined, in pieces of about CHUNK bytes."""
    node, first, ids, size = None, None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": [node], "at": pa.array([first], pa.int64()), "ids": [",".join(ids)]})

    for batch in batches:
        for own, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (own != node or size >= CHUNK):
                yield piece()
                ids, size = [], 0
            if not ids:
                node, first = own, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted (node, at): SHA-256 of a node's pieces, fed one after the other."""
    node, digest, nodes, out = None, None, [], []
    for batch in batches:
        for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if own != node:
                if digest:
                    nodes.append(node)
                    out.append(digest.hexdigest())
                node, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if nodes:
            yield pa.RecordBatch.from_pydict({"node": nodes, "ends_sha256": out})
            nodes, out = [], []
    if digest:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [digest.hexdigest()]})


def _ends(rows: DataFrame, width: int) -> DataFrame:
    """Nodes at which conversations end, with the digest of their ids. The ids are sorted and joined by ranges,
    which may cut a node; what then meets in one task is a row per megabyte of ids."""
    node = F.concat_ws(":", (F.col("key.block") * width + F.col("reach")).cast("string"), F.col("x1").cast("string"), F.col("x2").cast("string"))
    ends = materialize(rows.filter(F.col("reach") <= width).select(node.alias("node"), "conv_id"), "ends")
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(
        _chunks, "node string, at bigint, ids string")
    digests = pieces.repartition("node").sortWithinPartitions("node", "at").mapInArrow(_digests, "node string, ends_sha256 string")
    parts = F.split("node", ":")
    return digests.select(*[F.get(parts, F.lit(i)).cast("bigint").alias(c) for i, c in enumerate(NODE)], "ends_sha256")


def prefix_trie(turns: DataFrame, width: int = BLOCK) -> DataFrame:
    """turns(conv_id, pos from 1, t; a row with pos 0 for each conversation) to one row per distinct prefix: conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A first ROLLUP over the turns of a row counts the members of all prefixes, a second one over the
    nodes found adds up their subtrees; hot prefixes shrink before either shuffle. Turns beyond `width`
    stand in further rows, keyed by the node before them. A conversation's turns pass through one
    task in order, a row at a time. An empty table gives no rows, not even the root.
    """
    rows = materialize(blocks(turns, width), "blocks")
    counted = _rollup(rows, width, F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("reach").alias("reach"))
    words = F.coalesce(*[F.when(F.col("level") == i, F.col(f"t{i}.words")) for i in range(1, width + 1)], F.lit(0).cast("bigint"))
    nodes = materialize(_paths(counted, width).withColumn("leaf", (F.col("reach") == F.col("level")).cast("bigint")).withColumn(
        "saved", (F.col("n_convs") - 1) * words).drop("reach"), "nodes")
    below = _below(nodes, width).select(
        (F.col("key.block") * width).cast("bigint").alias("depth"), F.col("key.x1").alias("x1"), F.col("key.x2").alias("x2"),
        F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"), F.col("children").alias("below_children"))
    # what hangs below a key counts at the last column of the row before it
    at_end = nodes.join(below.filter("depth > 0"), NODE, "left")
    tops = [F.count(F.when(F.col("level") == i, 1)).alias(f"c{i}") for i in range(1, width + 1)]
    totals = _paths(_rollup(
        at_end.select("key", *[f"t{i}" for i in range(1, width + 1)], F.col("level").alias("level"), "conv_id", "n_convs", "below_children",
                      (F.col("leaf") + F.coalesce("below_leaves", F.lit(0))).alias("leaf"),
                      (F.col("saved") + F.coalesce("below_saved", F.lit(0))).alias("saved")),
        width, F.min("conv_id").alias("conv_id"), F.max("n_convs").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"), F.max("below_children").alias("below_children"), *tops), width)
    children = F.coalesce(*[F.when(F.col("level") == i, F.col(f"c{i + 1}")) for i in range(width)], F.col("below_children"), F.lit(0))
    totals = materialize(totals.select(*NODE, "p1", "p2", "conv_id", "n_convs", children.cast("bigint").alias("n_children"), "n_leaves", "saved_tokens"), "totals")
    parents = totals.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = skewable_join(totals, parents, ["depth", "p1", "p2"], "left")
    return named.join(_ends(rows, width), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, family: int = FAMILY, width: int = BLOCK) -> DataFrame:
    """conversations(conv_id, turn, role, text), rebuilt, as a trie of their prefixes.

    Null roles and texts are empty ones; rows without conv_id belong to no conversation and are left out;
    repeated rows are turns of their own.
    """
    turns = materialize(numbered_turns(conversations), "turns")
    return prefix_trie(rebuild(turns, family), width)
