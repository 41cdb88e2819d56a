"""The trie of conversations' prefixes, its subtree sums taken along heavy paths.

A node stands for one distinct sequence of first turns. Every node's heaviest child (most members, then the least
conv_id) continues its path, all other children begin paths of their own. A light child has at most half of its
parent's members, so no node lies below more than log2(conversations) light edges. Paths are named by pointer doubling
along heavy edges; sums of a subtree are suffix sums along its path, and the sum at a path's top is attached to the
parent of the top, in one round for each number of light edges above.

No conversation, path or node is gathered in one task. Turns are numbered by a range sort and the sizes of its
partitions, prefix hashes and suffix sums are taken in blocks of BLOCK turns and carried over block totals, members of
a node are aggregated, and the ids that end at a node are joined in runs by range before one stream hashes the runs.

Defined results. Turns are ordered by turn, null first; equal turns by role, then text; repeated rows are turns each.
A null role or text is empty. Rows without conv_id belong to no conversation and are left out. An empty table has no
root. Extra columns are ignored. Two sequences are one node if two 64-bit hashes of their turns with places agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Turns, or nodes of a path, that one window holds.
BLOCK = 1024
#: Ids joined in one run.
RUN = 4096
KEY = ("depth", "a", "b")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, a, b, bytes): each turn with its number in the order of all, hashes of its content, bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    first = F.col("turn").asc_nulls_first()
    dealt = rows.repartitionByRange("conv_id", first, "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", first, "role", "text")
    content = (F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.octet_length("text").cast("long").alias("bytes"))
    rows = settle(dealt.select("conv_id", *content, F.monotonically_increasing_id().alias("id")))
    part = F.shiftright("id", 33).cast("int")
    sizes, upto = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()), 0
    begins = []
    for number, n in sizes:
        begins.append((number, upto))
        upto += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(begins, "part int, begin long"))
    at = F.col("begin") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("part", part).join(offsets, "part").select("conv_id", at.alias("at"), "a", "b", "bytes")


def placed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, pos, a, b, bytes), pos from 0, and conversations as (conv_id, total)."""
    turns = numbered(conversations)
    convs = settle(turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("total")))
    turns = turns.join(convs, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "a", "b", "bytes")
    return turns, convs.select("conv_id", "total")


def rebuilt(turns: DataFrame, convs: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """The same with each conversation's first turns taken from the first of its family.

    Of conversation c the first h turns give way to the first h turns of conversation c - c % family (all if there are
    fewer, none if it is absent), where h is the unsigned crc32 of c's digits modulo heads."""
    own = F.col("conv_id")
    plan = convs.select("conv_id", "total", (own - own % family).alias("base"), F.pmod(F.crc32(own.cast("string").cast("binary")), F.lit(heads)).alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("total").alias("base_total"))
    plan = plan.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_total", F.lit(0))))
    plan = settle(plan.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("total")))
    late = turns.join(plan.select("conv_id", "h", "k"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "a", "b", "bytes")
    early = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "k"), "base").where("pos < k")
    return late.union(early.select("conv_id", "pos", "a", "b", "bytes")), plan.select("conv_id", "total")


def _running(rows: DataFrame, group: str, place: Column, sums: dict[str, str], by: str) -> DataFrame:
    """Running totals (by sum or bit_xor) of the columns named by sums along `place` within each group, block by block."""
    total = {"sum": F.sum, "bit_xor": F.bit_xor}[by]

    def plus(x: Column, y: Column) -> Column:
        return x + y if by == "sum" else x.bitwiseXOR(y)

    rows = rows.withColumns({"_place": place, "_block": F.floor(place / BLOCK)})
    inside = Window.partitionBy(group, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(group, "_block").agg(*(total(c).alias(f"_{c}") for c in sums))
    blocks = blocks.select(group, "_block", *(F.coalesce(total(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums))
    rows = rows.withColumns({out: total(c).over(inside) for c, out in sums.items()}).join(blocks, [group, "_block"])
    return rows.withColumns({out: plus(F.col(out), F.col(f"_{c}")) for c, out in sums.items()}).drop("_place", "_block", *(f"_{c}" for c in sums))


def trails(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, up_a, up_b, bytes): the node that each turn leads to, and the one above it."""
    x, y = F.xxhash64("pos", "a", "b"), F.xxhash64(F.lit(1), "pos", "b", "a")
    rows = turns.select("conv_id", "pos", x.alias("x"), y.alias("y"), "bytes")
    rows = _running(rows, "conv_id", F.col("pos"), {"x": "a", "y": "b"}, "bit_xor")
    return rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b"), "bytes")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node joined in runs, from rows in order of node and id."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in KEY])
        new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))
        starts = np.flatnonzero(new)
        starts = np.concatenate([np.arange(s, e, RUN) for s, e in zip(starts, np.append(starts[1:], n), strict=True)])
        ids = batch.column("conv_id").to_numpy()
        joined = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])]
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[k, starts]) for k in range(3)), pa.array(ids[starts]), pa.array(joined)], [*KEY, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each node, from its runs in order."""
    now, state = None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if key == now:
                state.update(b"," + ids.encode())
                continue
            if now is not None:
                done.append((*now, state.hexdigest()))
            now, state = key, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], [*KEY, "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], [*KEY, "ends_sha256"])


def ends(last: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes at which conversations end; last: (depth, a, b, conv_id)."""
    dealt = last.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    runs = dealt.mapInArrow(_runs, "depth long, a long, b long, first long, ids string")
    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")


def _paths(nodes: DataFrame) -> DataFrame:
    """(key, path): the top of each node's heavy path, by doubling; nodes: key, up, heavy."""
    found = settle(nodes.select("key", F.when(F.col("heavy"), F.col("up")).otherwise(F.col("key")).alias("path"), (~F.col("heavy")).alias("done")))
    while not found.where("NOT done").isEmpty():
        far = found.select(F.col("key").alias("path"), F.col("path").alias("farther"), F.col("done").alias("there"))
        further = found.where("NOT done").join(far, "path").select("key", F.col("farther").alias("path"), F.col("there").alias("done"))
        found = settle(found.where("done").union(further))
    return found.select("key", "path")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, pos, a, b, bytes) with pos from 0 without gaps; convs: (conv_id, total), turnless ones included.
    saved_tokens sums (n_convs - 1) * bytes over the subtree: the bytes that a cache of prefixes would spare."""
    trail = settle(trails(turns))
    every = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).first()
    root = F.struct(*(F.lit(0).cast("long").alias(c) for c in KEY))
    nodes = trail.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in ("up_a", "up_b", "bytes")), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = nodes.select(F.struct(*KEY).alias("key"), F.struct((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).alias("up"), "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    top = trail.sparkSession.range(1).where(F.lit(every.n > 0)).select(root.alias("key"), F.lit(None).cast(nodes.schema["up"].dataType).alias("up"), F.lit(every.conv_id).cast("long").alias("conv_id"), F.lit(every.n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("own"))
    nodes = settle(nodes.union(top))

    kids = settle(nodes.where("up IS NOT NULL").groupBy("up").agg(F.count("*").alias("n_children"), F.max_by("key", F.struct("n_convs", -F.col("conv_id"))).alias("key")))
    nodes = nodes.join(kids.select(F.col("up").alias("key"), "n_children"), "key", "left").join(kids.select("key", F.lit(True).alias("heavy")), "key", "left")
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "heavy": F.coalesce("heavy", F.lit(False))})
    nodes = settle(nodes.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")))
    nodes = settle(nodes.join(_paths(nodes), "key"))

    # Light edges above each path. The children of the root, whose number has no bound, need no join.
    tops, below = nodes.where("NOT heavy").select("key", "up"), F.col("up") == root
    above = tops.where(F.col("up").isNotNull() & ~below).join(nodes.select(F.col("key").alias("up"), "path"), "up").select("key", F.col("path").alias("upper"))
    above = settle(above.union(tops.where(below).select("key", root.alias("upper"))))
    ranked = [tops.where("up IS NULL").select("key"), above.where(F.col("upper") == root).select("key")]
    rest = above.where(F.col("upper") != root)
    while not ranked[-1].isEmpty():
        ranked.append(settle(rest.join(ranked[-1].withColumnRenamed("key", "upper"), "upper").select("key")))
    levels = ranked[0].withColumn("level", F.lit(0))
    for level, some in enumerate(ranked[1:], 1):
        levels = levels.union(some.withColumn("level", F.lit(level)))
    nodes = settle(nodes.join(levels.withColumnRenamed("key", "path"), "path"))

    done, attached = None, None
    for level in reversed(range(len(ranked) - 1)):
        some = nodes.where(F.col("level") == level)
        if attached is not None:
            some = some.join(attached, "key", "left")
            some = some.withColumns({"leaf": F.col("leaf") + F.coalesce("more_leaves", F.lit(0)), "own": F.col("own") + F.coalesce("more_saved", F.lit(0))})
        some = settle(_running(some, "path", -F.col("key.depth"), {"leaf": "n_leaves", "own": "saved_tokens"}, "sum").select("key", "up", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "heavy"))
        attached = some.where("NOT heavy AND up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        done = some if done is None else done.union(some)
    if done is None:
        done = nodes.withColumns({"n_leaves": F.col("leaf"), "saved_tokens": F.col("own")})

    last = trail.join(convs, "conv_id").where("depth = total").select(*KEY, "conv_id")
    last = settle(last.union(convs.where("total = 0").select(*(F.lit(0).cast("long").alias(c) for c in KEY), "conv_id")))
    hashes = ends(last).select(F.struct(*KEY).alias("key"), "ends_sha256")
    parents = done.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    far = done.where("up IS NOT NULL").where(~below).join(parents, "up")
    near = done.where(F.col("up").isNull() | below).withColumn("parent_conv_id", F.when(F.col("up").isNotNull(), F.lit(every.conv_id)).cast("long"))
    out = far.unionByName(near).join(hashes, "key", "left")
    return out.select("conv_id", F.col("key.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
