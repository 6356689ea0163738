"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._split import MOST_HEAVY, split_join
from loomspark.llm._store import stored

#: Edges that a task holds at a time.
BLOCK_EDGES = 1 << 17
#: Blocks after the first round, if the edges left fit; an eighth of them in each further round.
BLOCKS = 8


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), longs: root is the smallest node that paths reach.

    Tasks first replace each block of edges by links of its nodes to the smallest node that the block joins them with. A node
    has one link a block at most, so grouping links by it makes no hot group. One that is nobody's smallest is
    left out with a pointer to the least of its links, which then are joined with each other; edges between the others make
    the next round, in fewer blocks. What is more than a block and does not halve goes through star rounds.
    Pointers descend and each node has one, so following them ends at the smallest. Loops and nulls are dropped; an
    empty table gives an empty result.
    """
    e = edges.select("a", "b").where("a <> b")
    levels, before, blocks, last = [], None, 8 * BLOCKS, None
    while True:
        links = e.mapInArrow(_reduced(BLOCK_EDGES), "node long, low long").groupBy("node")
        links = stored(links.agg(F.collect_set("low").alias("lows"), F.max(F.col("low").isNull()).alias("inner")), "links")
        n = F.size("lows") - F.when(F.col("inner"), 0).otherwise(1)
        left, out = links.agg(F.coalesce(F.sum(n), F.lit(0)), F.count_if(~F.col("inner"))).first()
        levels.append((links.where("not inner").select("node", F.array_min("lows").alias("low")), out))
        if not left:
            break
        each = links.select("node", "inner", F.explode("lows").alias("low"), F.array_min("lows").alias("least"))
        e = each.select(F.when(F.col("inner"), F.col("node")).otherwise(F.col("low")).alias("a"), F.when(F.col("inner"), F.col("low")).otherwise(F.col("least")).alias("b")).where("a <> b")
        if before is not None and left > BLOCK_EDGES and 2 * left > before:
            last = stored(_stars(e).where("node <> root"), "stars")
            break
        before, blocks = left, max(blocks // 8, ceil(left / BLOCK_EDGES), 1)
        e = e.coalesce(blocks)
    ends, known = (last, last.count()) if last is not None else (None, 0)
    for pointer, out in reversed(levels):
        if ends is None:
            ends, known = pointer.withColumnRenamed("low", "root"), out
            continue
        ends, known = stored(ends.unionByName(_followed(pointer, ends, known)), "ends"), known + out
    return ends.unionByName(ends.select(F.col("root").alias("node"), "root").distinct())


def _followed(pointer: DataFrame, ends: DataFrame, known: int) -> DataFrame:
    """(node, root) of pointers (node, low), where ends holds the root of each low that is none itself."""
    if known <= MOST_HEAVY:
        return pointer.join(F.broadcast(ends.select(F.col("node").alias("low"), "root")), "low", "left").select("node", F.coalesce("root", "low").alias("root"))
    low = pointer.groupBy("low").agg(F.count("*").alias("c")).join(ends.withColumnRenamed("node", "low"), "low", "left")
    return split_join(pointer, stored(low.select("low", F.coalesce("root", "low").alias("root"), "c"), "lows"), ["low"], "c").select("node", "root")


def lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) in order, and the smallest node that each of them reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        # each label that meets a smaller one hangs below it; then all jump to the top
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[label]


def _reduced(most: int):
    """Of edges (a, b): (node, low) with the smallest node that the task's edges join it with, null for that node itself; most edges are held at a time."""

    def told(node: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(low, mask=node == low)], ["node", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for start in range(0, len(batch), most):
                some = batch.slice(start, most)
                held.append(tuple(np.asarray(some.column(i), dtype=np.int64) for i in range(2)))
                if sum(len(a) for a, _ in held) > most:
                    held = [lowest(*map(np.concatenate, zip(*held, strict=True)))]
                    if 2 * len(held[0][0]) > most:  # hardly shrunk: the next edges are a block of their own
                        yield told(*held.pop())
        if held:
            yield told(*lowest(*map(np.concatenate, zip(*held, strict=True))))

    return run


def _stars(edges: DataFrame) -> DataFrame:
    """components() by alternating large-star and small-star steps, which halve the depth of the trees and never add edges.

    Each step groups with partial aggregation; a hub's smallest
    neighbour meets its edges by broadcast, so they stay spread over tasks. Rounds end when an
    order-free digest of the edge set repeats.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        e = split_join(both.where("v > u"), low, ["u"], "c").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        kept = split_join(e, low, ["u"], "c")
        e = kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = stored(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
