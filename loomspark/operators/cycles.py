"""Strongly connected components of edges (src, dst), and a closed walk through each, without the closure of pairs.

Labels spread along edges and jump: the label of a node is a node that reaches it, so that node's own label
reaches it too. Each round joins labels with the edges once and with themselves once, so labels run through chains
and rings in rounds in the logarithm of their length. Labels are ordered by a hash, which cuts what is not on a cycle into
pieces of random size: a chain is gone after a logarithmic number of cuts. Tables between rounds are written, so plans stay short.

Before that, each task replaces what is strongly connected within a block of its edges by one node, as an aggregate
combines rows before its shuffle. Nodes that only one block has need no more than their representative's component;
those of several blocks stay tied to their representatives by edges both ways, so nothing that edges reach is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.plans.store import written

#: Edges of a block, about.
BLOCK_EDGES = 1 << 18

#: Nodes without predecessors or successors are taken away, again and again, while that removes at least this share of the edges.
TRIM_SHARE = 0.1


def least_reaching(edges: DataFrame) -> DataFrame:
    """(node, label): of the nodes from which a node is reached, itself included, the first in the order of their hashes; label has its hash and the node."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = written(nodes.select("node", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node")).alias("label")), "labels")
    while True:
        heard = labels.join(edges, labels["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("heard"))
        told = written(labels.join(heard, "node", "left").select("node", F.least("label", F.coalesce("heard", "label")).alias("label"), F.col("label").alias("old")), "told")
        # labels of nodes that carry another one themselves; roots have their own, so a label that all share is not looked up
        moved = told.where(F.col("label.node") != F.col("node")).select(F.col("node").alias("at"), F.col("label").alias("further"))
        labels = written(told.join(moved, F.col("label.node") == F.col("at"), "left").select("node", F.coalesce("further", "label").alias("label"), "old"), "labels")
        if labels.where("label < old").isEmpty():
            return labels.select("node", "label")


def _core(edges: DataFrame) -> DataFrame:
    """edges without those that cannot be on a cycle because one end has no way on, as far as that takes many away."""
    edges = written(edges, "core")
    n = edges.count()
    while n:
        less = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        edges, before = written(less, "core"), n
        n = edges.count()
        if before - n < TRIM_SHARE * before:
            break
    return edges


def _connected(n: int, begin: list[int], after: list[int]) -> np.ndarray:
    """The strongly connected component of each node, named by its least one: Tarjan's algorithm without recursion. The successors of u are after[begin[u] : begin[u + 1]]."""
    order, low, least, stack, now = [0] * n, [0] * n, [-1] * n, [], 0
    at = begin[:n]
    for root in range(n):
        if order[root]:
            continue
        path = [root]
        while path:
            u = path[-1]
            if not order[u]:
                now += 1
                order[u] = low[u] = now
                stack.append(u)
            if at[u] < begin[u + 1]:
                v = after[at[u]]
                at[u] += 1
                if not order[v]:
                    path.append(v)
                elif least[v] < 0:
                    low[u] = min(low[u], order[v])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[u])
            if low[u] == order[u]:
                cut = len(stack) - 1
                while stack[cut] != u:
                    cut -= 1
                name = min(stack[cut:])
                for v in stack[cut:]:
                    least[v] = name
                del stack[cut:]
    return np.array(least, np.int64)


def _walks(least: np.ndarray, src: np.ndarray, dst: np.ndarray) -> list[tuple[int, int, int]]:
    """(component, step, node) of the walks that cycle_walks describes; edges (src, dst) are in order and inside of components."""
    first = np.ones(len(src), bool)
    first[1:] = src[1:] != src[:-1]
    after = dict(zip(src[first].tolist(), dst[first].tolist(), strict=True))
    best: dict[int, int] = {}  # component: least node of a ring
    seen: dict[int, int] = {}
    for start in after:
        u = start
        while u not in seen:
            seen[u] = start
            u = after[u]
        if seen[u] == start:  # a new ring
            low, v = u, after[u]
            while v != u:
                low, v = min(low, v), after[v]
            part = int(least[u])
            best[part] = min(low, best.get(part, low))
    out = []
    for part, start in best.items():
        step, u = 0, start
        while not step or u != start:
            out.append((part, step, u))
            step, u = step + 1, after[u]
        out.append((part, step, start))
    return out


def _blocks(edges: DataFrame, walks: bool) -> DataFrame:
    """Stored (kind, a, b, step). node: a node of a block and its representative there (null: on none of its cycles); edge: an edge between representatives; walk: (representative, node) at a step of the walk by the block's edges."""
    ends = edges.select("src", "dst").where("src is not null and dst is not null")
    kind = ends.select("src").union(ends.select("dst")).schema[0].dataType
    ends = ends.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))

    def reduced(src: pa.Array, dst: pa.Array) -> Iterator[pa.RecordBatch]:
        both = pa.concat_arrays([src, dst])
        names = both.unique()
        names = names.take(pc.sort_indices(names))
        at = pc.index_in(both, names).to_numpy().astype(np.int64)
        n = len(names)
        s, d = np.divmod(np.unique(at[: len(src)] * n + at[len(src) :]), n)
        least = _connected(n, np.searchsorted(s, np.arange(n + 1)).tolist(), d.tolist())
        inside = least[s] == least[d]
        cyclic = np.zeros(n, bool)
        cyclic[s[inside]] = True  # a node alone is on a cycle if it points to itself
        a, b = np.divmod(np.unique(least[s[~inside]] * n + least[d[~inside]]), n)
        some = np.array(_walks(least, s[inside], d[inside]) if walks else [], np.int64).reshape(-1, 3)
        parts = [("node", np.arange(n), pa.array(least, mask=~cyclic), None), ("edge", a, pa.array(b), None), ("walk", some[:, 0], pa.array(some[:, 2]), some[:, 1])]
        for name, x, y, step in parts:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), names.take(pa.array(x)), names.take(y), pa.nulls(len(x), pa.int64()) if step is None else pa.array(step)], ["kind", "a", "b", "step"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held, size = [*held, b], size + len(b)
            if size >= BLOCK_EDGES:
                yield from reduced(*(x.combine_chunks() for x in pa.Table.from_batches(held).columns))
                held, size = [], 0
        if size:
            yield from reduced(*(x.combine_chunks() for x in pa.Table.from_batches(held).columns))

    name = kind.simpleString()
    return written(ends.mapInArrow(run, f"kind string, a {name}, b {name}, step long"), "blocks")


def _joined(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, component) of all nodes on cycles; the same of those between blocks, stored; component: those of which several blocks have nodes, stored."""
    nodes = blocks.where("kind = 'node'").select("a", "b")
    shared = written(nodes.groupBy("a").count().where("count > 1").select("a"), "shared")
    tied = written(nodes.where("b is not null").join(shared, "a", "left_semi"), "tied")
    ties = tied.where("a <> b")
    rest = blocks.where("kind = 'edge'").select("a", "b").unionByName(ties).unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = _labelled(rest.toDF("src", "dst"))
    own = lambda df: df.join(across.withColumnRenamed("node", "b"), "b", "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
    parts = own(nodes.where("b is not null")).unionByName(across).groupBy("node").agg(F.min("component").alias("component"))
    split = written(across.select("component").unionByName(own(tied).select("component")).distinct(), "split")
    return parts, across, split


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles; a component is named by its least node. Null ends are left out, repeated edges count once."""
    return written(_joined(_blocks(edges, False))[0], "found")


def _labelled(edges: DataFrame) -> DataFrame:
    """strong_components by labels alone.

    Each round labels nodes along the edges, and against them within a label. A node with itself as a label and the nodes
    that have it as both labels are a component; nodes that differ in a label are in different ones, so only edges
    between other nodes of equal labels go on to the next round.
    """
    e = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    found = e.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    live = _core(e.where("src <> dst"))
    same = lambda es, labels: es.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
    while not live.isEmpty():
        ahead = least_reaching(live)
        inner = written(same(live, ahead).select("src", "dst"), "inner")
        back = least_reaching(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        whole = written(ahead.join(back, ["node", "label"]).select("node", "label"), "components")
        named = whole.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(whole.join(named, "label").select("node", "component"))
        done = whole.select(F.col("node").alias("src"))
        live = _core(same(inner, back).select("src", "dst").join(done, "src", "left_anti").join(done.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
    return written(found.groupBy("node").agg(F.min("component").alias("component")), "found")


def cycle_walks(edges: DataFrame) -> DataFrame:
    """(component, step, node): a closed walk in each component, from step 0 to the same node at the last step.

    Every node points to its least successor in the component. These pointers run into rings; the ring with the
    least node is the walk, and begins there. Pointers are doubled until they span the largest component: what they then hit is on a
    ring, and the distances they have added up order it. Components that one block has whole were walked there.
    """
    blocks = _blocks(edges, True)
    parts, across, split = _joined(blocks)
    elsewhere = across.select(F.col("node").alias("a")).unionByName(split.select(F.col("component").alias("a"))).distinct()
    near = blocks.where("kind = 'walk'").join(elsewhere, "a", "left_anti").select(F.col("a").alias("component"), "step", F.col("b").alias("node"))
    if split.isEmpty():
        return near
    return near.unionByName(_pointed(edges, written(parts.join(split, "component", "left_semi").select("node", "component"), "parts")))


def _pointed(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """The walks of the components in parts (node, component), by doubling pointers."""
    own = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    inside = edges.select("src", "dst").distinct().join(own("src"), "src").join(own("dst"), "dst").where("src_part = dst_part")
    first = written(inside.groupBy(F.col("src_part").alias("component"), F.col("src").alias("node")).agg(F.min("dst").alias("next")), "pointers")
    largest = first.groupBy("component").count().agg(F.max("count")).first()[0] or 1
    doublings = max(1, (largest - 1).bit_length())
    far = first
    for _ in range(doublings):
        far = written(far.join(far.select(F.col("node").alias("next"), F.col("next").alias("further")), "next").select("component", "node", F.col("further").alias("next")), "far")
    ring = far.select("component", F.col("next").alias("node")).distinct()
    starts = ring.groupBy("component").agg(F.min("node").alias("start"))
    ends = written(first.join(ring, ["component", "node"], "left_semi").join(starts, "component").select("component", "node", "start", F.when(F.col("node") == F.col("start"), F.col("node")).otherwise(F.col("next")).alias("to"), F.when(F.col("node") == F.col("start"), 0).otherwise(1).cast("long").alias("dist")), "ring")
    for _ in range(doublings):
        after = ends.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("dist").alias("more"))
        ends = written(ends.join(after, "to").select("component", "node", "start", F.col("further").alias("to"), (F.col("dist") + F.col("more")).alias("dist")), "ring")
    walk = ends.where("to = start")
    length = walk.groupBy("component").agg(F.count("*").alias("length"))
    steps = walk.join(length, "component").select("component", F.pmod(F.col("length") - F.col("dist"), F.col("length")).alias("step"), "node")
    closing = walk.where("node = start").join(length, "component").select("component", F.col("length").alias("step"), "node")
    return steps.unionByName(closing)


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(component, path): the closed walks as arrays, for graphs whose components fit in a row each."""
    steps = F.array_sort(F.collect_list(F.struct("step", "node")))
    return cycle_walks(edges).groupBy("component").agg(F.transform(steps, lambda x: x["node"]).alias("path"))
