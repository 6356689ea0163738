"""Edges (src, dst): reverse edges, mutual edges, closure, cycles, placement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.cycles import strong_components
from loomspark.plans.store import written

#: Tables of a search that are merged into one, so that plans stay as short in its late rounds as in its early ones.
MERGED = 6


def reverse_dependents(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("src")), lambda x: x.cast("string")), ",").alias("dependents"))


def mutual(edges: DataFrame) -> DataFrame:
    e = edges.distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.where("src < dst").join(back, ["src", "dst"], "left_semi")


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(start, node): what each start reaches by one edge or more.

    A frontier loop: each round joins only the newest pairs, drops seen ones by an anti-join, and
    writes the frontier to shared storage, so plans stay short and lost executors cost one round.
    """
    e = written(edges.select("src", "dst").distinct(), "edges")
    first = e.select(F.col("src").alias("start"), F.col("dst").alias("node"))
    if starts is not None:
        first = first.join(starts.select("start"), "start", "left_semi")
    rounds = [written(first.distinct(), "front")]
    while not rounds[-1].isEmpty():
        front = rounds[-1]
        step = front.join(e, front["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        for seen in rounds:
            step = step.join(seen, ["start", "node"], "left_anti")
        if len(rounds) == MERGED:
            rounds = [written(reduce(DataFrame.unionByName, rounds), "seen")]
        rounds.append(written(step, "front"))
    return reduce(DataFrame.unionByName, rounds)


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle: those of strongly connected components."""
    return strong_components(edges).select("node")


def exclusive(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Fixpoint of placement: nodes whose dependents all move with the moved nodes. moved: node."""
    move = written(moved.select("node").distinct(), "moved")
    e = written(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    while True:
        reached = e.join(move, e["src"] == move["node"], "left_semi").select(F.col("dst").alias("node")).distinct().join(move, "node", "left_anti")
        shared = e.join(move, e["src"] == move["node"], "left_anti").select(F.col("dst").alias("node")).distinct()
        new = written(reached.join(shared, "node", "left_anti"), "new")
        if new.isEmpty():
            return move
        move = written(move.unionByName(new), "moved")
