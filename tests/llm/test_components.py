import random

import pytest
from pyspark.sql import functions as F

from loomspark.llm import _split, components

FOREST = random.Random(5)


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def path(n):
    order = FOREST.sample(range(-n, n), n)
    return list(zip(order, order[1:], strict=False))


GRAPHS = {
    "sparse": [(FOREST.randrange(900), FOREST.randrange(900)) for _ in range(500)],
    "path": path(400),
    "hubs": [(h, 1000 + 7 * h + i) for h in (3, 1, 2) for i in range(300)] + [(5000, 3), (5000, 1)],
}


def jobs(spark, run):
    """Spark jobs of run(), and what it returned."""
    spark.sparkContext.setJobGroup(name := f"jobs{FOREST.random()}", "")
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), out


@pytest.mark.parametrize("graph", GRAPHS)
@pytest.mark.parametrize(("block", "heavy"), [(1 << 17, 100_000), (16, 100_000), (16, 0)])
def test_blocks(spark, monkeypatch, graph, block, heavy):
    """Also in blocks that hardly shrink, with star rounds after them, and with pointers followed by a shuffle."""
    monkeypatch.setattr(components, "BLOCK_EDGES", block)
    monkeypatch.setattr(components, "MOST_HEAVY", heavy)
    monkeypatch.setattr(_split, "HEAVY", 20)
    edges = [*GRAPHS[graph], (7, 7), (None, 7), (7, None)]
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(13)).collect()
    want = brute([e for e in GRAPHS[graph] if e[0] != e[1]])
    assert dict(map(tuple, got)) == want and len(got) == len(want)


def test_few_jobs(spark):
    """The driver keeps something of each job and task, so rounds are to be few and short."""
    edges = spark.createDataFrame([e for g in GRAPHS.values() for e in g], "a long, b long").repartition(13)
    n, got = jobs(spark, lambda: components.components(edges).count())
    assert got == len(brute([e for g in GRAPHS.values() for e in g if e[0] != e[1]])) and n <= 30


def test_bit_table_jobs(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
        n, table = jobs(spark, lambda: _split.bit_table(hashes, "h"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    found = hashes.toArrow().column("h").to_numpy().view("uint64")
    assert _split.maybe(table, found).all() and not _split.maybe(table, ~found).all() and n <= 8
