import random

import pytest
from tests.test_cycles import reach, table

from loomspark.operators import cycles as C


def walked(df):
    return sorted(map(tuple, C.cycle_walks(df).select("component", "step", "node").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(100, 101), (101, 102), (102, 100), (101, 101), (101, 103)]
    rng.shuffle(edges)
    edges += [(100, 101), (101, 101), (None, 3)]
    far = reach([e for e in edges if e[0] is not None])
    want = sorted((a, min(b for b in far[a] if a in far.get(b, ()))) for a in far if a in far[a])
    df = table(spark, edges)
    assert sorted(map(tuple, C.strong_components(df).collect())) == want
    whole = sorted(map(tuple, C._pointed(df.where("src is not null"), spark.createDataFrame(want, "node long, component long")).collect()))
    assert walked(df) == whole
    monkeypatch.setattr(C, "BLOCK_EDGES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted(map(tuple, C.strong_components(df).collect())) == want
        assert walked(df) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rings_of_one_block_take_no_rounds(spark, monkeypatch):
    """Strings, too; the walk is the ring with the least node, component the least node of all."""
    names = []
    monkeypatch.setattr(C, "written", lambda df, name, keep=C.written: names.append(name) or keep(df, name))
    edges = [(f"r{k}-{i}", f"r{k}-{(i + 1) % 5}") for k in range(40) for i in range(5)] + [(f"r{k}-3", "end") for k in range(40)]
    df = spark.createDataFrame(edges, "src string, dst string").coalesce(1)
    assert {tuple(r) for r in C.strong_components(df).collect()} == {(f"r{k}-{i}", f"r{k}-0") for k in range(40) for i in range(5)}
    assert {tuple(r) for r in C.cycle_walks(df).select("component", "step", "node").collect()} == {(f"r{k}-0", i, f"r{k}-{i % 5}") for k in range(40) for i in range(6)}
    assert not {"labels", "told", "pointers", "far", "ring"} & set(names)
