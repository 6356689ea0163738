import random

from loomspark.operators import cycles as C
from loomspark.operators import graph as G


def table(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def reach(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for start in after:
        seen, todo = set(), list(after[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out[start] = seen
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    for n, m in ((50, 70),):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        far = reach(edges)
        want = {a: min(b for b in far[a] if a in far.get(b, ())) for a in far if a in far[a]}
        df = table(spark, edges + [(None, 1), (1, None)])
        assert {r.node: r.component for r in C.strong_components(df).collect()} == want
        assert {r.node for r in G.on_cycles(df).collect()} == set(want)
        walks = {}
        for r in C.cycle_walks(df).collect():
            walks.setdefault(r.component, {})[r.step] = r.node
        assert set(walks) == set(want.values())
        for part, steps in walks.items():
            path = [steps[k] for k in range(len(steps))]
            assert path[0] == path[-1] == min(path) and len(set(path)) == len(path) - 1
            assert all(pair in edges and want[pair[0]] == part for pair in zip(path, path[1:]))


def test_long_rings_and_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(C, "written", lambda df, name, keep=C.written: rounds.append(name) or keep(df, name))
    n = 200
    ring = [(i, (i + 1) % n) for i in range(n)]
    chain = [(n + i, n + i + 1) for i in range(50)]
    df = table(spark, ring + chain)
    assert C.strong_components(df).groupBy("component").count().collect() == [(0, n)]
    assert rounds.count("labels") <= 80
    rounds.clear()
    assert C.cycle_paths(df).collect() == [(0, [*range(n), 0])]


def test_no_edges_and_no_cycles(spark):
    assert C.cycle_walks(table(spark, [])).count() == 0 and C.strong_components(table(spark, [(1, 2), (2, 3), (1, 3)])).count() == 0
    assert {tuple(r) for r in C.cycle_walks(table(spark, [(7, 7), (7, 7), (7, 8)])).collect()} == {(7, 0, 7), (7, 1, 7)}
