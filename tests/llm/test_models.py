"""Co-training that exchanges in both directions, and ordinal fits against an independent minimiser."""

import random

import numpy as np
import pytest

from loomspark.llm import quality, toxicity
from loomspark.llm._fit import auc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def two_views(n, seed):
    """Good documents have longer, more varied texts and come from other sources, each with exceptions of its own."""
    rng, rows, truth = random.Random(seed), [], {}
    for i in range(n):
        good = i % 2
        words = [f"w{rng.randrange(400 if good else 25)}" for _ in range(rng.randint(20, 60))]
        if rng.random() < 0.15:
            words = [f"w{rng.randrange(90)}" for _ in words]
        source = f"s{rng.randrange(20) + (20 if good and rng.random() < 0.93 else 0)}"
        rows.append((i, " ".join(words), "en", source, 100))
        truth[i] = good
    return rows, truth


def test_views_teach_each_other(spark):
    rows, truth = two_views(3000, 1)
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, truth[i]) for i in range(120)], "doc_id long, quality int")
    alone, taught = (quality.train(d, labels, rounds=n, give=600, sure=0.9) for n in (0, 3))
    assert alone.learned == (0, 0) and min(taught.learned) > 100
    scores = {}
    for name, model in (("alone", alone), ("taught", taught)):
        got = {r.doc_id: r for r in quality.score_quality(d, model).collect()}
        ids = range(120, 3000)
        y = np.array([truth[i] for i in ids])
        scores[name] = [auc(y, np.array([got[i][c] for i in ids])) for c in ("p_content", "p_metadata", "p_good")]
    assert scores["taught"][1] > scores["alone"][1] - 0.01 and scores["taught"][2] > scores["alone"][2] - 0.005 and scores["taught"][2] > 0.95


@pytest.mark.parametrize("known", [1, 6, 30])
def test_few_labels(spark, known):
    rows, truth = two_views(200, 2)
    d = spark.createDataFrame([*rows, (None, None, None, None, None), (7, "", None, "s", 0), rows[3]], SCHEMA)
    m = quality.train(d, spark.createDataFrame([(i, truth[i]) for i in range(known)] + [(None, 1), (9000, 0)], "doc_id long, quality int"), give=50)
    assert quality.score_quality(d, m).count() == 203 and quality.keep_good(d, m).columns == d.columns
    assert quality.keep_good(d, m).count() == quality.score_quality(d, m).where("keep").count()


def loss(rows, y, w, cuts, l2):
    """The ridge likelihood, written out."""
    total = l2 / 2 * sum(x * x for x in w)
    for r, k in zip(rows, y, strict=True):
        m = sum(w[j] for j in r)
        below = lambda c, m=m: 1 / (1 + np.exp(-(c - m)))
        high = below(cuts[k]) if k < len(cuts) else 1.0
        total -= np.log(high - (below(cuts[k - 1]) if k else 0.0))
    return total


def test_ordinal_fit_is_the_minimum():
    rng = np.random.default_rng(3)
    true = np.array([2.0, 1.0, -1.5, 0.5])
    rows = [np.flatnonzero(rng.random(4) < 0.5).astype(np.int32) for _ in range(250)]
    noise = rng.logistic(size=len(rows))
    y = np.searchsorted([0.0, 1.0, 2.5], np.array([true[r].sum() for r in rows]) + noise)
    m = toxicity.fit_ordinal(rows, y, grades=[0, 1, 2, 3], sure=0.0, steps=2000)
    assert (np.diff(m.cuts) > 0).all()
    best = np.concatenate([m.weights[:4], m.cuts]).astype(float)
    at = lambda x: loss(rows, y, x[:4], x[4:], 0.2)
    here = at(best)
    for i in range(len(best)):
        for step in (-0.05, 0.05):
            moved = best.copy()
            moved[i] += step
            assert at(moved) > here


def test_grades_in_order(spark):
    rng, rows, grades = random.Random(5), [], {}
    for i in range(1500):
        hard = rng.choice([0, 0, 0, 1, 2, 3])
        words = [f"plain{rng.randrange(300)}" for _ in range(30)] + [rng.choice(["mild", "crude"][: 1 + (hard > 1)] if hard < 3 else ["vile", "foul"]) for _ in range(hard)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        grades[i] = hard
    d = spark.createDataFrame([*rows, (None, None), (None, ""), rows[1]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, grades[i]) for i in range(0, 1500, 2)] + [(None, 3), (1, None)], "doc_id long, grade int")
    m = toxicity.train(d, labels)
    assert m.grades == [0, 1, 2, 3] and (np.diff(m.cuts) > 0).all()
    got = toxicity.score_toxicity(d, m).collect()
    assert len(got) == 1503
    by = {k: np.mean([r.severity for r in got if r.doc_id is not None and r.doc_id % 2 and grades[r.doc_id] == k]) for k in range(4)}
    assert by[0] < by[1] < by[2] < by[3]
    again = sorted((r.doc_id or -1, r.severity) for r in toxicity.score_toxicity(d, toxicity.train(d.repartition(7), labels.repartition(3))).collect())
    assert again == sorted((r.doc_id or -1, r.severity) for r in got)
