"""Very large families, which chance signatures chain, are cut by the prints of their sets before sets meet."""

import random

import pytest

from loomspark.llm import _split, jaccard
from tests.llm.test_ops import linked


@pytest.mark.parametrize("print_docs", [50, 1 << 14])
def test_a_chain_of_unlinked_texts_is_cut(spark, monkeypatch, print_docs):
    """Neighbours share much of their words but not enough to link, so all are one family, of which few sets have to meet."""
    for name, value in (("BLOCK_DOCS", 20), ("FINE_DOCS", 60), ("PRINT_DOCS", print_docs)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    monkeypatch.setattr(_split, "HEAVY", 20)
    rng, met, stored = random.Random(7), [], jaccard.stored
    words = [f"w{i}" for i in range(5000)]
    texts = [words[15 * i : 15 * i + 100 - i % 3] for i in range(240)]
    texts += [[*t[:50], f"x{k}", *t[50:]] for k, t in enumerate(rng.sample(texts, 60))]
    texts = [" ".join(t) for t in texts] + ["one two", "one two three four five six seven eight"]

    def noted(df, name):
        out = stored(df, name)
        if name == "totals":
            met.append(out.agg({"docs": "max"}).first()[0])
        if name == "pivoted":
            met.append(("pivoted", out.count()))
        return out

    monkeypatch.setattr(jaccard, "stored", noted)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.shingle_components(rows, size=5, part=80).collect()}
    want = linked(texts, 5, 80)
    assert [got[i] for i in range(len(texts))] == want and 200 < len(set(want)) < 260
    assert met[0] > 200 and met[1:] and all(isinstance(m, int) and m <= 5 for m in met[1:])
