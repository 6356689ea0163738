import os

import pytest

import corpus_pipeline
from loomspark.llm import _store


def test_scope_deletes_its_own_tables_only(spark):
    path = lambda df: df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    with _store.scope(spark) as outer:
        first = path(_store.stored(spark.range(3), "a"))
        with pytest.raises(ValueError), _store.scope(spark):
            second = path(_store.stored(spark.range(3), "b"))
            raise ValueError
        assert os.path.exists(first) and not os.path.exists(second)
        kept = outer.pop().removeprefix("file://")
    assert os.path.exists(first) and os.path.samefile(kept, first)


def test_mixing_keeps_columns_of_its_own_names(spark):
    rows = [(i, f"some words of text {i}", "en", "src1", 20, 9, "own", "mine", "e") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, epoch int, n_tokens string, mix_domain string, _epoch string")
    out = corpus_pipeline.mixed(spark, docs, "")
    assert out.columns == [*docs.columns, "__epoch", "_n_tokens"]
    got = out.collect()
    assert got and {(r.epoch, r.n_tokens, r.mix_domain, r._epoch) for r in got} == {(9, "own", "mine", "e")} and {r.asDict()["__epoch"] for r in got} <= {1, 2, 3, 4} and {r._n_tokens for r in got} == {5}
