import zlib
from collections import Counter
from itertools import product

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomspark.llm import sharding
from loomspark.llm.queries import op12_sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, row int, key string, items string, nth int, bucket int"


def docs(spark, n=300):
    rows = [(i, f"text {i} " * (i % 7), "en", f"s{i % 3}", i) for i in range(n)] + [(None, None, None, None, None)] * 3 + [(5, "", None, "s", 0)] * (n // 2) + [(n, "long " * 50_000, "en", "s", 1)]
    return rows, spark.createDataFrame([(*r, "own", 9, 1, "k", "i", 2, 3) for r in rows], SCHEMA)


def check_places(rows, shards):
    per = Counter(r.shard for r in rows)
    assert max(per.get(s, 0) for s in range(shards)) - min(per.get(s, 0) for s in range(shards)) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(shards) for k in range(per.get(s, 0))]


@pytest.mark.parametrize(("shards", "bucket_rows"), [(16, 1024), (3, 10), (1, 1)])
def test_every_record_once(spark, shards, bucket_rows, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows, table = docs(spark)
    out = sharding.shuffle_shards(table, shards=shards, bucket_rows=bucket_rows)
    assert sorted(out.columns) == sorted(table.columns)
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got) == Counter(rows) and {r.bucket for r in got} == {3}
    check_places(got, shards)
    order = [(r.shard, r.slot, r.doc_id, r.text) for r in got]
    again = sharding.shuffle_shards(table.repartition(5), shards=shards, bucket_rows=bucket_rows).collect()
    assert sorted(order, key=lambda x: x[:2]) == sorted(((r.shard, r.slot, r.doc_id, r.text) for r in again), key=lambda x: x[:2])
    other = sharding.shuffle_shards(table, shards=shards, bucket_rows=bucket_rows, seed=7).collect()
    assert sorted(order, key=lambda x: x[:2]) != sorted(((r.shard, r.slot, r.doc_id, r.text) for r in other), key=lambda x: x[:2])


def test_orders_are_equally_likely(spark):
    orders = spark.range(6000).select(F.col("id").alias("b")).select(sharding.fisher_yates(F.lit(3), 42, F.col("b")).alias("o")).collect()
    counts = Counter(tuple(r.o) for r in orders)
    assert len(counts) == 6 and all(850 < c < 1150 for c in counts.values())
    long = spark.range(1).select(sharding.fisher_yates(F.lit(500), 42, F.lit(0)).alias("o")).first().o
    assert sorted(long) == list(range(500)) and long != sorted(long)
    assert list(product([0])) and spark.range(1).select(sharding.fisher_yates(F.lit(1), 1, F.lit(0)).alias("o")).first().o == [0]


def test_few_and_no_rows(spark, tmp_path):
    rows, table = docs(spark, 4)
    assert sharding.shuffle_shards(table.limit(0)).collect() == []
    check_places(sharding.shuffle_shards(table.limit(5)).collect(), 16)
    table.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_sharding(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_written_shards_are_in_order(spark, tmp_path):
    _, table = docs(spark, 90)
    sharding.write_shards(table, f"{tmp_path}/out", shards=4, files=2)
    read = []
    for s in range(4):
        files = sorted((tmp_path / "out" / f"shard={s}").glob("*.parquet"))
        assert len(files) == 2
        slots = [pq.read_table(f, columns=["slot"], partitioning=None)["slot"].to_pylist() for f in files]
        assert all(x == sorted(x) for x in slots)
        read += [(s, x) for f in slots for x in f]
    assert len(read) == len(set(read)) == table.count()
