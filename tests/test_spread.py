import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomspark.frontend import nodes as N


def test_parsing_is_spread_beyond_the_splits_of_its_table(spark, tmp_path, monkeypatch):
    """One row group makes one split; the sources are dealt to more tasks, and no file is parsed twice or left out."""
    monkeypatch.setattr(N, "TASK_CHARS", 500)
    spark.range(300).select(F.concat(F.lit("f"), "id").alias("rel_path"), F.concat(F.lit("a("), "id", F.lit(")")).alias("source_text")).coalesce(1).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    assert files.rdd.getNumPartitions() == 1 and sum(pq.ParquetFile(f).num_row_groups for f in tmp_path.glob("files/*.parquet")) == 1
    parsed = N.parsed(files).select("rel_path", "type", F.spark_partition_id().alias("task"))
    assert parsed.select("task").distinct().count() > 1
    assert sorted(r.rel_path for r in parsed.where("type = 'Program'").collect()) == sorted(f"f{i}" for i in range(300))
    assert N.parsed(files.limit(0)).count() == 0
