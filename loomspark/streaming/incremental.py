"""Incremental review: only texts whose key is new are analysed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.plans import line_rules


def cache_key(df: DataFrame, options: str) -> DataFrame:
    """key: hash of the path, the text's hash and the options that shape the findings."""
    return df.withColumn("key", F.sha2(F.to_json(F.struct(F.sha2("source_text", 256).alias("sha"), "rel_path", F.lit(options).alias("options"))), 256))


def unseen(df: DataFrame, cache: DataFrame) -> DataFrame:
    return df.join(cache.select("key").distinct(), "key", "left_anti")


def review_stream(texts: DataFrame, path: str, checkpoint: str, *, options: str = "") -> Callable:
    """Starts a query over a stream of (rel_path, source_text): each batch appends the findings of texts whose key the store lacks.

    Findings and keys of a batch stand in folders named after the query and the batch, which are overwritten whole: a batch that is
    run again, even after a crash between both writes, leaves what one run leaves. Read them with their parent folders.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        own = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or 'query'}-{number}"
        keyed = cache_key(df, options).dropDuplicates(["key"])
        seen = spark.read.schema("key string, batch string").parquet(f"{path}/keys").where(F.col("batch") != own) if _exists(spark, f"{path}/keys") else spark.createDataFrame([], "key string")
        new = unseen(keyed, seen)
        line_rules.findings(new).write.mode("overwrite").parquet(f"{path}/findings/batch={own}")
        new.select("key").write.mode("overwrite").parquet(f"{path}/keys/batch={own}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
