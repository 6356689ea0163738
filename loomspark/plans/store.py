"""Tables written to the folder that driver and executors share, which cut the lineage of iterative plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in spark.checkpoint.dir, read again; or where setCheckpointDir() points.

    Where neither is set: a folder of this machine if all runs on it, as in tests; on a cluster an error.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if root is None and held.isDefined():
        root = held.get()
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(root or 'file:///tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
