"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or what setCheckpointDir() was given.

    Where neither is set: a folder of this machine if master and executors run on it, as in
    tests; on a cluster an error, since executors would not see each other's files.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if path is None and held.isDefined():
        path = held.get()
    if path is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        context.setCheckpointDir(path)
    return path.rstrip("/")


#: Paths that stored() wrote in the innermost scope() of this thread; none outside of one.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again: its lineage ends here and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """The paths that stored() writes inside; those still in the list at the end, also of a run that fails, are deleted.

    Scopes of other threads, and those around this one, have lists of their own. What is to stay is taken out of the list.
    """
    own: list[str] = []
    token = _made.set(own)
    try:
        yield own
    finally:
        _made.reset(token)
        for path in own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """stored(make(), name), without the tables that make() itself stored and the shuffles of its steps."""
    with scope(spark) as own:
        out = stored(make(), name)
        path = own.pop()
    keep([path])
    release(spark)
    return out


def keep(paths: list[str]) -> None:
    """Hands paths that were taken out of an inner scope to the one around it, if any."""
    if (made := _made.get()) is not None:
        made += paths


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so once the driver collects its garbage, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
