"""Positions of rows in a total order within groups, where a group may hold most rows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._split import free_name
from loomspark.llm._store import stored

#: Numbered rows that share a bin when sums run along the numbers.
BIN = 4096


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df, stored, with position (from 0) and n (rows of the group) in each group; group columns must not be null.

    Rows are dealt by ranges of (group, order), so a large group lies in many parts; a window numbers
    the rows of each part of a group, and the counts of the parts before it are added. Rows that are equal in group and order
    are told apart by a running number, so that they too spread over parts: which of them comes first is
    open. df is read twice, for the ranges' bounds first.
    """
    tie, part = free_name(df, "tie"), free_name(df, "part")
    keys = [F.col(g) for g in group]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys, *order, F.col(tie))
    dealt = stored(dealt.withColumn(part, F.spark_partition_id()), name)
    before, whole = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
    parts = dealt.groupBy(*group, part).agg(F.count("*").alias("rows"))
    parts = parts.select(*group, part, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    parts = stored(parts, f"{name}-parts")
    own = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order, tie)) - 1
    return dealt.join(parts, [*group, part]).withColumn("position", F.col("before") + own).drop("before", tie, part)


def sums_before(df: DataFrame, number: str, amount: str) -> DataFrame:
    """df, one row for each number, with `before`: the sum of amount over all smaller numbers.

    Sums run within bins of BIN numbers, and over the bins: one task sees a BIN-th of the rows.
    """
    upto = lambda w: F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    binned = df.withColumn("bin", F.expr(f"{number} div {BIN}"))
    bins = binned.groupBy("bin").agg(F.sum(amount).alias(amount))
    bins = bins.select("bin", upto(Window.partitionBy(F.lit(0)).orderBy("bin")).alias("of_bins"))
    inside = binned.withColumn("inside", upto(Window.partitionBy("bin").orderBy(number)))
    return inside.join(bins, "bin").withColumn("before", F.col("of_bins") + F.col("inside")).drop("bin", "of_bins", "inside")
