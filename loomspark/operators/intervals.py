"""Closed integer intervals: coalescing, overlap semi-joins, context joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """Unions of overlapping or adjacent intervals of each key (gap: largest distance that still joins).

    Null starts and ends come last and begin nothing: such a row belongs to what stands before it, and one before which no end is known to the first union.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(F.col(start) > reach + gap, 1).otherwise(0))
    numbered = flagged.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlap(s: Column, e: Column, start: Column, end: Column) -> Column:
    return (s <= end) & (e >= start)


def in_scope(findings: DataFrame, ranges: DataFrame | None) -> DataFrame:
    """Findings on changed lines: ranges has rel_path, start, end; a listed file without ranges drops its findings.

    No ranges table: all. A finding without path or line stays; a missing line end is its start.
    The path is an equality key, so this is a hash semi-join with a residual condition.
    """
    if ranges is None:
        return findings
    free = findings.where("rel_path is null or line_start is null")
    r = ranges.select(F.col("rel_path").alias("_p"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = (F.col("rel_path") == F.col("_p")) & overlap(F.col("line_start"), F.coalesce("line_end", "line_start"), F.col("_s"), F.col("_e"))
    return findings.where("rel_path is not null and line_start is not null").join(r, hit, "left_semi").unionByName(free)


def context(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """chunk_id with the sorted rules of the findings that overlap it."""
    f = findings.select(F.col("rel_path").alias("_p"), F.col("line_start").alias("_s"), F.coalesce("line_end", "line_start").alias("_e"), "rule_id")
    hit = (F.col("rel_path") == F.col("_p")) & overlap(F.col("line_start"), F.col("line_end"), F.col("_s"), F.col("_e"))
    return chunks.join(f, hit).groupBy("chunk_id").agg(F.count("*").alias("n_findings"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col(ts).asc_nulls_last(), F.col("event_id").asc_nulls_last())
    late = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp")) > gap_seconds * 1_000_000
    numbered = df.withColumn("session", F.sum(F.when(late, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
