"""Order-dependent operators: suffixes, firsts, eviction, the budget gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffixed(df: DataFrame, name: str, *order: str) -> DataFrame:
    """unique_id: name for its first row, name-n for the n-th."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("unique_id", F.when(n == 1, F.col(name)).otherwise(F.concat_ws("-", name, n.cast("string"))))


def first_per(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    whole = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(whole.alias("_x")).select(*keys, "_x.*")


def evicted(df: DataFrame, keep: int, key: str, written: str) -> DataFrame:
    """Rows beyond the keep most recently written. The keep newest are a bounded top-k; the rest is an anti-join."""
    newest = df.orderBy(F.desc(written), key).limit(keep).select(key)
    return df.join(newest, key, "left_anti")


#: Rows of a group that a fold appends to one by one; larger groups are folded in such blocks.
FOLD = 256


def budget_gate(df: DataFrame, group: str, order: str, *, max_requests: int, max_cost: float, max_tokens: int, tokens: str, cost: str) -> DataFrame:
    """Each row with decision: accepted, or in the order they are checked max-requests-reached (sticky), chunk-exceeds-max-tokens (not sticky), max-cost-exceeded (sticky).

    A sequential fold over each group's ordered array, block by block; rejected rows accrue nothing, and a row
    without a known cost is never stopped by cost.
    """
    none = F.array().cast("array<string>")
    state = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("c"), F.lit(None).cast("string").alias("stop"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        over = F.coalesce(acc["stop"], F.when(acc["n"] >= max_requests, "max-requests-reached"))
        big = F.when(x["tokens"] > max_tokens, "chunk-exceeds-max-tokens")
        dear = F.when(acc["c"] + x["cost"] > max_cost, "max-cost-exceeded")
        said = F.coalesce(over, big, dear, F.lit("accepted"))
        ok = said == "accepted"
        stop = F.coalesce(over, F.when(big.isNull(), dear))
        return F.struct((acc["n"] + ok.cast("int")).alias("n"), (acc["c"] + F.when(ok, F.coalesce(x["cost"], F.lit(0.0))).otherwise(0.0)).alias("c"), stop.alias("stop"), F.concat(acc["out"], F.array(said)).alias("out"))

    def block(acc: Column, k: Column) -> Column:
        begin = F.struct(acc["n"].alias("n"), acc["c"].alias("c"), acc["stop"].alias("stop"), none.alias("out"))
        done = F.aggregate(F.slice(F.col("xs"), k * FOLD + 1, F.lit(FOLD)), begin, step)
        joined = F.transform(F.array(done), lambda d: F.struct(d["n"].alias("n"), d["c"].alias("c"), d["stop"].alias("stop"), F.concat(acc["out"], d["out"]).alias("out")))
        return F.get(joined, F.lit(0))

    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).alias("tokens"), F.col(cost).cast("double").alias("cost")))).alias("xs"))
    blocks = F.sequence(F.lit(0), F.ceil(F.size("xs") / FOLD).cast("int") - 1)
    told = rows.select(group, F.explode(F.arrays_zip("xs", F.aggregate(blocks, state, block, lambda a: a["out"]).alias("said"))).alias("z"))
    return told.select(group, F.col("z.xs.o").alias(order), F.col("z.said").alias("decision"))
