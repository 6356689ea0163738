"""Mixing sources to target weights over a tree of domain, language and source. DataFrame functions only.

A token budget runs down the tree. Each node deals its share to its children in
proportion to their weights; a child whose whole stock (its tokens times the allowed epochs)
is smaller takes that, and what it lacks goes to its siblings first. A node
passes on less than its share only if all below it is used up, so shortages reach
an ancestor's children last. Each leaf takes whole epochs, and of one more epoch, in
the order of seeded hashes, the longest prefix of documents within its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._split import column, split_join
from loomspark.llm._store import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Leaves whose shares go to every worker (a hundred bytes each).
BROADCAST_LEAVES = 100_000
#: Order keys have 60 bits; their first 12 name the bucket that prefix sums run over.
BUCKET_SHIFT = 48


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits of the MD5 of seed, epoch and doc_id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def deal(nodes: DataFrame, parents: list[str], budget: str) -> DataFrame:
    """nodes (weight, cap, and their parent's budget) with share: water filling among the children of each parent."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    order = by.orderBy(F.col("cap") / F.col("weight"), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    out = nodes.where("weight > 0 and cap > 0")
    out = out.withColumn("left_over", big(budget) - F.coalesce(F.sum(big("cap")).over(before), F.lit(0))).withColumn("w_rest", F.sum("weight").over(rest))
    out = out.withColumn("full", F.col("cap").cast("decimal(19,0)") * F.col("w_rest").cast("decimal(18,0)") <= F.col("weight").cast("decimal(18,0)") * F.col("left_over").cast("decimal(19,0)"))
    open_ = lambda c: F.sum(F.when(~F.col("full"), c)).over(by)
    out = out.withColumn("w_open", open_(F.col("weight"))).withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), big("cap"))).over(by), F.lit(0)))
    part = F.expr(f"(cast(weight as decimal(18,0)) * cast(cast({budget} as decimal(20,0)) - spent as decimal(19,0))) div cast(w_open as decimal(18,0))")
    return out.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(part, F.lit(0).cast("long")))).drop("left_over", "w_rest", "full", "w_open", "spent")


def leaf_shares(leaves: DataFrame, levels: list[str], budget: Column, max_epochs: int) -> DataFrame:
    """leaves (the levels' columns, w_<level>, stock) with share, the tokens that each may spend."""
    cap = leaves.withColumn("cap", F.col("stock") * max_epochs)
    found = leaves.agg(budget.cast("long").alias("share"))
    above: list[str] = []
    for level in levels:
        path = [*above, level]
        nodes = cap.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"w_{level}").cast("long").alias("weight")).withColumn("name", F.col(level))
        up = found.select(*above, F.col("share").alias("budget"))
        nodes = nodes.join(up, above) if above else nodes.crossJoin(F.broadcast(up))  # one row: the root
        found = deal(nodes, above, "budget").select(*path, "share")
        above = path
    return leaves.join(found, levels).select(*levels, "stock", "share")


def mix(docs: DataFrame, levels: dict[str, tuple[Column, Column]], *, budget: Column | None = None, max_epochs: int = 4, seed: int = 42, text: str = "text", epoch: str = "epoch", tokens: Column | None = None) -> DataFrame:
    """Rows of docs, once for each epoch they are chosen in, with all their columns, epoch (from 1), n_tokens and the levels (as mix_<level>).

    tokens: how many tokens a row has, for example a column that count_tokens gave; its words if none (null: 0). levels: for each level from the top, its name column (nulls become '') and its
    whole-number weight; a node's weight is the largest among its rows. budget: tokens, as an aggregate over sum(stock) of
    the leaves; half of all tokens if none. Nodes of no weight or no tokens get
    nothing, texts without words and null texts are never chosen, rows of one doc_id and leaf stand or fall
    together, a null doc_id sorts first. Shares are rounded down, so a level leaves less than one token for each
    child. Columns of docs with the names that are added are replaced. An empty table gives an empty result.

    Leaves meet in tables of one row each, documents only in 4096 buckets of each
    leaf, of which one is ordered. The largest leaves meet their documents by broadcast, so their texts are not
    shuffled; nor are any if there are at most BROADCAST_LEAVES.
    """
    names = list(levels)
    clean = F.coalesce(column(text).cast("string"), F.lit(""))
    counted = n_words(clean) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    added = [epoch, "n_tokens", *[f"mix_{n}" for n in names]]
    row = F.struct(*map(column, docs.columns))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("d"), counted.alias("tokens"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, (c, _) in levels.items()], *[F.coalesce(w.cast("long"), F.lit(0)).alias(f"w_{n}") for n, (_, w) in levels.items()])
    rows = rows.where("tokens > 0")
    light = stored(rows.groupBy(*names, "d").agg(F.sum("tokens").alias("tokens"), *[F.max(f"w_{n}").alias(f"w_{n}") for n in names]), "stock")
    leaves = light.groupBy(*names).agg(F.sum("tokens").alias("stock"), F.count("*").alias("n_docs"), *[F.max(f"w_{n}").alias(f"w_{n}") for n in names])
    leaves = stored(leaves, "leaves")
    shares = leaf_shares(leaves, names, F.expr("sum(stock) div 2") if budget is None else budget, max_epochs)
    shares = shares.join(leaves.select(*names, "n_docs"), names)
    shares = stored(shares.select(*names, "n_docs", F.expr("share div stock").alias("full"), F.expr("share % stock").alias("rest")), "shares")
    few = shares.count() <= BROADCAST_LEAVES
    beside = lambda many, one: many.join(F.broadcast(one), names) if few else split_join(many, one, names, "n_docs")
    # where the prefix of each leaf's next epoch ends
    keyed = beside(light.select(*names, "d", "tokens"), shares).withColumn("u", order_key(seed, F.col("full") + 1, F.col("d"))).withColumn("bucket", F.shiftright("u", BUCKET_SHIFT))
    keyed = stored(keyed.select(*names, "d", "tokens", "rest", "u", "bucket"), "keys")
    sums = keyed.groupBy(*names, "bucket").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = sums.where("before <= rest and before + t > rest").select(*names, "bucket", "before")  # one bucket of each leaf
    inside = keyed.join(cut, [*names, "bucket"]).withColumn("upto", F.sum("tokens").over(Window.partitionBy(*names).orderBy("u", "d").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before"))
    last = inside.where("upto <= rest").groupBy(*names).agg(F.max(F.struct("u", "d")).alias("last"))
    ends = shares.join(cut.select(*names, "bucket"), names, "left").join(last, names, "left")
    ends = stored(ends.select(*names, "n_docs", "full", F.coalesce(F.shiftleft(F.col("bucket").cast("long"), BUCKET_SHIFT), F.lit(2**60)).alias("from_u"), "last"), "ends")
    chosen = beside(rows, ends).withColumn("u", order_key(seed, F.col("full") + 1, F.col("d")))
    more = (F.col("u") < F.col("from_u")) | F.coalesce(F.struct("u", "d") <= F.col("last"), F.lit(False))
    copies = F.col("full") + F.when(more, 1).otherwise(0)
    chosen = chosen.withColumn("copies", copies.cast("int")).where("copies > 0").withColumn("_e", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return chosen.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], F.col("_e").alias(epoch), F.col("tokens").alias("n_tokens"), *[F.col(n).alias(f"mix_{n}") for n in names])
