"""Random order of all records over shards by a two-pass external shuffle. DataFrame functions only.

First pass: each record goes to a bucket by a seeded hash of its content; buckets are so
many that one fits in memory. Second pass: each bucket is an array, shuffled by Fisher-Yates with draws
from a seeded hash of bucket and step, and written behind the buckets before it. Every order of
the records is as likely as any other, and a seed fixes it, whatever the files, partitions or lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._rank import sums_before
from loomspark.llm._split import column, part_rows
from loomspark.llm._store import stored

#: Bounds of a bucket's mean size. The rows bound the steps of a fold that copies an array of numbers.
BUCKET_BYTES, BUCKET_ROWS = 8 << 20, 1024
#: Equal records that one task multiplies.
COPIES = 4096


def draw(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts, joined by colons; never null, so that joins on it need no filter that would compute it twice."""
    return F.coalesce(F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(0))


def record_key(columns: list[str]) -> Column:
    """MD5 of all values as strings, each behind its number of bytes (null: -)."""

    def one(c: str) -> Column:
        s = column(c).cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.md5(F.concat(*map(one, columns)))


def numbered(df: DataFrame, count: str) -> DataFrame:
    """Each row `count` times, with nth from 0: blocks of COPIES are dealt out before they are unrolled."""
    blocks = df.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {COPIES}"))))
    dealt = blocks.repartition("key", "block")
    return dealt.withColumn("nth", F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col(count), (F.col("block") + 1) * COPIES) - 1))).drop("block")


def fisher_yates(n: Column, seed: int, bucket: Column) -> Column:
    """A random order of 0 to n - 1 as an array, built inside out: step i puts i at a drawn place j <= i and what was there at the end."""
    draws = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.pmod(draw(F.lit(f"{seed}:order"), bucket, i), i + 1).cast("int").alias("j")))

    def step(a: Column, x: Column) -> Column:
        i, j = x["i"], x["j"]
        swapped = F.concat(F.slice(a, F.lit(1), j), F.array(i), F.slice(a, j + 2, i - j - 1), F.array(F.get(a, j)))
        return F.when(i == j, F.concat(a, F.array(i))).otherwise(swapped)

    return F.aggregate(draws, F.array().cast("array<int>"), step)


def shuffle_shards(docs: DataFrame, *, shards: int = 16, seed: int = 42, size: Column | None = None, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of docs with all their columns, shard (from 0) and slot (place in the shard, from 0 without gaps), in a random order.

    The random order is cut into `shards` pieces whose row counts differ by one at most. size: bytes of a record for the size of
    buckets; those of all values as strings if none. Nulls in any column, null or repeated
    doc_ids and empty or very long texts are records like others; equal records (a third of all rows,
    perhaps) are counted before they are dealt out, one by one. Fewer rows than shards
    leave shards without rows; an empty table gives an empty result. Columns of docs named shard or slot are replaced.
    """
    bytes_of = sum((F.coalesce(F.octet_length(column(c).cast("string")), F.lit(0)).cast("long") for c in docs.columns), F.lit(0)) if size is None else size
    keyed = docs.select(F.struct(*map(column, docs.columns)).alias("row"), record_key(docs.columns).alias("key"), bytes_of.alias("bytes"))
    groups = stored(keyed.groupBy("key").agg(F.count("*").alias("c"), F.first("bytes").alias("bytes")), "records")
    rows, total = groups.agg(F.sum("c"), F.sum(F.col("c") * F.col("bytes"))).first()
    if not rows:
        return docs.drop("shard", "slot").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    buckets = max(1, -(-total // bucket_bytes), -(-rows // bucket_rows))
    bucket = F.pmod(draw(F.lit(f"{seed}:bucket"), F.col("key"), F.col("nth")), F.lit(buckets))
    # how many records each bucket will hold, and how many stand before them
    copies = groups.where("c > 1")
    light = groups.where("c = 1").select("key", F.lit(0).cast("long").alias("nth")).unionByName(numbered(copies.select("key", "c"), "c").select("key", "nth"))
    offsets = stored(sums_before(light.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows")), "bucket", "rows"), "buckets")
    # first pass: records to their buckets
    some, others = part_rows(keyed, F.xxhash64("key"), copies.select(F.xxhash64("key").alias("h")))
    again = numbered(some.groupBy("key").agg(F.first("row").alias("row"), F.count("*").alias("c")), "c")
    every = others.select("key", F.lit(0).cast("long").alias("nth"), "row").unionByName(again.select("key", "nth", "row"))
    scattered = every.withColumn("bucket", bucket).repartition("bucket")
    # second pass: each bucket in a random order
    held = scattered.groupBy("bucket").agg(F.collect_list(F.struct("key", "nth", "row")).alias("items")).join(offsets.select("bucket", "before"), "bucket")
    fixed = F.array_sort(F.transform("items", lambda x, i: F.struct(x["key"].alias("key"), x["nth"].alias("nth"), i.alias("i"))))
    held = held.select("before", "items", fixed.alias("fixed"), fisher_yates(F.size("items"), seed, F.col("bucket")).alias("order"))
    held = held.select("before", F.posexplode(F.transform("order", lambda k: F.get("items", F.get("fixed", k)["i"])["row"])).alias("pos", "row"))
    place = F.col("before") + F.col("pos")
    shard = F.expr(f"(before + pos) * {shards} div {rows}")
    out = held.select("row", shard.alias("shard"), place.alias("place"))
    slot = F.col("place") - F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")], F.col("shard").cast("int").alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, *, shards: int = 16, files: int = 1, **options) -> None:  # noqa: ANN003
    """Shards as Parquet folders shard=0, shard=1, ... under path, each of `files` files that hold its rows in order of slot."""
    out = stored(shuffle_shards(docs, shards=shards, **options), "shuffled")
    rows = max(1, out.count())
    piece = F.expr(f"cast(shard * {files} + least({files} - 1, slot * {files} div (1 + {rows} div {shards})) as int)")
    out.repartitionById(shards * files, piece).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
