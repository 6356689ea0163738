"""Joins and filters whose heavy keys do not land in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomspark.llm._store import stored
from loomspark.llm._text import blocks

#: Keys of more rows than this may be joined by broadcast, the most frequent MOST_HEAVY of them.
HEAVY, MOST_HEAVY = 1000, 100_000
#: A bit table has at most 2**MOST_BITS bits (64 MB).
MOST_BITS = 29


def split_join(left: DataFrame, right: DataFrame, on: list[str], count: str, *, heavy: int | None = None, most: int = MOST_HEAVY) -> DataFrame:
    """left joined with right on the columns `on`, which are unique in right; count is right's column of the rows of left under a key.

    The `most` most frequent keys of more than `heavy` rows (HEAVY if None) meet left by broadcast, so
    they stay where they are; every other key has at most heavy rows or 1 / most of all rows.
    Both tables are read twice if there are heavy keys: store them before.
    """
    top = right.where(F.col(count) > (HEAVY if heavy is None else heavy)).orderBy(F.desc(count), *on).limit(most)
    top = stored(top, "heavy")
    if top.isEmpty():
        return left.join(right, on)
    keys = F.broadcast(top.select(*on))  # at most `most` rows
    light = left.join(keys, on, "left_anti").join(right.join(keys, on, "left_anti"), on)
    return left.join(F.broadcast(top), on).unionByName(light)


def bit_table(hashes: DataFrame, name: str, *, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bytes of a table with a bit for each value of column `name`, about sixteen bits a value; what it lacks is not among them.

    At most 2**most_bits bits come to the driver; beyond that the table lets more through, and loses nothing.
    """
    size = hashes.agg(F.approx_count_distinct(name)).first()[0]
    bits = min(most_bits, max(16, (16 * size).bit_length()))
    at = F.shiftrightunsigned(name, 64 - bits) + 1  # bit numbers count from 1
    parts = hashes.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for batch in parts.toArrow().to_batches():
        for b, m in zip(batch.column("b").to_pylist(), batch.column("m"), strict=True):
            at = (b - 1) << 12
            table[at : at + 4096] = np.frombuffer(m.as_buffer(), np.uint8)
    return table


def maybe(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes have their bit in the table."""
    at = hashes >> np.uint64(64 - 3 - (len(table).bit_length() - 1))
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def part_rows(rows: DataFrame, hash_of: Column, keys: DataFrame, *, most_bits: int = 27) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among keys, rows that are not): keys holds the same hash of its rows in column h.

    A bit for each hash modulo about sixteen times the keys, in broadcast bitmaps of 4 KB (2**most_bits bits or 16 MB in
    all), decides without a shuffle; what is needless among the first stays correct under a join. Built-in
    functions only; keys is read twice: store it before.
    """
    bits = min(most_bits, max(15, (16 * keys.count()).bit_length()))
    number = lambda h: F.pmod(h, F.lit(1 << bits)) + 1
    own = keys.select(number(F.col("h")).alias("n"))
    table = own.groupBy(F.bitmap_bucket_number("n").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("m"))
    bucket, held = free_name(rows, "bucket"), free_name(rows, "bits")
    table = F.broadcast(stored(table.toDF(bucket, held), "bits"))  # at most 2**(bits - 15) rows of 4 KB
    n = number(hash_of)
    at = F.bitmap_bit_position(n)
    byte = F.conv(F.hex(F.substring(held, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    seen = rows.withColumn(bucket, F.bitmap_bucket_number(n)).join(table, bucket, "left")
    hit = F.coalesce(F.call_function("getbit", byte, (at % 8).cast("int")) == 1, F.lit(False))
    return seen.where(hit).drop(bucket, held), seen.where(~hit).drop(bucket, held)


def filtered(docs: DataFrame, seen: list[Column], names: list[str], keep, text: str | None = None) -> DataFrame:  # noqa: ANN001
    """The rows of docs, with columns of any names, for which keep(blocks of seen) is true; seen (named names, the text among them) is read by keep only.

    text: the column of docs that seen has as "text"; if it holds strings, keep reads it there, nulls as nulls, and texts are not sent twice.
    """
    n = len(docs.columns)
    at = docs.columns.index(text) if text in docs.columns and docs.schema[text].dataType == StringType() else None
    more = [i for i, name in enumerate(names) if name != "text" or at is None]
    place = [at if i not in more else n + more.index(i) for i in range(len(names))]
    both = docs.select("*", *[seen[i].alias(free_name(docs, f"seen{i}")) for i in more])
    plain = both.toDF(*[f"c{i}" for i in range(n + len(more))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.RecordBatch.from_arrays(b.columns[:n], names=[f"c{i}" for i in range(n)])
            done = 0
            for block in blocks(pa.RecordBatch.from_arrays([b.column(i) for i in place], names=names)):
                yield own.slice(done, len(block)).filter(pa.array(keep(block), pa.bool_()))
                done += len(block)

    kinds = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    return plain.mapInArrow(run, kinds).toDF(*docs.columns)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")
