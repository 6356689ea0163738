"""Canonical exact digests of documents.

A text's canonical form is NFKC-normalised, case-folded, normalised again, and
has its white space folded to single blanks. Its fingerprint is the 128-bit
xxh3 of that form. Inside buckets of equal digests the forms are compared byte
by byte with the bucket's smallest document, so a collision gets its own suffix.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._split import column
from loomspark.llm._store import stored

#: Members of a bucket that meet one copy of its smallest document's text in a task.
SPREAD = 2048


def canonical(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def digests(docs: DataFrame) -> DataFrame:
    """docs with columns digest (of text) and row_key (of the text as it is) instead of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), b.column("n_chars"), pa.array(map(digest, texts), pa.string())], ["doc_id", "row_key", "n_chars", "digest"])

    return docs.mapInArrow(run, "doc_id long, row_key long, n_chars long, digest string")


def rows_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row_key, n_chars, text (null: empty) of docs."""
    whole = F.coalesce(column(text).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("text")).select("doc_id", F.xxhash64("text").alias("row_key"), F.length("text").cast("long").alias("n_chars"), "text")


def clashes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(digest, row_key, form) of texts whose canonical form differs from that of their bucket's smallest row.

    Only buckets with different texts are compared: rows of one row_key count
    once, the smallest of the bucket is repeated for every SPREAD members, and no
    bucket's members meet in one task.
    """
    kinds = found.groupBy("digest", "row_key").agg(F.min("doc_id").alias("d"))
    buckets = kinds.groupBy("digest").agg(F.count("*").alias("n"), F.min("row_key").alias("head")).where("n > 1")
    wanted = stored(kinds.join(buckets, "digest").select("digest", "row_key", "n", "head"), "wanted")
    forms = canonical_texts(docs.join(wanted.select("row_key").distinct(), "row_key", "left_semi"))
    own = wanted.join(forms, "row_key").select("digest", "row_key", "n", "form", (F.col("row_key") == F.col("head")).alias("is_head"))
    heads = own.where("is_head").select("digest", F.col("form").alias("head_form"), F.explode(F.sequence(F.lit(0), (F.col("n") / SPREAD).cast("int"))).alias("salt"))
    members = own.where("not is_head").withColumn("salt", F.pmod(F.xxhash64("row_key"), (F.col("n") / SPREAD).cast("int") + 1).cast("int"))
    return members.join(heads, ["digest", "salt"]).where("form <> head_form").select("digest", "row_key", "form")


def suffixes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(digest, row_key, suffix) for the texts that share a digest with a different canonical form."""
    rank = F.dense_rank().over(Window.partitionBy("digest").orderBy("form"))
    return clashes(docs, found).select("digest", "row_key", F.concat(F.lit("-"), rank.cast("string")).alias("suffix")).distinct()


def canonical_texts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row_key"), pa.array([canonical(x) for x in b.column("text").to_pylist()], pa.binary())], ["row_key", "form"])

    return docs.dropDuplicates(["row_key"]).select("row_key", "text").mapInArrow(run, "row_key long, form binary")


def fingerprint_documents(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, row_key, n_chars, fingerprint.

    Equal fingerprints mean byte-equal canonical forms, and the other way
    round. Null texts count as empty and share the fingerprint of the empty
    text; null doc_ids stay; repeated rows repeat; other columns are not
    read; an empty table gives an empty result.
    """
    rows = rows_of(docs, text)
    found = stored(digests(rows), "digests")
    return found.join(suffixes(rows, found), ["digest", "row_key"], "left").select("doc_id", "row_key", "n_chars", F.concat("digest", F.coalesce("suffix", F.lit(""))).alias("fingerprint"))


def _edit(row: dict, lead: str, lead_digest: str) -> dict:
    n = row["n_chars"]
    edited = row["text"][: n - n // 3] + lead[: n // 3]
    return row | {"edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), "edited_digest": digest(edited), "next_digest": lead_digest}


_ROW = "doc_id long, row_key long, n_chars long, digest string, edited_sha256 string, edited_digest string, next_digest string, part int, role string, text string"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _batch(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{c: r.get(c) for c in _NAMES} for r in rows], schema=like)


_SCHEMA = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]]) for x in _ROW.split(", ")])


def neighbours(rows: DataFrame) -> DataFrame:
    """Edits of rows inside each range of ids; a range's first text and last rows come along with the roles head and tail.

    One shuffle of the texts, by range of ids; a task holds the rows of one id at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[dict] = []
        for b in batches:
            out = []
            for row in b.to_pylist():
                row |= {"digest": digest(row["text"]), "part": part, "role": "row"}
                if not held:
                    out.append(row | {"role": "head"})
                elif held[0]["k"] != row["k"]:
                    out += [_edit(x, row["text"], row["digest"]) | {"text": None} for x in held]
                    held = []
                held.append(row)
            yield _batch(out, _SCHEMA)
        yield _batch([x | {"role": "tail"} for x in held], _SCHEMA)

    return rows.repartitionByRange(F.desc("k")).sortWithinPartitions(F.desc("k"), "row_key").mapInArrow(run, _ROW)


def edit_report(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Fingerprints of docs beside those of their edited texts.

    A text's edit replaces its last floor(n_chars / 3) code points by the
    first as many (or all) of the next document by descending doc_id; the last
    document is followed by the first. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. An exact digest is
    like another (1.0) or not (0.0). Null texts are empty. Where a doc_id is
    repeated, each of its rows is followed by the next smaller id, which stands there by
    its text of the smallest hash. Null ids come last. A single id follows itself.
    """
    rows = rows_of(docs, text).withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    found = stored(neighbours(rows), "edits")
    by = Window.orderBy("part")  # one number for each range
    heads = found.where("role = 'head'").select("part", F.col("text").alias("lead"), F.col("digest").alias("lead_digest"))
    order = heads.select("part").withColumn("next", F.coalesce(F.lead("part").over(by), F.first("part").over(by)))
    heads = order.join(heads.withColumnRenamed("part", "next"), "next").drop("next")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([_edit(x, x["lead"], x["lead_digest"]) for x in b.to_pylist()], _SCHEMA)

    tails = found.where("role = 'tail'").join(heads, "part").mapInArrow(ends, _ROW)
    whole = found.where("role = 'row'").unionByName(tails).drop("text", "part", "role")
    suffix = suffixes(rows, whole)
    both = whole.join(suffix, ["digest", "row_key"], "left")
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return both.select("doc_id", "n_chars", "edited_sha256", F.concat("digest", F.coalesce("suffix", F.lit(""))).alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), same("digest", "edited_digest").alias("near_edited"), same("digest", "next_digest").alias("near_next"))
