"""Removal of word windows that repeat across documents, behind a count-min prefilter.

1. Every window of WIDTH words is represented in the sketch by its anchor, the
   smallest hash of the GRAM-word runs in it. Equal windows have equal anchors,
   and a document adds one to each of its anchors, so the merged sketch never
   underestimates in how many documents a window starts. Partitions send their
   cells sparsely; a cell's counts are merged in groups of 2**16 cells. A sketch of up to
   MOST_CELLS cells a row is broadcast; a larger one, which follows the corpus too, stays a
   table of cells that the anchors of each document are joined with, row by row.
2. Only windows whose anchor is estimated in two documents or more are grouped
   exactly, by anchor and 64-bit window hash. Neighbouring windows of one
   anchor travel as one segment: copies of a whole segment need one comparison,
   and only distinct segments that share an anchor are opened into windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._split import column, part_rows, split_join
from loomspark.llm._store import stored
from loomspark.llm._text import Words, blocks, longs, mix, split

ROWS, CELL_BLOCK, MOST_CELLS = 2, 1 << 16, 1 << 28
_U = np.uint64


def anchors(words: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, first word, anchor) of every window, in order of position."""
    grams = mix(words.grams(gram), 7)
    span = width - gram + 1
    low, done = grams, 1
    while done < span:
        step = min(done, span - done)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        done += step
    counts = np.diff(words.first)
    each = np.maximum(counts - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), each)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each) + words.first[:-1][doc]
    return doc, at, low[at]


def cells(hashes: np.ndarray, row: int, size: int) -> np.ndarray:
    return (mix(hashes, 0xA5A5 + row * 0x9E37) & _U(size - 1)).astype(np.int64)


def _starts(words: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, anchor), once for each anchor of a text."""
    doc, _, low = anchors(words, width, gram)
    new = np.ones(len(doc), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    doc, low = doc[new], low[new]
    order = np.lexsort((low, doc))
    doc, low = doc[order], low[order]
    new = np.ones(len(doc), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], low[new]


def sketch(docs: DataFrame, size: int, width: int, gram: int) -> list[tuple[int, int, bytes]]:
    """(row, block, bits): which cells of the merged sketch count two documents or more. At most ROWS * size / 8 bytes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for b in batches:
            for block in blocks(b):
                seen.append(_starts(split(block.column("text")), width, gram)[1])
        if not seen:
            return
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        values = np.repeat(values, np.minimum(counts, 2))
        for row in range(ROWS):
            c = np.sort(cells(values, row, size))
            cuts = np.searchsorted(c, np.arange(0, size + 1, CELL_BLOCK))
            some = np.flatnonzero(np.diff(cuts))
            packed = [(c[cuts[k] : cuts[k + 1]] & (CELL_BLOCK - 1)).astype(np.uint16).tobytes() for k in some]
            for i in range(0, len(some), 1024):
                n = len(some[i : i + 1024])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row, np.int32)), pa.array(some[i : i + 1024].astype(np.int32)), pa.array(packed[i : i + 1024], pa.binary())], ["row", "block", "cells"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELL_BLOCK, np.int64)
        for b in batches:
            for x in b.column("cells").to_pylist():
                total += np.bincount(np.frombuffer(x, np.uint16), minlength=CELL_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], ["row", "block", "bits"])

    parts = docs.select("text").mapInArrow(part, "row int, block int, cells binary")
    return [tuple(r) for r in parts.groupBy("row", "block").applyInArrow(merge, "row int, block int, bits binary").collect()]


def repeated(hashes: np.ndarray, rows: list[np.ndarray], size: int) -> np.ndarray:
    hit = np.ones(len(hashes), bool)
    for row, bits in enumerate(rows):
        c = cells(hashes, row, size)
        hit &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return hit


def sketch_size(chars: int) -> int:
    """Cells for a corpus of so many characters: about four for each anchor (8 MB of bits for 2**26)."""
    return max(CELL_BLOCK, 1 << max(0, int(chars) // 24).bit_length())


def repeated_anchors(docs: DataFrame, size: int, width: int, gram: int) -> DataFrame:
    """doc_id, row_key, given: the anchors of each document that a sketch of any size, kept as a table of cells, estimates repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b):
                doc, low = _starts(split(block.column("text")), width, gram)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([block.column("doc_id").take(take), block.column("row_key").take(take), longs(low), *(pa.array(cells(low, row, size)) for row in range(ROWS))], ["doc_id", "row_key", "anchor", *(f"cell{row}" for row in range(ROWS))])

    left = docs.select("doc_id", "row_key", "text").mapInArrow(run, ", ".join(["doc_id long, row_key long, anchor long", *(f"cell{row} long" for row in range(ROWS))]))
    for row in range(ROWS):
        left = stored(left, "anchors")
        often = left.groupBy(f"cell{row}").agg(F.count("*").alias("c")).where("c > 1")
        left = split_join(left, stored(often, "cells"), [f"cell{row}"], "c").drop("c")
    return left.groupBy("doc_id", "row_key").agg(F.collect_set("anchor").alias("given"))


_SEGMENTS = "anchor long, seg long, doc_id long, row_key long, at int, n int, windows binary"


def segments(docs: DataFrame, size: int, width: int, gram: int) -> DataFrame:
    """Runs of windows with one anchor that the sketch estimates repeated, with the hashes of their windows."""
    docs = docs.where("doc_id is not null").select("doc_id", "row_key", "text")
    small = size <= MOST_CELLS
    held = docs.sparkSession.sparkContext.broadcast(sketch(docs, size, width, gram) if small else None)
    if not small:
        docs = docs.join(repeated_anchors(docs, size, width, gram), ["doc_id", "row_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _unpacked(held, size) if small else []
        for b in batches:
            for block in blocks(b):
                words = split(block.column("text"))
                doc, at, low = anchors(words, width, gram)
                if not len(doc):
                    continue
                if small:
                    hit = repeated(low, rows, size)
                else:
                    given = block.column("given")
                    ends = np.searchsorted(doc, np.arange(len(block) + 1))
                    hit = np.concatenate([np.isin(low[a:z].view(np.int64), given[i].values.to_numpy()) for i, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True))])
                doc, at, low = doc[hit], at[hit], low[hit]
                if not len(doc):
                    continue
                new = np.ones(len(doc), bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(doc)))
                windows = words.grams(width)[at]
                keyed = mix(windows, 0x51) * (np.arange(len(doc)) - np.repeat(first, n) + 1).astype(_U)
                seg = mix(np.add.reduceat(keyed, first) + n.astype(_U))
                raw = windows.tobytes()
                packed = [raw[8 * i : 8 * (i + k)] for i, k in zip(first.tolist(), n.tolist(), strict=True)]
                take = pa.array(doc[first])
                local = (at[first] - words.first[doc[first]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([longs(low[first]), longs(seg), block.column("doc_id").take(take), block.column("row_key").take(take), pa.array(local), pa.array(n.astype(np.int32)), pa.array(packed, pa.binary())], ["anchor", "seg", "doc_id", "row_key", "at", "n", "windows"])

    return docs.mapInArrow(run, _SEGMENTS)


_CACHE: dict = {}


def _unpacked(held, size: int) -> list[np.ndarray]:
    key = id(held.value)
    if _CACHE.get("key") != key:
        rows = [np.zeros(size // 8, np.uint8) for _ in range(ROWS)]
        for row, block, bits in held.value:
            rows[row][block * CELL_BLOCK // 8 : (block + 1) * CELL_BLOCK // 8] = np.frombuffer(bits, np.uint8)
        _CACHE.update(key=key, rows=rows)
    return _CACHE["rows"]


def opened(rows: DataFrame) -> DataFrame:
    """(anchor, window, doc_id, row_key, at) of each window of rows' segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.asarray(b.column("n"), dtype=np.int64)
            if not len(n):
                continue
            index = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
            take = pa.array(index)
            windows = np.frombuffer(b"".join(b.column("windows").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("anchor").take(take), pa.array(windows), b.column("doc_id").take(take), b.column("row_key").take(take), pa.array((np.asarray(b.column("at"))[index] + step).astype(np.int32))], ["anchor", "window", "doc_id", "row_key", "at"])

    return rows.mapInArrow(run, "anchor long, window long, doc_id long, row_key long, at int")


def repeats(docs: DataFrame, *, width: int = 50, gram: int = 25) -> DataFrame:
    """(doc_id, row_key, at, n): runs of n windows from word at on that also start in a document with a smaller doc_id."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    seg = stored(segments(docs, sketch_size(chars), width, gram), "segments")
    light = seg.select("anchor", "seg", "doc_id", "row_key", "at", "n")
    first = light.groupBy("anchor", "seg").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.count("*").alias("c"))
    first = stored(first, "first")
    # 1: a whole segment that a smaller document has too
    whole = split_join(light, first.where("d0 < d1").select("anchor", "seg", "d0", "c"), ["anchor", "seg"], "c").where("doc_id > d0").select("doc_id", "row_key", "at", "n")
    # 2: windows of the smallest document of each segment, where an anchor has several segments
    several = first.groupBy("anchor").agg(F.count("*").alias("k"), F.min("d0").alias("lo"), F.max("d0").alias("hi")).where("k > 1 and lo < hi").select("anchor", "k")
    heads = split_join(first, stored(several, "several"), ["anchor"], "k").select("anchor", "seg", F.col("d0").alias("doc_id"))
    open_ = stored(opened(seg.join(heads, ["anchor", "seg", "doc_id"], "left_semi")), "windows")
    least = open_.groupBy("anchor", "window").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.count("*").alias("c")).where("d0 < d1").select("anchor", "window", "d0", "c")
    single = split_join(open_, stored(least, "least"), ["anchor", "window"], "c").where("doc_id > d0").select("doc_id", "row_key", "at", F.lit(1).alias("n"))
    return whole.unionByName(single)


def dedup_substrings(docs: DataFrame, *, width: int = 50, gram: int = 25, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (kept words joined by blanks).

    A word goes if a window of width words around it also starts, with the same
    words, in a document with a smaller doc_id; all windows are judged on the
    input. Repeats inside one document, and rows that share a doc_id, remove
    nothing of each other. Null texts have no words; rows with a null doc_id stay whole and
    remove nothing. Other columns are not read; an empty table gives an empty result.
    """
    whole = F.coalesce(column(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("text")).withColumn("row_key", F.xxhash64("text"))
    gone = repeats(rows, width=width, gram=gram).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    gone = stored(gone, "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b):
                words = split(block.column("text"))
                data, n_words, n_removed, texts = words.data, [], [], []
                for i, spans in enumerate(block.column("gone").to_pylist()):
                    a, z = int(words.first[i]), int(words.first[i + 1])
                    keep = np.ones(z - a, bool)
                    if spans:
                        edge = np.zeros(z - a + 1, np.int64)
                        for s in spans:
                            edge[s["at"]] += 1
                            edge[s["at"] + s["n"] + width - 1] -= 1
                        keep = np.cumsum(edge[:-1]) == 0
                    index = np.flatnonzero(keep) + a
                    n_words.append(z - a)
                    n_removed.append(z - a - len(index))
                    texts.append(joined(data, words.start[index], words.end[index]))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    # only texts that lose words are shuffled whole
    some, others = part_rows(rows, F.xxhash64("doc_id", "row_key"), gone.select(F.xxhash64("doc_id", "row_key").alias("h")))
    none = F.lit(None).cast(gone.schema["gone"].dataType).alias("gone")
    both = some.join(gone, ["doc_id", "row_key"], "left").select("doc_id", "text", "gone").unionByName(others.select("doc_id", "text", none))
    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The byte runs [start, end) of data, joined by one blank."""
    if not len(start):
        return b""
    raw = data[start[0] : end[-1]].tobytes()
    base = int(start[0])
    return b" ".join([raw[a:z] for a, z in zip((start - base).tolist(), (end - base).tolist(), strict=True)])


def digest_of(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
