"""Benchmark decontamination by greedy string tiling.

Runs of SEED words of the benchmark items are joined with those of the
documents. For each document and item that share one, running Karp-Rabin
marks the longest common runs of unmarked words: rolling hashes of windows find the
greatest length that both still share, all matches of it are marked, and the length falls
until none of SEED words is left. A document is contaminated by an item of which marked
words cover the given share, in whatever order its passages stand.

A covered item shares at least ceil(share * words / SEED) of its seeds with the
document, so its most frequent seeds, one fewer than that, need not lead to it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._split import HEAVY, bit_table, column, filtered, free_name, maybe
from loomspark.llm._store import stored
from loomspark.llm._text import _W, FOLDED, Words, blocks, longs, mix, split

#: Benchmarks of up to so many bytes of text go to every worker; larger ones are joined by their seeds.
BROADCAST_BYTES = 16 << 20
#: Rows of heavy seeds, and keys of contaminated texts, that may be broadcast.
BROADCAST_ROWS = 200_000
#: Items of fewer words than this are part of ordinary prose: they count only where they are a whole line or a whole text.
LEAST_INSIDE = 3
_U = np.uint64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Row:
    """A sequence of word hashes, the words that are still unmarked, and hashes of its windows."""

    def __init__(self, words: np.ndarray):
        up, self.down = _W.get(len(words) + 1)
        self.words, self.free = words, np.ones(len(words), bool)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(words * up[: len(words)], dtype=_U)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of the windows of n unmarked words."""
        if n > len(self.words):
            return np.empty(0, np.int64), np.empty(0, _U)
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return at, mix((self.sums[at + n] - self.sums[at]) * self.down[at])

    def keep(self, at: np.ndarray, n: int) -> int:
        """Marks what is in none of the windows of n words at the positions; the longest run of unmarked words is returned."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        self.free &= np.cumsum(edge[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], self.free.astype(np.int8), [0]])))
        return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(text position, item position, length) of the greedy tiles of two sequences of word hashes, longest first.

    Of equally long matches the one first in the text, then in the item, is marked
    first. Each length costs a few passes over both sequences, and every length that is tried is marked, so
    time is about (words of both) * sqrt(words of the item) at worst and memory follows the words.
    """
    low = min(least, len(item))
    if not low or len(text) < low:
        return []
    a, b, out = _Row(text), _Row(item), []
    (at, own), (to, other) = a.windows(low), b.windows(low)
    high = min(a.keep(at[np.isin(own, other)], low), b.keep(to[np.isin(other, own)], low))
    while high >= low:
        found, below = None, low
        while below <= high:  # the greatest length that both share: shorter windows of a shared one are shared
            n = (below + high) // 2
            (at, own), (to, other) = a.windows(n), b.windows(n)
            hit = np.isin(own, other)
            if hit.any():
                found, below = (n, at[hit], own[hit], to, other), n + 1
            else:
                high = n - 1
        if found is None:
            break
        n, at, own, to, other = found
        where: dict[int, list[int]] = defaultdict(list)
        for j, h in zip(to[::-1].tolist(), other[::-1].tolist(), strict=True):
            where[h].append(j)
        end = 0
        for i, h in zip(at.tolist(), own.tolist(), strict=True):
            if i < end:
                continue
            ends = where[h]
            while ends and not b.free[ends[-1] : ends[-1] + n].all():
                ends.pop()
            if ends and np.array_equal(text[i : i + n], item[ends[-1] : ends[-1] + n]):
                j, end = ends.pop(), i + n
                a.free[i:end] = b.free[j : j + n] = False
                out.append((i, j, n))
        high = n - 1
    return out


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    mult, h = _U(0x9E3779B97F4A7C15), np.zeros(max(len(words) - n + 1, 0), _U)
    for k in range(n):
        h = h * mult + words[k : k + len(h)]
    return mix(h, n)


def needless(words: int, seed: int, share: float) -> int:
    """How many of the seeds of an item a document that covers it can lack, beside all others."""
    return max(0, ceil(share * words / min(seed, words) - 1e-9) - 1)


@dataclass
class Items:
    """Benchmark items: ids, word hashes, lower-cased texts, and by length the sorted seed hashes with the item of each."""

    ids: list[int]
    words: list[np.ndarray]
    texts: list[bytes]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, table: pa.Table, seed: int, share: float) -> Items:
        ids, words, texts = [], [], []
        for b in table.combine_chunks().to_batches():
            for block in blocks(b):
                w = split(block.column("text"), FOLDED)
                for i, (name, text) in enumerate(zip(block.column("item_id").to_pylist(), block.column("text").to_pylist(), strict=True)):
                    own = w.hash[w.first[i] : w.first[i + 1]]
                    if len(own):
                        ids.append(name)
                        words.append(own.copy())
                        texts.append(text.encode("utf-8", "surrogatepass").lower())
        found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for k, w in enumerate(words):
            found[min(seed, len(w))].append((_runs(w, min(seed, len(w))), k))
        seeds = {}
        for n, some in found.items():
            every, back, often = np.unique(np.concatenate([r for r, _ in some]), return_inverse=True, return_counts=True)
            run, of, at = [], [], 0
            for r, k in some:
                mine = back[at : at + len(r)]
                at += len(r)
                mine = mine[np.argsort(often[mine], kind="stable")][: len(r) - needless(len(words[k]), seed, share)]
                mine = np.unique(mine)
                run.append(every[mine])
                of.append(np.full(len(mine), k, np.int32))
            run, of = np.concatenate(run), np.concatenate(of)
            order = np.argsort(run, kind="stable")
            seeds[n] = run[order], of[order]
        return cls(ids, words, texts, seeds)


def _hits(runs: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Positions of runs among the sorted seeds, behind a bit table."""
    bits = 20
    table = np.zeros(1 << bits, bool)
    table[(seeds >> _U(64 - bits)).astype(np.int64)] = True
    at = np.flatnonzero(table[(runs >> _U(64 - bits)).astype(np.int64)])
    place = np.minimum(np.searchsorted(seeds, runs[at]), len(seeds) - 1)
    return at[seeds[place] == runs[at]]


def _judge(text: np.ndarray, item: np.ndarray, seed: int, share: float, raw: tuple[bytes, bytes]) -> float:
    """Marked words over words of the item; what would count by hashes is compared word by word."""
    marked = tiles(text, item, seed)
    cover = sum(n for *_, n in marked) / len(item)
    if cover < share:
        return cover
    a, b = (_WORD.findall(x) for x in raw)
    if any(a[i : i + n] != b[j : j + n] for i, j, n in marked):  # two words of one hash
        number = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
        marked = tiles(*(mix(np.array([number[w] for w in x], _U)) for x in (a, b)), seed)
    return sum(n for *_, n in marked) / len(item)


def _clean(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))


_OUT = "doc_id long, n_items int, items array<long>, coverage double, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, *, seed: int = 5, share: float = 0.5, text: str = "text", broadcast_bytes: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_items, items (sorted ids that count), coverage (largest of an item that counts, else 0), contaminated.

    benchmark has item_id and text. Words are lower-cased in A-Z. An item counts
    where marked words are at least share of its words; items shorter than seed words
    must stand as a whole, those of under LEAST_INSIDE words as all words of a line (up to a line feed) or of the text; items without words
    match nothing, nor do null or empty texts. Repeated rows repeat; an item repeated
    under one id counts once, null ids of items are left out of items; other columns are
    not read; an empty docs table gives an empty result, an empty benchmark no contamination. The result
    is the same whether the benchmark (up to broadcast_bytes, BROADCAST_BYTES if None) is broadcast or joined.
    """
    items = _clean(benchmark, "item_id", "text")
    rows = _clean(docs, "doc_id", text)
    if _small(items, broadcast_bytes):
        return _local(rows, Items.of(items.dropDuplicates().toArrow(), seed, share), seed, share, _OUT)
    rows = rows.withColumn("row_key", F.md5("text"))
    best = _covers(rows, items, seed, share)
    out = rows.select("doc_id", "row_key").join(best, "row_key", "left")
    none = F.coalesce("items", F.array().cast("array<bigint>"))
    return out.select("doc_id", F.size(none).alias("n_items"), none.alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.col("coverage").isNotNull().alias("contaminated"))


def _small(items: DataFrame, limit: int | None) -> bool:
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return size <= (BROADCAST_BYTES if limit is None else limit)


def _alone(words: Words, n: int) -> np.ndarray:
    """For each word, whether it and the n - 1 words behind it are all words of a line or of a text."""
    count = len(words.hash)
    feeds = np.concatenate([[0], np.cumsum(words.data == 0x0A)])
    edge = np.zeros(count + 1, bool)  # no word of the line stands before this one
    edge[1:count] = feeds[words.start[1:]] > feeds[words.end[:-1]]
    text = np.zeros(count + 1, bool)
    text[words.first] = True
    edge |= text
    at = np.arange(count)
    to = np.minimum(at + n, count)
    within = np.concatenate([[0], np.cumsum(edge)])
    line = edge[:count] & edge[to] & (within[to] - within[at] == 1)
    return (line | text[:count] & text[to]) & (at + n <= count)


def _found(block: pa.RecordBatch, items: Items, seed: int, share: float) -> list[tuple[list[int], float]]:
    """For each text the ids that count (none without ids) and the largest coverage that counts, 0 without any."""
    words = split(block.column("text"), FOLDED)
    pairs: dict[int, set[int]] = defaultdict(set)
    for n, (seeds, of) in items.seeds.items():
        runs = _runs(words.hash, n)
        at = _hits(runs, seeds)
        owner = np.searchsorted(words.first, at, "right") - 1
        inside = at + n <= words.first[owner + 1]
        if n < LEAST_INSIDE:
            inside &= _alone(words, n)[at]
        hit = np.unique(np.stack([owner[inside].astype(_U), runs[at[inside]]]), axis=1)  # a document's repeats count once
        for d, low, high in zip(hit[0].tolist(), np.searchsorted(seeds, hit[1], "left").tolist(), np.searchsorted(seeds, hit[1], "right").tolist(), strict=True):
            pairs[d].update(of[low:high].tolist())
    out: list[tuple[list[int], float]] = [([], 0.0)] * len(block)
    for d, some in pairs.items():
        own = words.hash[words.first[d] : words.first[d + 1]]
        raw = words.data[words.start[words.first[d]] : words.end[words.first[d + 1] - 1]].tobytes().lower()
        cover = {k: c for k in some if (c := _judge(own, items.words[k], seed, share, (raw, items.texts[k]))) >= share}
        if cover:
            out[d] = (sorted({items.ids[k] for k in cover if items.ids[k] is not None}), max(cover.values()))
    return out


def _local(rows: DataFrame, items: Items, seed: int, share: float, schema: str) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(items)  # at most broadcast_bytes of text went in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b):
                found = _found(block, held.value, seed, share)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([len(x) for x, _ in found], pa.int32()), pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.float64()), pa.array([c > 0 for _, c in found], pa.bool_())], ["doc_id", "n_items", "items", "coverage", "contaminated"])

    return rows.mapInArrow(run, schema)


def _covers(rows: DataFrame, items: DataFrame, seed: int, share: float) -> DataFrame:
    """row_key, items, coverage of the texts that some item counts for, with a benchmark of any size.

    A bounded bit table of the items' seeds thins out those of the documents before
    they are shuffled; the seeds that are left are counted, each item gives up its most
    frequent ones (see above), and each pair of texts that meets is tiled on its own row.
    """
    items = items.dropDuplicates().withColumn("item_key", F.md5(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")))
    own = stored(_seeds(items, "item_key", seed, range(1, seed + 1), None, whole=True), "item-seeds")
    lengths = sorted(r[0] for r in own.select("n").distinct().collect())  # at most seed values
    theirs = stored(_seeds(rows, "row_key", seed, lengths, bit_table(own, "run")), "seeds")
    often = theirs.groupBy("n", "run").agg(F.count("*").alias("often"))
    own = own.join(often, ["n", "run"], "left").withColumn("often", F.coalesce("often", F.lit(0)))
    place = Window.partitionBy("item_key")
    spare = F.greatest(F.lit(0), F.ceil(share * F.col("words") / F.col("n") - 1e-9) - 1)
    own = own.withColumn("no", F.row_number().over(place.orderBy("often", "run"))).where(F.col("no") <= F.col("words") - F.col("n") + 1 - spare)
    own = stored(own.where("often > 0").select("n", "run", "often", "item_key").distinct(), "item-seeds")
    heavy = own.where(F.col("often") > HEAVY)
    if 0 < heavy.count() <= BROADCAST_ROWS:  # frequent seeds stay where they are
        keys = F.broadcast(heavy.select("n", "run").distinct())
        rest = theirs.join(keys, ["n", "run"], "left_anti").join(own.where(F.col("often") <= HEAVY), ["n", "run"])
        pairs = theirs.join(F.broadcast(heavy), ["n", "run"]).select("row_key", "item_key").unionByName(rest.select("row_key", "item_key"))
    else:
        pairs = theirs.join(own, ["n", "run"]).select("row_key", "item_key")
    pairs = stored(pairs.distinct(), "pairs")
    texts = rows.join(pairs.select("row_key").distinct(), "row_key", "left_semi").dropDuplicates(["row_key"]).select("row_key", "text")
    texts = texts.join(pairs, "row_key").join(items.select("item_key", "item_id", F.col("text").alias("item")), "item_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cover = []
            for i in range(len(b)):
                raw = [b.column(c)[i].as_py().encode("utf-8", "surrogatepass").lower() for c in ("text", "item")]
                x, y = (split(b.column(c).slice(i, 1), FOLDED).hash for c in ("text", "item"))
                cover.append(_judge(x, y, seed, share, (raw[0], raw[1])))
            yield pa.RecordBatch.from_arrays([b.column("row_key"), b.column("item_id"), pa.array(cover, pa.float64())], ["row_key", "item_id", "cover"])

    judged = texts.select("row_key", "item_id", "text", "item").mapInArrow(run, "row_key string, item_id long, cover double").where(F.col("cover") >= share)
    return judged.groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("cover").alias("coverage"))


def _seeds(df: DataFrame, key: str, seed: int, lengths: list[int] | range, table: np.ndarray | None, *, whole: bool = False) -> DataFrame:
    """(key, n, run, words): seeds of each text; whole: every one of min(seed, words) words, else distinct ones of all lengths that the table has."""
    held = df.sparkSession.sparkContext.broadcast(table)  # 64 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b):
                words = split(block.column("text"), FOLDED)
                size = np.diff(words.first)
                for n in lengths:
                    runs = _runs(words.hash, n)
                    owner = np.searchsorted(words.first, np.arange(len(runs)), "right") - 1
                    good = np.arange(len(runs)) + n <= words.first[owner + 1]
                    good &= np.minimum(size[owner], seed) == n if whole else maybe(held.value, runs)
                    if not whole and n < LEAST_INSIDE:
                        good &= _alone(words, n)[: len(runs)]
                    owner, runs = owner[good], runs[good]
                    if not whole and len(runs):
                        owner, runs = np.unique(np.stack([owner.astype(_U), runs]), axis=1)
                        owner = owner.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([block.column(key).take(pa.array(owner)), pa.array(np.full(len(runs), n, np.int32)), longs(runs), pa.array(size[owner])], [key, "n", "run", "words"])

    return df.select(key, "text").mapInArrow(run, f"{key} string, n int, run long, words long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, seed: int = 5, share: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that contamination() finds clean; each row is judged by its own text, at every size of the benchmark."""
    items = _clean(benchmark, "item_id", "text")
    clean = F.coalesce(column(text).cast("string"), F.lit(""))
    names = docs.columns
    if not _small(items, None):
        key = free_name(docs, "row_key")
        best = _covers(docs.select(clean.alias("text")).withColumn("row_key", F.md5("text")), items, seed, share)
        bad = stored(best.select(F.col("row_key").alias(key)), "contaminated")
        bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
        return docs.withColumn(key, F.md5(clean)).join(bad, key, "left_anti").select(*map(column, names))
    held = docs.sparkSession.sparkContext.broadcast(Items.of(items.dropDuplicates().toArrow(), seed, share))
    return filtered(docs, [clean], ["text"], lambda block: [c == 0 for _, c in _found(block, held.value, seed, share)])
