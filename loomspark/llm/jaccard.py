"""Exact Jaccard self-join of shingle sets by PartEnum signatures.

Sizes fall into bands [l, floor(l / t)]. Linked sets lie in one band or in
neighbours, and differ in at most k = floor(r * (1 - t) / t) shingles for the upper
bound r of the lower band. Each band instance deals the shingle domain into
n1 >= (k + 1) / 2 first-level parts of two second-level parts; one first-level
part holds at most one of k differences, so after leaving out one of its
second-level parts the rest is equal in both sets. The signatures are the
hashes of these subsets; sets that share none are not linked. A set with more
than k subsets that are not empty signs only those: k differences cannot touch
them all. SPARE parts more than needed make nearly every set one of these. Shingles that
are common in a sample stay out of the subsets; a set that then has too few left also signs with
all its shingles, so two such sets meet there.

Sets with a shared signature form families. Small families are compared in
one task. Chance signatures chain families the more, the more documents there are, so a very large one is first cut
into finer ones: of each set a short print of parity bits meets those of like sizes, and as two prints differ in no more bits than
their sets do in shingles, those that can link stay together. In a large one every set is then compared with a pivot, the member most like
the shingles that most members have; what links with it is one group already, and only the
others are compared with all, by pairs of bounded blocks of like sizes. Common shingles are counted exactly,
and tasks return spanning links only, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._split import bit_table, column, free_name, maybe, part_rows, split_join
from loomspark.llm._store import keep, release, scope, stored, stored_alone
from loomspark.llm._text import FOLDED, Words, blocks, longs, mix, split
from loomspark.llm.components import BLOCK_EDGES, components, lowest

SPARE = 1.1
COMMON_OF, COMMON_IN, COMMON_MOST = 10_000, 4, 1 << 17
#: Shingles and documents of a block of a large family, about; one document at least.
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 19, 2048
#: Families of more shingles or documents are cut by the prints of their sets before sets meet.
FINE_SHINGLES, FINE_DOCS = 4 * BLOCK_SHINGLES, 4 * BLOCK_DOCS
#: Bytes and prints of a block of a very large family, about.
PRINT_BYTES, PRINT_DOCS = 1 << 21, 1 << 14
#: Members of a family that meet one copy of its pivot in a task.
SPREAD = 2048
#: Passes in which sets meet by their signatures, each with its share of them, so that the shuffles of one are gone before the next.
PASSES = 6
_U = np.uint64


def bands(up_to: int, part: int, whole: int) -> list[tuple[int, int, int]]:
    """(l, r, k) of the bands up to a set size, for the threshold part / whole."""
    out, low = [], 1
    while low <= up_to:
        high = low * whole // part
        out.append((low, high, high * (whole - part) // part))
        low = high + 1
    return out


class Signer:
    def __init__(self, part: int, whole: int):
        self.part, self.whole, self.bands = part, whole, []

    def band(self, size: int) -> int:
        while not self.bands or self.bands[-1][1] < size:
            self.bands = bands(max(1024, 2 * size), self.part, self.whole)
            self.lows = np.array([b[0] for b in self.bands])
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def signatures(self, shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Of the set's own band instance and of the one below; common shingles, which may be any fixed set, sign nothing."""
        band = self.band(len(shingles))
        rare = shingles[~among(shingles, common)]
        return np.concatenate([self.instance(shingles, rare, b) for b in (band, band - 1) if b >= 0])

    def instance(self, every: np.ndarray, rare: np.ndarray, band: int) -> np.ndarray:
        k = self.bands[band][2]
        salt = 0xBA4D + 2 * band + 1
        if k == 0:
            return mix(np.array([np.add.reduce(mix(every, 3), dtype=_U)], _U), salt)
        signed, full = self.subsets(rare, k, salt)
        if full.sum() > k:
            return signed[full]
        # too few: a set that signs enough by its rare shingles is met there, another one that does not by all shingles
        whole, some = self.subsets(every, k, salt + 0x10000000)
        return np.concatenate([signed[full], whole[some] if some.sum() > k else whole])

    @staticmethod
    def subsets(shingles: np.ndarray, k: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the subsets, and which are not empty."""
        n1 = ceil(SPARE * (k + 1) / 2)
        place = ((mix(shingles, 5) >> _U(32)) * _U(2 * n1) >> _U(32)).astype(np.int64)
        parts = np.zeros(2 * n1, _U)
        np.add.at(parts, place, mix(shingles, 3))
        # subset of each first-level part: what is left without one of its two second-level parts
        left = parts.reshape(n1, 2)[:, ::-1].ravel()
        return mix(mix(left, salt) + np.arange(2 * n1, dtype=_U) * _U(0x9E3779B97F4A7C15)), left != 0


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array known."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def common_shingles(rows: DataFrame, size: int) -> np.ndarray:
    """Shingles of COMMON_IN documents or more among COMMON_OF documents (those of the smallest hash of doc_id), the most frequent COMMON_MOST.

    Leaving one fixed set of shingles out of every set never adds differences, so
    whatever this returns, no link is lost; it keeps shared passages from making families.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets(split(block.column("text"), FOLDED), size), np.empty(0, _U)]).view(np.int64))], ["s"])

    ids = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(COMMON_OF)
    found = rows.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON_IN)
    top = found.orderBy(F.desc("c"), "s").limit(COMMON_MOST).toArrow().column("s").combine_chunks()
    return np.sort(top.to_numpy().view(_U)) if len(top) else np.empty(0, _U)


def sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one has none."""
    grams = words.grams(size)
    out = []
    for a, z in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if z - a >= size:
            out.append(np.unique(grams[a : z - size + 1]))
        else:
            out.append(np.array([words.span(a, z)] if z > a else [], _U))
    return out


def profiles(docs: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signatures by pass (s0, s1 ...)."""
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))  # 1 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(part, whole)
        for b in batches:
            for block in blocks(b):
                found = sets(split(block.column("text"), FOLDED), size)
                signed = [signer.signatures(s, held.value) if len(s) else s for s in found]
                owner = np.repeat(np.arange(len(signed)), [len(s) for s in signed])
                values = np.concatenate([*signed, np.empty(0, _U)])
                turn = values % _U(PASSES)
                parts = []
                for k in range(PASSES):
                    ends = np.concatenate([[0], np.cumsum(np.bincount(owner[turn == k], minlength=len(signed)))])
                    parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), longs(values[turn == k])))
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), block.column("row_key"), pa.array([len(s) for s in found], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), *parts],
                    ["doc_id", "row_key", "n_shingles", "digest", *names],
                )

    names = [f"s{k}" for k in range(PASSES)]
    return docs.mapInArrow(run, "doc_id long, row_key long, n_shingles long, digest binary, " + ", ".join(f"{n} array<long>" for n in names))


def links(left: list[np.ndarray], right: list[np.ndarray] | None, part: int, whole: int) -> list[tuple[int, int]]:
    """Spanning links among left, or between left and right (whose indices follow left's): enough to join whatever links join.

    Memory follows the shingles and the product of both sides' documents, which blocks bound.
    """
    every = left + (right or [])
    sizes = np.array([len(s) for s in every])
    values = np.concatenate(every)
    owner = np.repeat(np.arange(len(every)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    number, owner = (np.cumsum(shared) - 1)[number][shared[number]], owner[shared[number]]
    rows, split_at = (len(left), len(left)) if right is not None else (len(every), 0)
    common = np.zeros((rows, len(every) - split_at), np.float32)
    width = 2048
    for low in range(0, int(shared.sum()), width):
        a, z = np.searchsorted(number, [low, low + width])
        dense = np.zeros((len(every), min(width, int(shared.sum()) - low)), np.float32)
        dense[owner[a:z], number[a:z] - low] = 1
        common += dense[:rows] @ dense[split_at:].T
    near = np.zeros((len(every), len(every)), bool)
    both = common.astype(np.int64)
    near[:rows, split_at:] = (whole * both >= part * (sizes[:rows, None] + sizes[None, split_at:] - both)) & (both > 0)
    near |= near.T
    out, open_ = [], np.ones(len(every), bool)
    for start in range(len(every)):  # breadth first: each document is entered once
        if not open_[start]:
            continue
        open_[start], front = False, [start]
        while front:
            x = front.pop()
            found = np.flatnonzero(near[x] & open_)
            open_[found] = False
            out += [(x, y) for y in found.tolist()]
            front += found.tolist()
    return out


def _verify(part: int, whole: int):
    """For the members of one family or pair of blocks; side tells the two blocks apart (all of one side: one block alone)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, side = np.asarray(table.column("doc_id")), np.asarray(table.column("side"))
        cells = table.column("s").combine_chunks()
        ends, flat = np.asarray(cells.offsets), np.asarray(cells.values).view(_U)
        found = [flat[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
        made = links([found[i] for i in one], [found[i] for i in two] if len(two) else None, part, whole)
        at = ids[np.concatenate([one, two])]
        pairs = np.array(made, np.int64).reshape(-1, 2)
        return pa.table({"a": at[pairs[:, 0]], "b": at[pairs[:, 1]]})

    return run


def shingle_components(docs: DataFrame, *, size: int = 3, part: int = 90, whole: int = 100, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are lower-cased in A-Z; two documents link if whole * |A and B| >=
    part * |A or B|, sets being compared by 64-bit shingle hashes. component_id is
    the smallest doc_id that links reach. Texts without words, null texts and null
    doc_ids link with nothing. Repeated rows repeat; rows that share a doc_id are one
    node. Other columns are not read; an empty table gives an empty result.
    """
    clean = F.coalesce(column(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean.alias("text")).withColumn("row_key", F.xxhash64("text"))
    spark = docs.sparkSession
    with scope(spark) as made:  # signatures are dropped once families are known
        full = stored(profiles(rows, size, part, whole), "profiles")
        kept_from = len(made)
        seen = stored(full.select("doc_id", "row_key", "n_shingles", "digest"), "sizes")
        heads, twins, family = _families(full.where("n_shingles > 0 and doc_id is not null"))
        later = made[kept_from:]
        del made[kept_from:]
    keep(later)
    release(spark)
    # documents of one set, and one doc_id with several sets, are one node; stored, so that no task has Python workers of both steps
    pairs = stored(_links(rows, heads, family, size, part, whole).unionByName(twins), "pairs")
    roots = components(pairs)
    return seen.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def _families(live: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored: the smallest document of each set; (a, b), a set's other documents b with that one; the families (node, root) of sets that share a signature."""
    heads = stored(live.groupBy("digest").agg(F.min(F.struct("doc_id", "row_key", "n_shingles")).alias("h")).select("digest", "h.*"), "heads")
    # copies of a set give way to its smallest document
    copies = live.groupBy("digest").agg(F.count("*").alias("c"))
    twins = live.select("digest", "doc_id").distinct()
    twins = split_join(stored(twins, "nodes"), heads.join(copies, "digest").select("digest", F.col("doc_id").alias("a"), "c"), ["digest"], "c")
    twins = stored(twins.where("doc_id <> a").select("a", F.col("doc_id").alias("b")), "twins")
    # each signature's first document stands for the others; the running frame keeps one row of a hot signature in memory
    # a bit table keeps most copies out without a shuffle of signatures; one that stays is linked with its set's first document anyway
    own, _ = part_rows(live, F.xxhash64("doc_id", "row_key"), heads.select(F.xxhash64("doc_id", "row_key").alias("h")))
    first = F.first("doc_id").over(Window.partitionBy("sig").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    stars = []
    for k in range(PASSES):
        signed = own.select("doc_id", F.explode(f"s{k}").alias("sig"))
        stars.append(stored(signed.select(first.alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct(), "star"))
        release(live.sparkSession)
    star = reduce(DataFrame.unionByName, stars)
    return heads, twins, stored_alone(star.sparkSession, lambda: components(star), "families")


def without_copies(docs: DataFrame, *, size: int = 5, part: int = 80, whole: int = 100, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which each group that links reach keeps one, that of the smallest doc_id.

    Groups are those of shingle_components. Rows that share a doc_id, or have none, are told apart: they
    are numbered in the order of doc_id (nulls last) and of the hashes of their texts and other columns. Null and empty texts
    stay; so does one of several equal rows, if it has words. Only texts near a removed one's hash are shuffled.
    """
    key = free_name(docs, "row_number")
    doc_id = column("doc_id").cast("long")
    if docs.groupBy(doc_id.alias("d")).count().where("count > 1 or d is null").isEmpty():
        rows = docs.withColumn(key, doc_id)
    else:
        order = docs.orderBy(doc_id.asc_nulls_last(), F.xxhash64(column(text)), F.xxhash64(*map(column, docs.columns)))
        rows = stored(order.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = lambda: shingle_components(rows.select(column(key).alias("doc_id"), column(text).alias("text")), size=size, part=part, whole=whole)
    gone = stored_alone(docs.sparkSession, lambda: found().where("component_id <> doc_id").select(F.col("doc_id").alias(key)), "copies")
    some, others = part_rows(rows, F.xxhash64(key), gone.select(F.xxhash64(key).alias("h")))
    return some.join(gone, key, "left_anti").unionByName(others).select(*map(column, docs.columns))


def _sets(rows: DataFrame, member: DataFrame, size: int) -> DataFrame:
    """member with the shingle hashes of its texts; a bit table keeps the other texts out of the shuffle."""
    held = rows.sparkSession.sparkContext.broadcast(bit_table(member.select(F.xxhash64("row_key").alias("h")), "h"))  # 64 MB at most

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["doc_id", "row_key", "text"]).filter(pa.array(maybe(held.value, np.asarray(b.column("h")).view(_U))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b):
                found = sets(split(block.column("text"), FOLDED), size)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in found])])
                values = longs(np.concatenate([*found, np.empty(0, _U)]))
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("root", "docs", "shingles", "doc_id")), pa.array([len(s) for s in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["root", "docs", "shingles", "doc_id", "n", "s"])

    kept = rows.select("doc_id", "row_key", "text", F.xxhash64("row_key").alias("h")).mapInArrow(some, "doc_id long, row_key long, text string").dropDuplicates(["doc_id", "row_key"])
    both = kept.join(member, ["doc_id", "row_key"]).select("root", "docs", "shingles", "doc_id", "text")
    return both.mapInArrow(run, "root long, docs long, shingles long, doc_id long, n long, s array<long>")


def _beside(many: DataFrame, one: DataFrame, how: str = "inner") -> DataFrame:
    """many joined with one row for each root, which is repeated for every SPREAD members."""
    salts = (F.col("docs") / SPREAD).cast("int")
    one = one.withColumn("salt", F.explode(F.sequence(F.lit(0), salts))).drop("docs")
    return many.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n"), salts + 1).cast("int")).join(one, ["root", "salt"], how).drop("salt")


def pivoted(large: DataFrame, part: int, whole: int) -> DataFrame:
    """large with pivot, a member of each family, and is_open: whether a set does not link with it.

    The pivot is the member most like the shingles of more than half of the family, of which there
    are at most twice as many as a member has on average.
    """
    held = large.select("root", "docs", F.explode("s").alias("h")).groupBy("root", "docs", "h").agg(F.count("*").alias("c")).where("2 * c > docs")
    usual = held.groupBy("root", "docs").agg(F.collect_list("h").alias("usual"))
    alike = _beside(large, usual, "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<bigint>")))
    common = F.size(F.array_intersect("s", "usual"))
    alike = alike.withColumn("like", common / (F.col("n") + F.size("usual") - common))
    pivot = stored(alike.groupBy("root", "docs").agg(F.max_by(F.struct("doc_id", "n", "s"), F.struct("like", -F.col("doc_id"))).alias("p")), "pivots")
    both = F.size(F.array_intersect("s", "p.s"))
    linked = whole * both >= part * (F.col("n") + F.col("p.n") - both)
    return _beside(large, pivot).select("root", "doc_id", "n", "s", F.col("p.doc_id").alias("pivot"), (~linked).alias("is_open"))


def prints(sets_: DataFrame) -> DataFrame:
    """root, doc_id, n and p, the parity bits of how many shingles fall on each of 4 to 8 places a shingle, a power of two of at least 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column("s")
            ends, flat = np.asarray(cells.offsets), np.asarray(cells.values).view(_U)
            made = []
            for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                bits = max(64, 1 << (4 * (z - a) - 1).bit_length())
                place = (mix(flat[a:z], 7) & _U(bits - 1)).astype(np.int64)
                made.append(np.packbits(np.bincount(place, minlength=bits) & 1, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("root", "doc_id", "n")), pa.array(made, pa.binary())], ["root", "doc_id", "n", "p"])

    return sets_.select("root", "doc_id", "n", "s").mapInArrow(run, "root long, doc_id long, n long, p binary")


def _alike(part: int, whole: int):
    """(a, b) for the prints of one or two blocks: spanning links of those whose sets may link. A print with its halves folded onto each other is the shorter print of the same set."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, side, n = (np.asarray(table.column(c)) for c in ("doc_id", "side", "n"))
        made = [np.frombuffer(p.as_buffer(), "<u8") for p in table.column("p").combine_chunks()]
        least = min(map(len, made))
        bits = np.array([np.bitwise_xor.reduce(p.reshape(-1, least)) for p in made])
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
        alone = not len(two)
        two = one if alone else two
        other, held = np.ascontiguousarray(bits[two].T), [(np.empty(0, np.int64),) * 2]
        step = max(1, (1 << 20) // len(two))
        for at in range(0, len(one), step):
            some = one[at : at + step]
            apart = np.zeros((len(some), len(two)), np.int32)
            for k in range(least):
                apart += np.bitwise_count(bits[some, k, None] ^ other[k])
            i, j = np.nonzero((whole + part) * apart <= (whole - part) * (n[some, None] + n[two]))
            if alone:
                i, j = i[i + at < j], j[i + at < j]
            held.append((ids[some[i]], ids[two[j]]))
            if sum(len(a) for a, _ in held) > BLOCK_EDGES:
                held = [lowest(*map(np.concatenate, zip(*held, strict=True)))]
        node, low = lowest(*map(np.concatenate, zip(*held, strict=True)))
        return pa.table({"a": low[node != low], "b": node[node != low]})

    return run


def _refined(every: DataFrame, part: int, whole: int) -> DataFrame:
    """every with finer families for the very large ones; a set that can link with none has no row."""
    vast = (F.col("docs") > FINE_DOCS) | (F.col("shingles") > FINE_SHINGLES)
    some = every.where(vast)
    if some.isEmpty():
        return every
    own = stored(prints(some).withColumn("is_open", F.lit(True)), "prints")
    wide = _block_pairs(own, ["doc_id", "n", "p"], F.length("p"), PRINT_BYTES, PRINT_DOCS, part, whole)
    near = stored(wide.groupBy("root", "i", "j").applyInArrow(_alike(part, whole), "a long, b long"), "alike")
    fine = stored(components(near).withColumnRenamed("node", "doc_id"), "fine")
    total = own.select("doc_id", "n").join(fine, "doc_id").groupBy("root").agg(F.sum("n").alias("shingles"), F.count("*").alias("docs"))
    fine = split_join(fine, stored(total, "totals"), ["root"], "docs")
    moved = stored(some.select("doc_id", "n", "s").join(fine, "doc_id"), "sets")
    release(every.sparkSession)
    return every.where(~vast).unionByName(moved.select(every.columns))


def _block_pairs(large: DataFrame, columns: list[str], weight: Column, most: int, most_docs: int, part: int, whole: int) -> DataFrame:
    """root, i, j, side and columns: the pairs of blocks of a family whose sizes can link and of which one is open, each with its rows, those of the second block on side 1.

    A block has about `most` of the weight and most_docs rows. large (root, is_open, doc_id, n, ...) is read more than once: store it before.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / log(whole / part)).cast("int")  # links reach the next level at most
    cut = large.withColumn("level", level)
    kind = ["root", "is_open", "level"]
    held = cut.groupBy(*kind).agg(F.sum(weight).alias("sum"), F.count("*").alias("c"))
    held = held.withColumn("parts", F.greatest(F.ceil(F.col("sum") / most), F.ceil(F.col("c") / most_docs)).cast("int"))
    cut = split_join(cut, stored(held.select(*kind, "c", "parts"), "kinds"), kind, "c").withColumn("sub", F.pmod(F.xxhash64("doc_id", "n"), "parts").cast("int"))
    cut = stored(cut.drop("c", "parts"), "cut")
    # blocks in order of size
    block = cut.groupBy(*kind, "sub").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    block = stored(block.withColumn("no", F.row_number().over(Window.partitionBy("root").orderBy("is_open", "level", "sub"))), "blocks")
    other = block.select("root", *[F.col(c).alias(f"{c}2") for c in ("no", "lo", "hi", "is_open")])
    pair = block.join(other, "root").where((F.col("no") <= F.col("no2")) & (F.col("is_open") | F.col("is_open2")) & (whole * F.least("hi", "hi2") >= part * F.greatest("lo", "lo2")))
    ends = pair.select("root", F.col("no").alias("at"), F.col("no").alias("i"), F.col("no2").alias("j"), F.lit(0).alias("side"))
    ends = ends.unionByName(pair.where("no < no2").select("root", F.col("no2").alias("at"), F.col("no").alias("i"), F.col("no2").alias("j"), F.lit(1).alias("side")))
    ends = ends.join(block.select(*kind, "sub", F.col("no").alias("at")), ["root", "at"])
    return cut.join(ends, [*kind, "sub"]).select("root", "i", "j", "side", *columns)


def _links(rows: DataFrame, heads: DataFrame, family: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """(a, b): links that join what all links join."""
    member = stored(heads.select("doc_id", "row_key", "n_shingles").join(family.withColumnRenamed("node", "doc_id"), "doc_id"), "members")
    total = member.groupBy("root").agg(F.sum("n_shingles").alias("shingles"), F.count("*").alias("docs"))
    member = stored(split_join(member, stored(total, "totals"), ["root"], "docs"), "members")
    every = stored(_sets(rows, member, size), "sets")
    release(rows.sparkSession)
    every = _refined(every, part, whole)
    fits = (F.col("shingles") <= BLOCK_SHINGLES) & (F.col("docs") <= BLOCK_DOCS)
    verify = _verify(part, whole)
    small = every.where(fits).select("root", "doc_id", "s", F.lit(0).alias("side")).groupBy("root").applyInArrow(verify, "a long, b long")
    large = every.where(~fits)
    if large.isEmpty():
        return small
    large = stored(pivoted(large, part, whole), "pivoted")
    wide = _block_pairs(large, ["doc_id", "s"], F.col("n"), BLOCK_SHINGLES, BLOCK_DOCS, part, whole)
    made = wide.groupBy("root", "i", "j").applyInArrow(verify, "a long, b long")
    hubs = large.where("not is_open and doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    return small.unionByName(made).unionByName(hubs)
