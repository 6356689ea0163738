"""A Merkle manifest of a dataset: a tree for each source, and one over their roots.

Leaves are SHA-256 digests of records. Sixteen consecutive nodes make the next level's node.
Positions come from ranges (no task holds a source), and blocks of 16**3 consecutive leaves become
arrays that higher-order functions collapse by three levels: sequence and slice cut a level into runs,
transform digests them, aggregate stacks the levels. The blocks' roots are the leaves of the next round, until
each source has one node; the sources' roots, in order, are then a tree of the same kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._rank import ranked
from loomspark.llm._split import column
from loomspark.llm._store import stored

#: Nodes that one digest covers, levels that a block collapses, and the leaves of a block.
WIDTH, LEVELS = 16, 3
BLOCK = WIDTH**LEVELS


def field(c: Column) -> Column:
    """A value with its number of UTF-8 bytes before it; - if null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _next_level(nodes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / WIDTH).cast("int")), lambda i: F.sha2(F.array_join(F.slice(nodes, i * WIDTH + 1, F.lit(WIDTH)), ""), 256))


def _height(n: Column) -> Column:
    """Levels to collapse in a block of a group of n nodes: to one node, or all of a block's if the group has several blocks."""
    return sum((F.when(n > WIDTH**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """g, block, n, items, levels, height and root of each block of nodes (g, position, n, digest, and columns that items keep)."""
    others = [c for c in nodes.columns if c not in ("g", "position", "n", "digest")]
    items = F.sort_array(F.collect_list(F.struct("position", "digest", *others)))
    held = nodes.groupBy("g", F.expr(f"position div {BLOCK}").alias("block"), "n").agg(items.alias("items")).withColumn("height", _height(F.col("n")))
    first = F.array(F.transform("items", lambda x: x["digest"]))
    levels = F.aggregate(F.slice(F.array(*map(F.lit, range(LEVELS))), F.lit(1), F.col("height")), first, lambda done, _: F.concat(done, F.array(_next_level(F.element_at(done, -1)))))
    return stored(held.select("g", "block", "n", "height", "items", levels.alias("levels")).withColumn("root", F.element_at(F.element_at("levels", -1), 1)), name)


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Tables of blocks: of the nodes, of the roots of their blocks, and so on until each group has one block."""
    tables = [_blocks(nodes, name)]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        wide = tables[-1].where(F.col("n") > BLOCK)
        tables.append(_blocks(wide.select("g", F.col("block").alias("position"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("root").alias("digest")), f"{name}-{len(tables)}"))
    return tables


def _path(i: Column) -> Column:
    """(left, right) at each level of item i of a block: its run's digests before and behind it, joined."""

    def siblings(level: Column, k: Column) -> Column:
        at = F.call_function("shiftright", i, k * 4)
        j = F.pmod(at, F.lit(WIDTH))
        text = lambda start, n: F.array_join(F.slice(level, start, n), "")
        return F.struct(text(at - j + 1, j).alias("left"), text(at + 2, F.lit(WIDTH - 1) - j).alias("right"))

    return F.transform(F.slice("levels", F.lit(1), F.col("height")), siblings)


def _down(blocks: DataFrame, above: DataFrame, *kept: str) -> DataFrame:
    """The items of blocks, each with its path to the top: its own levels, then that of its block (above: g, block, path, and columns to keep)."""
    both = blocks.select("g", "block", "height", "items", "levels").join(above, ["g", "block"])
    more = [c for c in above.columns if c not in ("g", "block", "path")]
    each = F.transform("items", lambda x, i: F.struct(*[x[k].alias(k) for k in kept], F.concat(_path(i), F.col("path")).alias("path")))
    return both.select("g", *more, F.inline(each))


@dataclass
class Manifest:
    """Blocks of each round of the sources' trees and of the tree over them; root is None for an empty dataset."""

    trees: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    def subroots(self) -> DataFrame:
        """g (the source behind an s; empty for null) and subroot."""
        return _singles(self.trees).select("g", F.col("root").alias("subroot"))

    def source_paths(self) -> DataFrame:
        """g, subroot and path, the siblings on the way from each source's subroot to the root."""
        path = self.top[-1].select("g", "block", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
        for table in self.top[:0:-1]:
            path = _down(table, path, "position").withColumnRenamed("position", "block")
        return _down(self.top[0], path, "source", "digest").select(F.col("source").alias("g"), F.col("digest").alias("subroot"), "path")

    def block_paths(self) -> DataFrame:
        """g, block, subroot and path of each block of leaves."""
        ends, out, wider = self.source_paths(), None, None
        for table in reversed(self.trees):
            own = table.where(F.col("n") <= BLOCK).select("g", "block").join(ends, "g").select("g", "block", "subroot", "path")
            if wider is not None:
                own = own.unionByName(_down(wider, out, "position").select("g", F.col("position").alias("block"), "subroot", "path"))
            out, wider = own, table
        return out


def _singles(tables: list[DataFrame]) -> DataFrame:
    """The last block of each group."""
    out = tables[0].where(F.col("n") <= BLOCK).select("g", "root")
    for t in tables[1:]:
        out = out.unionByName(t.where(F.col("n") <= BLOCK).select("g", "root"))
    return out


def manifest(docs: DataFrame, *, columns: list[str], group: str = "source", key: str = "doc_id", other: Column | None = None) -> Manifest:
    """The manifest of docs: leaves over `columns`, ascending by key in each group, groups ascending by their bytes.

    A null group is one of its own and the first; null keys come first in their group; rows of one key
    are ordered by their leaf, so repeated rows (equal leaves) change nothing by their order. Nulls in other
    columns, empty and very long texts have leaves like others. other: a digest that leaves are
    to carry along (see proofs). Only digests are shuffled, never texts; columns of other names are not looked at.
    """
    g = F.coalesce(F.concat(F.lit("s"), column(group).cast("string")), F.lit(""))
    leaves = docs.select(g.alias("g"), column(key).alias("key"), leaf([column(c) for c in columns]).alias("digest"), (F.lit(None).cast("string") if other is None else other).alias("other"))
    placed = ranked(stored(leaves, "leaves"), ["g"], [F.col("key").asc_nulls_first(), F.col("digest").asc()], "ordered")
    trees = _rounds(placed, "blocks")
    roots = stored(_singles(trees).select(F.lit("").alias("g"), F.col("g").alias("source"), F.col("root").alias("digest")), "subroots")
    top = _rounds(ranked(roots, ["g"], [F.col("source").asc()], "sources"), "top")
    last = top[-1].select("root").first()
    return Manifest(trees, top, last and last[0])


def fold(start: Column, path: Column) -> Column:
    """The root that a digest and its siblings give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proofs(made: Manifest) -> DataFrame:
    """key, g, leaf, subroot, root, proof_sha256 (of all siblings on the way, left to right) and folded_root of each leaf.

    folded_root is what the digest `other` of a leaf (the leaf itself if null) gives with the leaf's siblings. An empty dataset gives an empty result.
    """
    both = made.trees[0].select("g", "block", "height", "items", "levels").join(made.block_paths(), ["g", "block"])
    paths = F.transform("items", lambda x, i: F.struct(x.alias("x"), F.concat(_path(i), F.col("path")).alias("path")))

    def one(y: Column) -> Column:
        siblings = F.array_join(F.transform(y["path"], lambda s: F.concat(s["left"], s["right"])), "")
        x = y["x"]
        return F.struct(x["key"].alias("key"), x["digest"].alias("leaf"), F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce(x["other"], x["digest"]), y["path"]).alias("folded_root"))

    return both.select("g", "subroot", F.lit(made.root).cast("string").alias("root"), F.inline(F.transform(paths, one)))


#: The columns that a document's leaf covers.
DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered(doc_id: Column) -> Column:
    """Whether 5 divides the CRC-32 of the decimal doc_id (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lower(text: Column) -> Column:
    """A to Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
