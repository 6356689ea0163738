"""Removal of multi-line passages that repeat anywhere in the corpus. DataFrame functions only.

Lines are hashed; a chunk ends where a rolling hash over the last WINDOW line hashes is 0 modulo
DIVISOR and that of the line before is not, so boundaries follow the content, survive
insertions elsewhere, and are two lines apart at least. Chunks of two lines or more are grouped by a 128-bit hash;
those whose hash repeats are fetched and compared byte by byte with the first
occurrence, and all but that first one go. Chunk boundaries hide passages that they
cut; with every_pair each two neighbouring lines of text take the place of a chunk,
so nothing that repeats is hidden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._split import column, part_rows, split_join
from loomspark.llm._store import stored

#: Members of a group that meet one copy of its first chunk's text in a task.
SPREAD = 2048


def line_hash(line: Column) -> Column:
    """The first 32 bits of a line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunk_spans(lines: str, *, window: int, divisor: int) -> list[tuple[str, Column]]:
    """Columns to add one after the other: hashes, ends, spans (start and n of each chunk, lines from 0). No chunk of a text of several lines has one line."""

    def falls(i: Column) -> Column:
        roll = F.lit(0).cast("long")
        for back in range(window):
            roll = roll + F.when(i >= back, F.get("_hashes", i - back)).otherwise(0) * F.lit(31**back).cast("long")
        return F.pmod(roll, F.lit(divisor)) == 0

    def ends_here(i: Column) -> Column:
        last = F.size("_hashes") - 1
        return falls(i) & ~falls(i - 1) & (i > 0) & (i < last - 1) | (i == last)

    return [
        ("_hashes", F.transform(lines, line_hash)),
        ("_ends", F.filter(F.sequence(F.lit(0), F.size("_hashes") - 1), ends_here)),
        ("_spans", F.transform("_ends", lambda e, k: F.struct(F.when(k == 0, 0).otherwise(F.get("_ends", k - 1) + 1).alias("start"), (e - F.when(k == 0, -1).otherwise(F.get("_ends", k - 1))).alias("n")))),
    ]


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """row (all columns of docs but the text), no_text, d and k (order and identity of a document), text."""
    clean = F.coalesce(column(text).cast("string"), F.lit(""))
    others = [column(c) for c in docs.columns if c != text] or [F.lit(None).alias("none")]
    return docs.select(F.struct(*others).alias("row"), column(text).isNull().alias("no_text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64(clean).alias("k"), clean.alias("text"))


def chunks(rows: DataFrame, *, window: int, divisor: int) -> DataFrame:
    """d, k, start, n, and two hashes of every chunk of two lines or more."""
    out = rows.select("d", "k", F.split("text", "\n", -1).alias("_lines")).where(F.size("_lines") > 1)
    for name, col in chunk_spans("_lines", window=window, divisor=divisor):
        out = out.withColumn(name, col)
    out = out.select("d", "k", "_lines", F.explode(F.filter("_spans", lambda s: s["n"] > 1)).alias("s"))
    out = out.select("d", "k", "s.start", "s.n", F.array_join(F.slice("_lines", F.col("s.start") + 1, F.col("s.n")), "\n").alias("chunk"))
    return out.select("d", "k", "start", "n", F.xxhash64("chunk").alias("h1"), F.xxhash64(F.lit(7), "chunk").alias("h2"))


def pairs(rows: DataFrame) -> DataFrame:
    """d, k, start, n, and two hashes of each line that is not empty with the next such line and the empty ones between."""
    full = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] != "")
    out = rows.select("d", "k", full.alias("_full")).where(F.size("_full") > 1)

    def pair(a: Column, b: Column) -> Column:
        n = b["i"] - a["i"] + 1
        return F.struct(a["i"].alias("start"), n.alias("n"), F.xxhash64(n, a["x"], F.lit("\n"), b["x"]).alias("h1"), F.xxhash64(F.lit(7), n, a["x"], F.lit("\n"), b["x"]).alias("h2"))

    both = F.zip_with(F.slice("_full", F.lit(1), F.size("_full") - 1), F.slice("_full", F.lit(2), F.size("_full") - 1), pair)
    return out.select("d", "k", F.explode(both).alias("s")).select("d", "k", "s.*")


def merged(spans: DataFrame) -> DataFrame:
    """(d, k, start, n) with spans of a document that overlap or touch made one."""
    before = Window.partitionBy("d", "k").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    new = spans.withColumn("new", (F.col("start") > F.coalesce(F.max(F.col("start") + F.col("n")).over(before), F.lit(-1))).cast("int"))
    own = new.withColumn("no", F.sum("new").over(Window.partitionBy("d", "k").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy("d", "k", "no").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start")).cast("int").alias("n")).drop("no")


def _with_lines(text: str, f) -> Column:  # noqa: ANN001
    """f of the lines of a text, which is split once however often f uses them."""
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), f), F.lit(0))


def repeated_chunks(rows: DataFrame, *, window: int, divisor: int, every_pair: bool = False) -> DataFrame:
    """(d, k, start, n) of the chunks, or pairs, that go."""
    every = stored(pairs(rows) if every_pair else chunks(rows, window=window, divisor=divisor), "chunks")
    groups = every.groupBy("h1", "h2").agg(F.min(F.struct("d", "k", "start")).alias("first"), F.count("*").alias("c")).where("c > 1")
    hits = split_join(every, stored(groups, "groups"), ["h1", "h2"], "c").withColumn("is_first", F.struct("d", "k", "start") == F.col("first"))
    if every_pair:  # what overlaps its own first occurrence is no repetition
        hits = hits.where(~((F.col("d") == F.col("first.d")) & (F.col("k") == F.col("first.k")) & (F.col("start") > F.col("first.start")) & (F.col("start") < F.col("first.start") + F.col("n"))))
    hits = stored(hits.select("d", "k", "start", "n", "h1", "h2", "c", "is_first"), "hits")
    # texts of the hits, through one shuffle of the documents that have some
    wanted = hits.groupBy("d", "k").agg(F.collect_set(F.struct("start", "n", "h1", "h2", "c", "is_first")).alias("hits"))
    some, _ = part_rows(rows.select("d", "k", "text"), F.xxhash64("d", "k"), hits.select(F.xxhash64("d", "k").alias("h")))
    cut = lambda s, lines: F.struct(*[s[c].alias(c) for c in ("start", "n", "h1", "h2", "c", "is_first")], F.array_join(F.slice(lines, s["start"] + 1, s["n"]), "\n").alias("chunk"))
    held = some.join(wanted, ["d", "k"]).select("d", "k", F.inline(_with_lines("text", lambda lines: F.transform("hits", lambda s: cut(s, lines)))))
    held = stored(held, "passages")
    salts = F.floor(F.col("c") / SPREAD).cast("int")
    first = held.where("is_first").select("h1", "h2", F.col("chunk").alias("first_chunk"), F.explode(F.sequence(F.lit(0), salts)).alias("salt")).dropDuplicates(["h1", "h2", "salt"])
    rest = held.where("not is_first").withColumn("salt", F.pmod(F.xxhash64("d", "k", "start"), salts + 1).cast("int"))
    gone = rest.join(first, ["h1", "h2", "salt"]).where("chunk = first_chunk").select("d", "k", "start", "n")
    return merged(gone) if every_pair else gone


def dedup_lines(docs: DataFrame, *, window: int = 2, divisor: int = 2, every_pair: bool = False, text: str = "text", counts: bool = True) -> DataFrame:
    """The rows of docs with all their columns, the text without repeated chunks, and with counts n_lines and n_removed_lines.

    Of equal chunks the one of the smallest doc_id stays (then of the smallest text
    hash, then the first in the document); single-line chunks always stay. With every_pair
    the chunks are all pairs of neighbouring lines, empty ones between included: a line goes if one of its
    pairs stands earlier, so whole runs of two lines or more go wherever they begin,
    and the first occurrence of a line always stays. Lines end
    at line feeds; kept lines are joined by line feeds again. Null and empty texts stay as they are
    (0 lines); a null doc_id counts as the largest; identical rows count as one
    document and get the same result. Columns of docs named n_lines or n_removed_lines are
    replaced by the counts, and kept without them. An empty table gives an empty result. Only texts
    that lose lines are shuffled whole.
    """
    rows = _rows(docs, text)
    gone = repeated_chunks(rows, window=window, divisor=divisor, every_pair=every_pair)
    gone = stored(gone.groupBy("d", "k").agg(F.collect_set(F.struct("start", "n")).alias("gone")), "gone")
    some, others = part_rows(rows, F.xxhash64("d", "k"), gone.select(F.xxhash64("d", "k").alias("h")))
    # what lies between the spans that go, which are apart
    spans = F.array_sort("gone")
    after = F.concat(F.array(F.lit(0)), F.transform(spans, lambda g: g["start"] + g["n"]))
    between = lambda lines: F.flatten(F.zip_with(after, F.concat(F.transform(spans, lambda g: g["start"]), F.array(F.size(lines))), lambda a, z: F.slice(lines, a + 1, z - a)))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_with_lines("text", between), "\n"))
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_gone = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda a, g: a + g["n"]), F.lit(0)).cast("long")
    added = [n_lines.alias("n_lines"), n_gone.alias("n_removed_lines")] if counts else []
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed_lines")]

    def out(both: DataFrame) -> DataFrame:
        own = [F.when(~F.col("no_text"), kept).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names]
        return both.select(*own, *added)

    return out(some.join(gone, ["d", "k"], "left")).unionByName(out(others.withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))))
