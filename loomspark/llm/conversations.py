"""Repair of damaged conversations: the cheapest edits that give roles in a legal order.

A conversation is legal if the first letters of its roles are an s at most, and pairs of u and a.
Turns are kept, given another role or deleted, and empty turns inserted. Turns are numbered, cut into
segments of SEGMENT turns and dealt by hash of conversation and segment; in each batch of segments a recursive
DuckDB query advances one turn of all of them at a time and keeps, for each grammar state, the least cost and
the least audit among its ties. Conversations of several segments then go through the same query once more, with
segments in the place of turns, until each has one row: no task needs a whole conversation for its audit.

Two audits of the same turns between the same states that cost the same are never the beginning of one another (the
longer would cost its inserted turns more), so the least audit of a whole is made of least audits of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._rank import ranked
from loomspark.llm._split import split_join
from loomspark.llm._store import stored

#: Turns of a segment, segments of a span, and rows that one recursive query takes at least (if there are as many).
SEGMENT, SPAN, BATCH = 128, 64, 20_000
#: Costs of edits, and of leaving a truncated turn in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn. The first and the last are ends.
STATES = "0sua"
NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
BLANK = r"[^\x20\x09-\x0D]"


def _inserted(state: str) -> list[tuple[str, str, int]]:
    """(state, letters, cost) that inserting no, one or two turns leads to; a third would undo the first."""
    out = [(state, "", 0)]
    for _ in range(2):
        s, letters, cost = out[-1]
        out.append(("a" if s == "u" else "u", letters + "I", cost + INSERT))
    return out


def moves() -> pa.Table:
    """kind, src, dst, cost, letters: the best way over a turn of each kind, with turns inserted before it.

    A kind is the turn's letter (s, u, a or x) and d if it has to go, t if it is truncated, k otherwise.
    """
    best: dict[tuple, tuple[int, str]] = {}
    for letter in "suax":
        for fault in "dtk":
            for src in STATES:
                for at, letters, cost in _inserted(src):
                    more = TRUNCATED if fault == "t" else 0
                    ways = [(at, "D", DELETE)]
                    if fault != "d":
                        ways += [(NEXT[at, letter], "K", more)] if (at, letter) in NEXT else []
                        ways += [(NEXT[at, r], "R", REROLE + more) for r in "ua" if (at, r) in NEXT]
                    for dst, edit, price in ways:
                        key = (letter + fault, STATES.index(src), STATES.index(dst))
                        best[key] = min(best.get(key, (10**9, "")), (cost + price, letters + edit))
    rows = [(*k, *v) for k, v in best.items()]
    return pa.table({n: [r[i] for r in rows] for i, n in enumerate(("kind", "src", "dst", "cost", "letters"))})


#: What is added at the end of a conversation, by state.
END = {i: min((cost, letters) for at, letters, cost in _inserted(s) if at in "0a") for i, s in enumerate(STATES)}

#: Each step of the recursion takes all batched segments over their turn number n.
WALK = """
with recursive walk(g, part, start, n, state, cost, audit) as (
  select g, part, s, 0::bigint, s, 0::bigint, '' from (select distinct g, part from steps), range(4) t(s) where part > 0 or s = 0
  union all
  select g, part, start, n + 1, dst, best.cost, best.audit from (
    select w.g, w.part, w.start, w.n, e.dst, min(struct_pack(cost := w.cost + e.cost, audit := w.audit || e.letters)) as best
    from walk w join steps e on e.g = w.g and e.part = w.part and e.n = w.n and e.src = w.state group by all)
), ends as (select g, part, max(n) + 1 as n from steps group by all)
select g, part, start::int as src, state::int as dst, cost, audit as letters from walk join ends using (g, part, n)
"""
TURNS = "create or replace temp table steps as select g, part, n, src, dst, cost, letters from held join moves using (kind)"
SPANS = "create or replace temp table steps as select g, part, n, src, dst, cost, letters from held"
STEP = "g string, part long, src int, dst int, cost long, letters string"


def _batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of at least `least` rows (the last may be smaller) that end where a (g, part) ends; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        rows += len(b)
        if rows >= least:
            table = pa.Table.from_batches(held)
            g, part = table["g"], table["part"]
            at = rows - 1
            last = (g[at], part[at])
            while at and (g[at - 1], part[at - 1]) == last:
                at -= 1
            if at:
                yield table.slice(0, at)
            held, rows = table.slice(at).to_batches(), rows - at
    if held:
        yield pa.Table.from_batches(held)


def _walked(steps: DataFrame, view: str, least: int) -> DataFrame:
    """The best ways through each (g, part) of steps, by the state before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        con.register("moves", moves())
        for table in _batches(batches, least):
            con.register("held", table)
            con.execute(view)
            yield from con.sql(WALK).to_arrow_table().cast(pa.schema([("g", pa.string()), ("part", pa.int64()), ("src", pa.int32()), ("dst", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])).to_batches()
            con.unregister("held")
        con.close()

    return steps.repartition("g", "part").sortWithinPartitions("g", "part").mapInArrow(run, STEP)


def clean(turns: DataFrame) -> DataFrame:
    """g (conv_id behind a c, empty if null), conv_id, turn, role and text (one space if null), and h, the text's MD5."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    g = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    return turns.select(g.alias("g"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("h"))


def order() -> list[Column]:
    """The order of a conversation's turns: by turn, nulls first; ties by role and the text's MD5."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("h")]


def faults(turns: DataFrame) -> DataFrame:
    """Stored: g, turn, position, n, letter (of the role; x if it is none of s, u, a) and fault (blank, duplicate, truncated or null) of each turn.

    Equal turns of a conversation are found by their first position, which is pre-aggregated, and the MD5 of their text.
    """
    last = F.regexp_extract("text", rf"({BLANK})[\x20\x09-\x0D]*\z", 1)
    seen = clean(turns)
    light = seen.select("g", "turn", "role", "h", (~F.col("text").rlike(BLANK)).alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    placed = stored(ranked(light, ["g"], order(), "turns"), "placed")
    firsts = stored(placed.groupBy("g", "role", "h").agg(F.min("position").alias("first"), F.count("*").alias("c")), "firsts")
    fault = F.when(F.col("blank"), "blank").when(F.col("position") > F.col("first"), "duplicate").when(F.col("truncated"), "truncated")
    letter = F.substring("role", 1, 1)
    both = split_join(placed, firsts, ["g", "role", "h"], "c")
    return stored(both.select("g", "turn", "position", "n", F.when(letter.isin("s", "u", "a"), letter).otherwise("x").alias("letter"), fault.alias("fault")), "faults")


def audits(found: DataFrame) -> DataFrame:
    """g, cost and audit of each conversation of faults()."""
    fault = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise("k")
    cut = found.select("g", F.expr(f"position div {SEGMENT}").alias("part"), (F.col("position") % SEGMENT).alias("n"), F.concat("letter", fault).alias("kind"))
    ways = stored(_walked(cut, TURNS, BATCH), "ways")
    done = None
    while True:
        last = ways.groupBy("g").agg(F.max("part").alias("last"))
        one = ways.join(last.where("last = 0"), "g", "left_semi")
        done = one if done is None else done.unionByName(one)
        many = ways.join(last.where("last > 0"), "g", "left_semi")
        if many.isEmpty():
            break
        spans = many.select("g", F.expr(f"part div {SPAN}").alias("part"), (F.col("part") % SPAN).alias("n"), "src", "dst", "cost", "letters")
        ways = stored(_walked(spans, SPANS, BATCH), "spans")
    end = F.create_map(*[F.lit(x) for i, (cost, letters) in END.items() for x in (i, f"{cost}{letters}")])
    more = F.element_at(end, F.col("dst"))
    best = done.select("g", F.struct((F.col("cost") + F.regexp_extract(more, r"\d+", 0).cast("long")).alias("cost"), F.concat("letters", F.regexp_replace(more, r"\d+", "")).alias("audit")).alias("best"))
    return best.groupBy("g").agg(F.min("best").alias("best")).select("g", "best.*")


def _replayed(turns: DataFrame, plans: DataFrame, digest: bool) -> DataFrame:
    """Repaired turns (conv_id, seq, role, text), or their digest for each conversation (g, repaired_sha256).

    A task streams its conversations in order; a digest runs over a conversation's text from its beginning to its end, so
    those two steps are one task's for a conversation, of which it holds the audit and one Arrow batch.
    """
    rows = clean(turns).select("g", F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text", "h", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"))
    heads = plans.select("g", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("conv_id", "turn", "role", "text", "h")], "audit", F.lit(0).alias("kind"))
    both = heads.unionByName(rows).repartition("g").sortWithinPartitions("g", "kind", *order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, seq, g, hashed = "", 0, "0", 0, None, None

        def until_edit() -> Iterator[tuple[str, str]]:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                at, role = at + 1, "assistant" if state == "u" else "user"
                state = role[0]
                yield role, ""

        def ended() -> list[tuple[str, str]]:
            return list(until_edit()) if g is not None else []

        def put(role: str, text: str) -> None:
            nonlocal seq
            if digest:
                hashed.update((("\n" if seq else "") + role + ":" + text).encode())
            else:
                out.append((conv, seq, role, text))
            seq += 1

        conv = None
        for b in batches:
            out: list[tuple] = []
            for kind, own, c, role, text, plan in zip(*[b.column(n).to_pylist() for n in ("kind", "g", "conv_id", "role", "text", "audit")], strict=True):
                if kind == 0:
                    for x in ended():
                        put(*x)
                    if digest and g is not None:
                        out.append((g, hashed.hexdigest()))
                    g, audit, at, state, seq, hashed = own, plan, 0, "0", 0, hashlib.sha256()
                    conv = own[1:] if own else None
                    continue
                for x in until_edit():
                    put(*x)
                edit, at = audit[at], at + 1
                if edit == "R":
                    role = "assistant" if state == "u" else "user"
                if edit != "D":
                    state = role[:1]
                    put(role, text)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=kinds)
        out = []
        for x in ended():
            put(*x)
        if digest and g is not None:
            out.append((g, hashed.hexdigest()))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=kinds)

    names = ("g", "repaired_sha256") if digest else ("conv_id", "seq", "role", "text")
    kinds = pa.schema([(n, pa.int64() if n == "seq" else pa.string()) for n in names])
    return both.mapInArrow(run, ", ".join(f"{n} {'long' if n == 'seq' else 'string'}" for n in names))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id (of the input's type), seq (from 0), role and text of the repaired conversations.

    turns: conv_id, turn, role, text; other columns are not looked at. A null role or text counts as one space, null
    conv_ids as one conversation; null turns come first, ties are ordered by role and MD5 of the text, and rows that are
    equal in all are duplicates of the first. A role's letter is its first character, an empty role has none.
    Blank turns and duplicates are deleted; a conversation of which nothing is left gives no rows, and no turns give an
    empty result. Texts and conversations of any length are taken whole.
    """
    out = _replayed(turns, stored(audits(faults(turns)), "audits"), digest=False)
    return out.withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def illegal_pairs(found: DataFrame) -> DataFrame:
    """g and illegal, the number of neighbours whose letters are not su, ua or au; counted in segments, each with its follower's first turn."""
    at = F.expr(f"position div {SEGMENT}")
    both = F.when((F.col("position") % SEGMENT == 0) & (F.col("position") > 0), F.array(at, at - 1)).otherwise(F.array(at))
    cut = found.select("g", "position", "letter", F.explode(both).alias("part"))
    pair = F.concat(F.lag("letter").over(Window.partitionBy("g", "part").orderBy("position")), F.col("letter"))
    return cut.select("g", (~pair.isin("su", "ua", "au")).alias("bad")).groupBy("g").agg(F.count_if("bad").alias("illegal"))


def repair_report(original: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conv_id of `original`: faults of its `turns`, the cost and audit of their repair, and a digest of what it gives.

    gaps are missing numbers between the least and the largest turn. A conversation without turns has zeros, an empty audit and the
    digest of an empty text. Nulls, ties and repeated rows are as in repair().
    """
    found = faults(turns)
    plans = stored(audits(found), "audits")
    numbers = found.groupBy("g", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    width = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    sums = numbers.groupBy("g").agg(width.alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    all_ids = clean(original).groupBy("g").agg(F.first("conv_id").alias("conv_id"))
    out = all_ids
    for more in (sums, illegal_pairs(found), plans, _replayed(turns, plans, digest=True)):
        out = out.join(more, "g", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted damage, chosen by the CRC-32 of conv_id:turn modulo 20: 0 drops the row, 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 gives it to the user. Nulls become one space (conv_id and turn only in the hash)."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", or_space("conv_id"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
