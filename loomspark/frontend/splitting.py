"""Plans for moving candidates to files of their own: what moves along, what is passed in, imports, exports, checks. No file is written.

All functions take the candidates of many files (rel_path, id, kind, symbol, ...; see candidates.detected and targets.allocated)
and the graph of their declarations (dependencies.graph). Everything stays keyed by rel_path and id.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.frontend import outline, targets
from loomspark.functions import text as T

# The endings of files that can be split.
SPLITTABLE = (".js", ".jsx", ".mjs", ".cjs")


def input_problem(root: str, path: str, max_kb: int = 150) -> str | None:
    """Why a file cannot be split, the first reason that holds; None if it can. Driver only."""
    if not path.strip():
        return "empty-path"
    base = os.path.abspath(root)
    at = os.path.abspath(os.path.join(base, path))
    if os.path.commonpath([base, at]) != base:
        return "outside-project-root"
    if not os.path.lexists(at):
        return "not-found"
    if os.path.islink(at):
        return "symlink"
    if os.path.isdir(at):
        return "is-directory"
    if not os.path.isfile(at):
        return "not-a-file"
    if os.path.splitext(at)[1].lower() not in SPLITTABLE:
        return "unsupported-extension"
    if os.path.getsize(at) > max_kb * 1024:
        return "file-too-large"
    return "binary-file" if b"\0" in Path(at).read_bytes() else None


def advised(candidates: DataFrame, advice: DataFrame) -> DataFrame:
    """candidates with a reviewer's advice (rel_path, id, reason, confidence, risks) where it is sound; advice on unknown ids is ignored.

    A reason counts if not blank, a confidence from 0 to 1, risks are added. What has risks is no longer automatic-ready.
    """
    given = advice.groupBy("rel_path", "id").agg(F.max(F.struct("reason", "confidence", "risks")).alias("a"))
    out = candidates.join(given, ["rel_path", "id"], "left")
    more = F.filter(F.coalesce("a.risks", F.array().cast("array<string>")), lambda r: r.isNotNull() & (T.trimmed(r) != ""))
    out = out.withColumn("reason", F.coalesce(F.nullif(T.trimmed(F.col("a.reason")), F.lit("")), "reason")).withColumn("confidence", F.when(F.col("a.confidence").between(0, 1), F.col("a.confidence")).otherwise(F.col("confidence")))
    out = out.withColumn("risks", F.array_union("risks", more)).drop("a")
    return out.withColumn("safety", F.when((F.col("safety") == "automatic-ready") & (F.size("risks") > 0), "manual-review").otherwise(F.col("safety")))


def placement(candidates: DataFrame, graph: DataFrame) -> DataFrame:
    """rel_path, id, moved, remaining: which of the declarations that a candidate needs go with it.

    Direct ones go if nothing else uses them and they are values or functions that are not exported; of what these need, values that
    nothing else uses, until nothing changes. One file's declarations at a time are folded in order, in Arrow batches.
    """
    lists = graph.groupBy("rel_path").agg(F.collect_list(F.struct("name", "kind", "exported", "dependencies", "dependents")).alias("decls"))
    rows = candidates.select("rel_path", "id", "symbol", "dependencies").join(lists, "rel_path", "left")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                known = {d["name"]: d for d in (r.decls if r.decls is not None else [])}
                moved, stays = set(), set()

                def free(name, own, moved=moved, known=known):
                    return all(u == own or u in moved for u in known[name]["dependents"])

                for name in r.dependencies:
                    if name in known:
                        d = known[name]
                        movable = d["kind"] in ("constant", "variable") or (d["kind"] == "function" and not d["exported"])
                        (moved if movable and free(name, r.symbol) else stays).add(name)
                todo = sorted(moved)
                while todo:
                    for name in known[todo.pop(0)]["dependencies"]:
                        if name in known and name != r.symbol and name not in moved and name not in stays:
                            if known[name]["kind"] in ("constant", "variable") and free(name, r.symbol):
                                moved.add(name)
                                todo.append(name)
                            else:
                                stays.add(name)
                out.append((r.rel_path, r.id, sorted(moved), sorted(stays)))
            yield pd.DataFrame(out, columns=["rel_path", "id", "moved", "remaining"])

    return rows.mapInPandas(place, "rel_path string, id string, moved array<string>, remaining array<string>")


def contract(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """rel_path, id, kind, name, usage, resolution, passed_as: how each captured name reaches the moved code.

    usage: mutate, call or read, by the identifiers of that name on the candidate's lines. Components take props, other code parameters,
    constants stay; what the code changes is unresolved.
    """
    held = candidates.select("rel_path", "id", "kind", "line_start", "line_end", F.explode("captured").alias("name"))
    seen = nodes.where("type = 'Identifier' and access is not null").select("rel_path", "name", F.col("line_start").alias("at"), "role", "parent_type")
    used = held.join(seen, ["rel_path", "name"], "left")
    here = F.col("at").between(F.col("line_start"), F.col("line_end"))
    changes = here & (((F.col("parent_type") == "AssignmentExpression") & (F.col("role") == "left")) | (F.col("parent_type") == "UpdateExpression"))
    calls = here & (F.col("parent_type") == "CallExpression") & (F.col("role") == "callee")
    told = used.groupBy("rel_path", "id", "kind", "name").agg(F.coalesce(F.bool_or(changes), F.lit(False)).alias("m"), F.coalesce(F.bool_or(calls), F.lit(False)).alias("c"))
    usage = F.when(F.col("m"), "mutate").when(F.col("c"), "call").otherwise("read")
    way = F.when(F.col("kind") == "constant-group", "remain-in-source").when(F.col("m"), "unresolved").when(F.col("kind") == "react-component", "prop").otherwise("parameter")
    name = F.when(F.col("kind") == "react-component", T.prop_name(F.col("name"))).when(F.col("kind") != "constant-group", F.col("name"))
    return told.select("rel_path", "id", "kind", "name", usage.alias("usage"), way.alias("resolution"), name.alias("passed_as"))


def props(contracts: DataFrame) -> DataFrame:
    """rel_path, id, destructured (names that the component takes) and call_site (what is passed as them), both by name."""
    of = contracts.where("kind = 'react-component'").groupBy("rel_path", "id").agg(F.array_sort(F.collect_list(F.struct("passed_as", "name"))).alias("p"))
    return of.select("rel_path", "id", F.col("p.passed_as").alias("destructured"), F.transform("p", lambda p: F.struct(p["passed_as"].alias("prop"), p["name"].alias("value"))).alias("call_site"))


def missing_props(contracts: DataFrame, present: DataFrame) -> DataFrame:
    """The rows of contracts whose prop the component does not take yet (present: rel_path, id, passed_as)."""
    return contracts.where("kind = 'react-component'").join(present, ["rel_path", "id", "passed_as"], "left_anti")


def imports(planned: DataFrame, placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """rel_path, id, into (target or source), import_source, local_name, imported_name, kind: the imports that both files need.

    planned has target_file. The target takes the source's imports that the moved code uses, and from the source what remains there;
    the source takes the moved symbol. Equal rows come once.
    """
    both = planned.select("rel_path", "id", "symbol", "target_file", "dependencies", "external_imports").join(placed, ["rel_path", "id"])
    uses = both.select("rel_path", "id", F.explode(F.array_distinct(F.concat("external_imports", "dependencies", "moved", F.array("symbol")))).alias("local_name"))
    old = uses.join(outline.bindings_imported(nodes), ["rel_path", "local_name"]).select("rel_path", "id", F.lit("target").alias("into"), "import_source", "local_name", "imported_name", "kind")
    back = both.select("rel_path", "id", F.lit("target").alias("into"), targets.relative_import(F.col("target_file"), F.col("rel_path")).alias("import_source"), F.explode("remaining").alias("local_name"))
    new = both.select("rel_path", "id", F.lit("source").alias("into"), targets.relative_import(F.col("rel_path"), F.col("target_file")).alias("import_source"), F.col("symbol").alias("local_name"))
    named = [x.withColumn("imported_name", F.col("local_name")).withColumn("kind", F.lit("named")) for x in (back, new)]
    return old.unionByName(named[0]).unionByName(named[1]).distinct()


def exports(planned: DataFrame, placed: DataFrame, graph: DataFrame) -> DataFrame:
    """rel_path, id, place (target or re-export), name, kind: the target exports the symbol and what was exported; the source re-exports that."""
    both = planned.select("rel_path", "id", "symbol").join(placed.select("rel_path", "id", "moved"), ["rel_path", "id"])
    names = both.select("rel_path", "id", "symbol", F.explode(F.array_distinct(F.concat(F.array("symbol"), "moved"))).alias("name"))
    known = graph.select("rel_path", "name", "exported", "is_default")
    told = names.join(known, ["rel_path", "name"], "left").withColumn("exported", F.coalesce("exported", F.lit(False)))
    target = told.where("exported or name = symbol").select("rel_path", "id", F.lit("target").alias("place"), "name", F.lit("named").alias("kind"))
    again = told.where("exported").select("rel_path", "id", F.lit("re-export").alias("place"), "name", F.when(F.col("is_default") & (F.col("name") == F.col("symbol")), "default").otherwise("named").alias("kind"))
    return target.unionByName(again)


def problems(planned: DataFrame, graph: DataFrame, files: DataFrame, listing: DataFrame) -> DataFrame:
    """rel_path, level (error or warning), rule, symbol, detail: what speaks against a plan, each once.

    files: rel_path, source_text. listing: rel_path of all files. Errors: repeated ids, lines beyond the file, a target that is the
    source, a target shared by different kinds, a safe candidate with captures. Warnings: a target that exists, unknown dependencies,
    candidates that need each other.
    """
    one = lambda df, level, rule, detail: df.select("rel_path", F.lit(level).alias("level"), F.lit(rule).alias("rule"), "symbol", detail.cast("string").alias("detail"))
    lines = files.select("rel_path", F.size(F.split("source_text", "\r?\n", -1)).alias("n_lines"))
    shared = planned.groupBy("rel_path", "target_file").agg(F.min("kind").alias("k1"), F.max("kind").alias("k2")).where("k1 <> k2").select("rel_path", "target_file")
    again = planned.groupBy("rel_path", "id").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol")).where("n > 1")
    needs = planned.select("rel_path", "symbol", "external_imports", F.explode("dependencies").alias("need"))
    known = graph.select("rel_path", F.col("name").alias("need")).distinct()
    pairs = needs.select("rel_path", "symbol", "need").distinct()
    found = [
        one(again, "error", "repeated-id", F.col("id")),
        one(planned.join(lines, "rel_path").where("line_end > n_lines"), "error", "lines-beyond-file", F.col("line_end")),
        one(planned.where("target_file = rel_path"), "error", "target-is-source", F.col("target_file")),
        one(planned.join(shared, ["rel_path", "target_file"], "left_semi"), "error", "target-collision", F.col("target_file")),
        one(planned.where("safety = 'automatic-ready' and size(captured) > 0"), "error", "safe-with-captures", F.array_join("captured", ", ")),
        one(targets.conflicts(planned, listing).join(planned.select("rel_path", "id", "symbol"), ["rel_path", "id"]), "warning", "target-exists", F.col("target_file")),
        one(needs.where(~F.array_contains("external_imports", F.col("need"))).join(known, ["rel_path", "need"], "left_anti"), "warning", "unknown-dependency", F.col("need")),
        one(pairs.join(pairs.select("rel_path", F.col("symbol").alias("need"), F.col("need").alias("symbol")), ["rel_path", "symbol", "need"], "left_semi").join(planned.select("rel_path", F.col("symbol").alias("need")).distinct(), ["rel_path", "need"], "left_semi"), "warning", "mutual-dependency", F.col("need")),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def summary(planned: DataFrame, graph: DataFrame, files: DataFrame, nodes: DataFrame, listing: DataFrame) -> DataFrame:
    """One row per file: lines, declarations, imports, exports, and candidates detected, safe, unsafe and in conflict with existing files."""
    safe = (F.col("safety") == "automatic-ready").cast("int")
    parts = [
        graph.groupBy("rel_path").agg(F.count("*").alias("declarations"), F.count_if("exported").alias("exports")),
        outline.imports(nodes).groupBy("rel_path").agg(F.count("*").alias("imports")),
        planned.groupBy("rel_path").agg(F.count("*").alias("detected"), F.sum(safe).alias("safe"), F.sum(1 - safe).alias("unsafe")),
        targets.conflicts(planned, listing).groupBy("rel_path").agg(F.count("*").alias("conflicts")),
    ]
    out = files.select("rel_path", F.size(F.split("source_text", "\r?\n", -1)).alias("lines"))
    for p in parts:
        out = out.join(p, "rel_path", "left")
    return out.fillna(0)
