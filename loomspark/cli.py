"""Command line: python -m loomspark [review] PATH, init, doctor, cache clear, split FILE, split history, split rollback.

Each command prints a report, as text or JSON. Exit codes of a review: 0 clean, 1 findings at the threshold, 2 failures; of splits: see SPLIT_CODES.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.frontend import rules, splitting
from loomspark.functions import text as T
from loomspark.operators import findings as O
from loomspark.plans import code, model_review, splits
from loomspark.plans.store import written
from loomspark.sources import cache, changes, config, environment, files, transactions

INCLUDE = ["**/*.{js,jsx,mjs,cjs}"]
EXCLUDE = ["node_modules/", "dist/", "build/", "coverage/", ".git/", ".loom-cache/", ".loomspark/"]
EXTENSIONS = (".js", ".jsx", ".mjs", ".cjs")
SETTINGS = "loomspark.json"
COMMANDS = ("review", "init", "doctor", "cache", "split")
#: Part of every cache key; raised when a rule changes what it finds.
RULES_VERSION = "1"
# Exit codes of the split commands by kind of error.
SPLIT_CODES = {"missing": 2, "invalid": 3, "unsafe-path": 3, "conflict": 5, "write": 6, "rollback-conflict": 7, "locked": 8}


def rules_of(root: str, names: list[str]) -> list[str]:
    """Ignore rules in their order: the built-in ones, then each ignore file that exists."""
    found = list(EXCLUDE)
    for name in names:
        path = Path(root) / name
        found += path.read_text(encoding="utf-8").splitlines() if path.is_file() else []
    return found


def options_of(settings: dict) -> code.Options:
    c, r = "complexity.", "react."
    return code.Options(
        complexity={"lines": settings[c + "maxFunctionLines"], "params": settings[c + "maxParameters"], "cyclomatic": settings[c + "maxCyclomaticComplexity"], "nesting": settings[c + "maxNestingDepth"]},
        react={"component": settings[r + "maxComponentLines"], "effect": settings[r + "maxEffectLines"]},
    )


def _found(spark: SparkSession, root: str, settings: dict, changed: DataFrame | None, ignore_files: tuple[str, ...], only: str | None) -> DataFrame:
    """The files to review with their status. only: one file, to which neither ignore nor include rules apply; a link is left out."""
    if only is not None:
        one = files.single(spark, f"{root}/{only}").withColumn("status", F.when(F.col("size_bytes") > settings["maxFileSizeKb"] * 1024, "too-large").otherwise("ok"))
        one = one.where(F.lit(not (Path(root) / only).is_symlink()))
        return one if changed is None else one.join(changed.select("rel_path"), "rel_path", "left_semi")
    listed = files.without_links(files.listing(spark, root), environment.links_below(root))
    found = files.discovered(listed, include=INCLUDE, exclude=rules_of(root, list(ignore_files)), max_kb=settings["maxFileSizeKb"], allowed=changed)
    return found if changed is None else found.where(F.col("ext").isin(*EXTENSIONS))


def _keyed(texts: DataFrame, ranges: DataFrame | None, settings: dict) -> DataFrame:
    """texts with the key of their cached result: text, path, changed lines, rules and settings that change findings."""
    if ranges is None:
        scoped = texts.withColumn("scope", F.lit(None).cast("array<struct<start:int,end:int>>"))
    else:
        spans = ranges.groupBy("rel_path").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("scope"))
        scoped = texts.join(spans, "rel_path", "left")
    used = {k: v for k, v in settings.items() if k.startswith(("complexity.", "react."))} | {"changed": ranges is not None}
    return scoped.withColumn("key", cache.review_key(F.col("source_text"), F.col("rel_path"), F.col("scope"), RULES_VERSION, used)).drop("scope")


def run(spark: SparkSession, root: str, settings: dict, *, changed: bool = False, base: str | None = None, ignore_files: tuple[str, ...] = (".gitignore", ".loomignore"), only: str | None = None, provider: model_review.Provider | None = None) -> dict:
    """The report of a review of all files below root, of one of them, or of the changed ones and their changed lines.

    Results of files are kept in the cache folder below root unless a provider is given: what a model says is not stored, as its budget may
    leave parts of a file out.
    """
    began = time.perf_counter()
    files_changed = changes.changed_files(spark, root, base) if changed or base else None
    found = written(_found(spark, root, settings, files_changed, ignore_files, only), "listing")  # a cached plan would hide later changes of the files from the same session
    skipped = files.skip_counters(found, settings["maxFiles"]).first().asDict()
    picked = found.where("status = 'ok'").orderBy("rel_path").limit(settings["maxFiles"])
    texts = written(files.contents(spark, root, picked, only), "texts")
    ranges: DataFrame | None = None
    if files_changed is not None:
        ranges = written(changes.changed_ranges(changes.diffs(spark, root, base), files_changed.join(texts.select("rel_path", "source_text"), "rel_path", "left")), "ranges")
    kept = cache.Cache(spark, f"{root}/{settings['cache.directory']}", max_entries=settings["cache.maxEntries"], enabled=settings["cache.enabled"] and provider is None)
    hits, todo = kept.lookup(_keyed(texts.where("not binary"), ranges, settings))
    hits, todo = written(hits, "hits"), written(todo, "todo")  # before the cache changes
    out = code.review(todo, ranges, options_of(settings))
    known = hits.select(F.explode("findings").alias("f")).select(*[F.col(f"f.{c}").alias(c) for c in rules.FINDING])
    findings, failures, said = out.findings.unionByName(known), out.failures, {}
    stopped = False
    if provider is not None:
        chunks = written(code.chunks(todo, out.nodes, ranges, max_tokens=settings["ai.maxInputTokensPerChunk"]), "chunks")
        told = model_review.review(chunks, out.findings, provider, ranges, model=settings["ai.model"], max_requests=settings["ai.maxRequests"], max_cost=settings["ai.maxEstimatedCostUsd"], max_output_tokens=settings["ai.maxOutputTokens"])
        findings, failures, said = findings.unionByName(told.findings.select(*rules.FINDING)), failures.unionByName(told.failures), told.totals.first().asDict()
        stopped = chunks.where("reason is null").count() > said["reviewed"] + said["failed"]
    elif kept.enabled:
        good = todo.join(out.failures.select("rel_path"), "rel_path", "left_anti").select("rel_path", "key")
        kept.put(good, out.findings.join(good, "rel_path"))
    findings = O.ordered(written(findings, "report"))
    failures = failures.unionByName(texts.where("binary").select("rel_path", F.lit("read").alias("stage"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.lit("binary file").alias("reason")))
    failed = [r.asDict() for r in failures.orderBy("rel_path").collect()]
    rows = [r.asDict() for r in findings.collect()]
    counts = {"findings": len(rows), "failed": len(failed), "discovered": texts.count(), "skipped": skipped, "by_severity": {r.severity: r.n for r in O.dense_counts(findings, "severity", list(T.SEVERITIES)).collect()}, "by_source": {r.source: r.n for r in O.dense_counts(findings, "source", T.SOURCES).collect()}}
    summary = out.summary().first().asDict() | counts | {"cache": kept.statistics()}
    if provider is not None:
        summary["ai"] = said | {"stopped_by_budget": stopped}
    hit = O.any_at_least(findings, settings["severityThreshold"]).first().hit
    summary |= {"threshold_hit": hit, "total_ms": round(1000 * (time.perf_counter() - began))}
    return {"status": "review-complete", "root": root, "findings": rows, "failures": failed, "summary": summary}


def as_text(report: dict) -> str:
    lines, last = [], None
    for f in report["findings"]:
        if f["rel_path"] != last:
            lines += ["", f["rel_path"]]
            last = f["rel_path"]
        lines.append(f"  {f['line_start']}:{f['column_start']}  {f['severity']:<8}  {f['rule_id']}  {f['message']}")
    lines += ["", *[f"failed: {x['rel_path']} ({x['stage']}): {x['reason']}" for x in report["failures"]]]
    s = report["summary"]
    lines.append(f"{s['discovered']} files, {s['findings']} findings (" + ", ".join(f"{n} {k}" for k, n in reversed(s["by_severity"].items())) + f"), {s['failed']} failures")
    return "\n".join(lines).strip()


def split_report(spark: SparkSession, root: str, path: str, settings: dict, target_folder: str | None = None) -> dict:
    """The plan of splitting one file, as rows; nothing is written."""
    folder, name = os.path.split(f"{root}/{path}")
    texts = files.contents(spark, folder, files.single(spark, f"{folder}/{name}").withColumn("status", F.lit("ok")), name)
    texts = texts.select(F.lit(path).alias("rel_path"), "source_text")
    made = splits.plan(texts, files.listing(spark, root), min_lines=settings["splitter.minCandidateLines"], most=settings["splitter.maxCandidates"], target_folder=target_folder or settings["splitter.targetDirectory"])
    rows = lambda df, *order: [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]  # noqa: E731  (one file's candidates, at most maxCandidates)
    return {
        "status": "split-plan", "root": root, "file": path, "candidates": rows(made.candidates, "line_start", "symbol"), "placement": rows(made.placement, "id"), "contract": rows(made.contract, "id", "name"),
        "imports": rows(made.imports, "id", "into", "import_source", "local_name"), "exports": rows(made.exports, "id", "place", "name"), "problems": rows(made.problems, "level", "rule", "symbol"),
        "summary": made.summary.first().asDict(), "failures": rows(made.failures, "rel_path"),
    }


def split_text(report: dict) -> str:
    s = report["summary"]
    lines = [f"{report['file']}: {s['lines']} lines, {s['declarations']} declarations, {s['detected']} candidates ({s['safe']} safe)"]
    for c in report["candidates"]:
        lines += [f"  {c['id']}  {c['kind']}  lines {c['line_start']}-{c['line_end']}  {c['safety']}  -> {c['target_file']}", f"    {c['reason']}"]
        lines += [f"    risk: {r}" for r in c["risks"]]
    lines += [f"{p['level']}: {p['rule']} ({p['symbol']}): {p['detail']}" for p in report["problems"]]
    return "\n".join(lines + [f"failed: {x['rel_path']} ({x['stage']}): {x['reason']}" for x in report["failures"]])


def session() -> SparkSession:
    spark = SparkSession.builder.appName("review").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspark")
    of = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--json", action="store_true")
    common.add_argument("--config")
    r = of.add_parser("review", parents=[common])
    r.add_argument("path", nargs="?", default=".")
    r.add_argument("--changed", action="store_true")
    r.add_argument("--base")
    r.add_argument("--severity")
    r.add_argument("--max-files", type=int)
    r.add_argument("--ignore-file", action="append", default=[])
    r.add_argument("--ai", action=argparse.BooleanOptionalAction)
    r.add_argument("--model")
    r.add_argument("--max-ai-cost", type=float)
    r.add_argument("--cache", action=argparse.BooleanOptionalAction)
    i = of.add_parser("init", parents=[common])
    i.add_argument("path", nargs="?", default=".")
    i.add_argument("--force", action="store_true")
    d = of.add_parser("doctor", parents=[common])
    d.add_argument("path", nargs="?", default=".")
    c = of.add_parser("cache", parents=[common])
    c.add_argument("action", choices=["clear"])
    c.add_argument("path", nargs="?", default=".")
    s = of.add_parser("split", parents=[common])
    s.add_argument("what", help="a file, or history, or rollback")
    s.add_argument("id", nargs="?", help="of an operation")
    s.add_argument("--root", default=".")
    s.add_argument("--target-dir")
    return p


def _said(value: object, text: str, as_json: bool, code: int = 0) -> int:
    print(json.dumps(value, indent=2) if as_json else text)
    return code


def _refused(why: object, code: int = 2) -> int:
    print(why, file=sys.stderr)
    return code


def _review(a: argparse.Namespace, spark: SparkSession | None) -> int:
    at = Path(a.path)
    if not at.exists():
        return _refused(f"no such file or folder: {a.path}")
    single = not at.is_dir()
    root = str((at.parent if single else at).resolve())
    overrides = {"severityThreshold": a.severity, "maxFiles": a.max_files, "ai": {"enabled": a.ai, "model": a.model, "maxEstimatedCostUsd": a.max_ai_cost}, "cache": {"enabled": a.cache}}
    settings = config.load(a.config or f"{root}/{SETTINGS}", overrides)
    provider = model_review.provider(settings, environment.environment_file(root, dict(os.environ))) if settings["ai.enabled"] else None
    report = run(spark or session(), root, settings, changed=a.changed, base=a.base, ignore_files=(".gitignore", ".loomignore", *a.ignore_file), only=at.name if single else None, provider=provider)
    s = report["summary"]
    stopped = s.get("ai", {}).get("stopped_by_budget", False)
    return _said(report, as_text(report), a.json, config.exit_code(failures=s["failed"], budget_stopped=stopped, threshold_hit=s["threshold_hit"]))


def _split(a: argparse.Namespace, spark: SparkSession | None) -> int:
    root = str(Path(a.root).resolve())
    if a.what == "history":
        rows = [r for r in transactions.history(root) if a.id in (None, r["id"])]
        if a.id and not rows:
            return _refused(f"no such operation: {a.id}")
        return _said(rows, "\n".join(f"{r['id']}  {r['status']}  {r['source']} -> {r['target']}" for r in rows) or "no operations", a.json)
    if a.what == "rollback":
        if not a.id:
            return _refused("rollback needs the id of an operation")
        try:
            status = transactions.rollback(root, a.id)
        except transactions.ApplyError as e:
            return _refused(e, SPLIT_CODES["rollback-conflict" if e.kind == "conflict" else e.kind])
        return _said({"id": a.id, "status": status}, f"{a.id}  {status}", a.json)
    settings = config.load(a.config or f"{root}/{SETTINGS}")
    wrong = splitting.input_problem(root, a.what, settings["maxFileSizeKb"])
    if wrong:
        return _refused(f"{a.what}: {wrong}")
    path = os.path.relpath(os.path.join(root, a.what), root).replace(os.sep, "/")
    report = split_report(spark or session(), root, path, settings, a.target_dir)
    bad = bool(report["failures"]) or any(p["level"] == "error" for p in report["problems"])
    return _said(report, split_text(report), a.json, SPLIT_CODES["invalid"] if bad else 0)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or (argv[0] not in COMMANDS and argv[0] not in ("-h", "--help")):
        argv.insert(0, "review")
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        if a.command == "review":
            return _review(a, spark)
        if a.command == "split":
            return _split(a, spark)
        root = str(Path(a.path).resolve())
        if a.command == "init":
            try:
                path = environment.init(root, SETTINGS, force=a.force)
            except FileExistsError:
                return _said({"status": "exists"}, f"{SETTINGS} is there already; --force replaces it", a.json)
            return _said({"status": "created", "path": path}, f"created {path}", a.json)
        if a.command == "doctor":
            rows, ok = environment.probe(root, a.config or f"{root}/{SETTINGS}", environment.environment_file(root, dict(os.environ)))
            return _said({"ok": ok, "checks": rows}, "\n".join(f"{r['status']:<4}  {r['name']}: {r['message']}" for r in rows), a.json, 0 if ok else 2)
        settings = config.load(a.config or f"{root}/{SETTINGS}")
        directory = f"{root}/{settings['cache.directory']}"
        n = cache.Cache(spark or session(), directory).clear()
        return _said({"status": "cache-cleared", "directory": directory, "deleted": n}, f"{n} entries removed from {directory}", a.json)
    except (config.ConfigurationError, model_review.ProviderError, OSError) as e:
        return _refused(e)
