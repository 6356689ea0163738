"""Ignore rules of the gitignore dialect, and include globs, as regular expressions over relative paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import normal_path


def glob(pattern: str) -> str:
    """Regular expression of a glob: ** crosses folders, * and ? stay inside one, [..] and {a,b} as usual."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + (".+" if pattern[i - 1 : i] == "/" else ".*"), i + 2  # what is inside, not the folder itself
            continue
        if c == "*" and pattern[i - 1 : i] in ("", "/") and pattern[i + 1 : i + 2] in ("", "/"):
            out, i = out + "[^/]+", i + 1  # a whole name
            continue
        if c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            continue
        if c == "{" and "}" in pattern[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return out


def rule(line: str) -> tuple[str, bool] | None:
    """(expression, negated) of one line; blank lines and comments have none. Folders' paths end in a slash; case does not count."""
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[1:] if negated else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
    folder = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    return ("(?i)^" + ("" if anchored else "(?:.*/)?") + glob(body) + ("/$" if folder else "/?$"), negated)


def key_of(line: str) -> str | None:
    """What a path must have to match a rule: P and its first folders, N and its last name, or X and what follows its last dot; all in lower case.

    A rule of several names is keyed by those before its first wild card, one of a single name by the name or its ending; * if it has none of them.
    """
    if rule(line) is None:
        return None
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r\n"))
    body = line[1:] if line.startswith("!") else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
    body = body.rstrip("/")
    name = body.removeprefix("**/")
    if "/" in name:
        lead = []
        for part in body.removeprefix("/").split("/"):
            if _WILD.search(part):
                break
            lead.append(part)
        return "P" + "/".join(lead).lower()
    if not _WILD.search(name):
        return "N" + name.lower()
    ending = name.rpartition(".")[2]
    return "X" + ending.lower() if "." in name and not _WILD.search(ending) and not re.search(r"[\[{]", name) else "*"


_WILD = re.compile(r"[*?\[{]")


def _above(clean: Column) -> Column:
    """A path and the folders above it, these with a slash at their end."""
    parts = F.split(clean, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.when(n < F.size(parts), "/").otherwise("")))


def rule_table(lines: DataFrame) -> DataFrame:
    """no, key, expression and negated of the rules in lines (no, line); lines without a rule are left out."""

    def parsed(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            rows = [(no, key_of(x), *rule(x)) for no, x in zip(b["no"], b["line"], strict=True) if x is not None and rule(x)]
            yield pd.DataFrame(rows, columns=["no", "key", "expression", "negated"])

    return lines.select(F.col("no").cast("long").alias("no"), "line").mapInPandas(parsed, "no long, key string, expression string, negated boolean")


def ignored_by(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """The distinct rows of paths (path) that the rules in lines (no, line) leave out, as is_ignored() says, with any number of rules.

    Each folder is decided once for all files below it: it meets the rules that share one of its keys (the
    tree of its leading folders, its name, its ending), and of those whose expression matches the one with the largest number decides.
    """
    own = paths.select("path").distinct().withColumn("clean", normal_path(F.coalesce("path", F.lit(""))))
    own = own.where(~F.coalesce(F.col("clean").isin("", "."), F.lit(False)))
    outside = F.col("clean").rlike(r"^\.\.(?:/|$)")
    steps = own.where(~outside).select("path", F.explode(_above(F.col("clean"))).alias("step"))
    names = F.split(F.lower(F.regexp_replace("step", "/$", "")), "/", -1)
    last = F.element_at(names, -1)
    leads = F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: F.concat(F.lit("P"), F.array_join(F.slice(names, F.lit(1), n), "/")))
    keys = F.concat(leads, F.array(F.lit("*"), F.concat(F.lit("N"), last), F.concat(F.lit("X"), F.regexp_extract(last, r"([^.]*)$", 1))))
    met = steps.select("step").distinct().select("step", F.explode(F.array_distinct(keys)).alias("key")).join(rule_table(lines), "key").where(F.expr("step rlike expression"))
    bad = met.groupBy("step").agg(F.max_by("negated", "no").alias("negated")).where("not negated").select("step")
    return own.where(outside).select("path").unionByName(steps.join(bad, "step", "left_semi").select("path").distinct())


def is_ignored(path: Column, lines: list[str]) -> Column:
    """Whether the rules leave out a path, or a folder above it: nothing below an ignored folder comes back.

    One expression for each rule: for a few rules; ignored_by() takes any number. For each of them the last matching rule decides. Back slashes and leading ./ and / are normalised away;
    '' and '.' are never ignored, paths that leave the root always are.
    """
    rules = list(filter(None, map(rule, lines)))

    def decided(p: Column) -> Column:
        out = F.lit(False)
        for expression, negated in rules:
            out = F.when(p.rlike(expression), F.lit(not negated)).otherwise(out)
        return out

    clean = normal_path(F.coalesce(path, F.lit("")))
    return F.when(clean.isin("", "."), False).when(clean.rlike(r"^\.\.(?:/|$)"), True).otherwise(F.exists(_above(clean), decided))


def is_included(path: Column, patterns: list[str]) -> Column:
    return path.rlike("^(?:" + "|".join(glob(p) for p in patterns) + ")$") if patterns else F.lit(True)
