"""Changed files and lines from git's output, as tables."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import intervals

STATUS = {"A": "added", "D": "deleted", "R": "renamed", "C": "copied"}


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", check=True).stdout


def git_root(folder: str) -> str | None:
    """The top folder of the repository that holds folder; None outside of one."""
    told = subprocess.run(["git", "-C", folder, "rev-parse", "--show-toplevel"], capture_output=True, text=True, check=False)
    return told.stdout.strip() if told.returncode == 0 else None


def _against(root: str, base: str | None) -> list[str]:
    """What a diff compares: the merge base and HEAD, or HEAD (of a repository without commits the empty tree) and the working tree."""
    if base:
        return [git(root, "merge-base", base, "HEAD").strip(), "HEAD"]
    born = subprocess.run(["git", "-C", root, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True, check=False).returncode == 0
    return ["HEAD"] if born else [git(root, "hash-object", "-t", "tree", "/dev/null").strip()]


def changed_files(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """rel_path (from root, which may be a folder of the repository), status: against the merge base with base, or the working tree with untracked files; first of each path, by path."""
    cells = git(root, "diff", "--name-status", "--no-renames", "--relative", "-z", *_against(root, base)).split("\0")
    found = {path: STATUS.get(status[:1], "modified") for status, path in reversed(list(zip(cells[::2], cells[1::2], strict=False)))}
    if not base:
        found |= {p: "added" for p in git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if p and p not in found}
    return spark.createDataFrame(sorted(found.items()), "rel_path string, status string").where(~F.col("rel_path").startswith(".."))


def _by_file(told: str) -> dict[str, str]:
    parts = ((part, [line[6:] for line in part.splitlines()[:8] if line.startswith("+++ b/")]) for part in told.split("\ndiff --git "))
    return {named[0].rstrip("\t"): part for part, named in parts if named}


def diffs(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """rel_path, diff (without context lines) of every tracked file that changed, from one call of git.

    Where that call fails, each file is asked for alone; those that fail again have a null diff.
    """
    against = _against(root, base)
    ask = ("-c", "core.quotePath=false", "diff", "--unified=0", "--no-renames", "--no-color", "--no-ext-diff", "--relative", *against)
    found: dict[str, str | None] = {}
    try:
        found |= _by_file(git(root, *ask))
    except subprocess.CalledProcessError:
        for path in filter(None, git(root, "diff", "--name-only", "--no-renames", "--relative", "-z", *against).split("\0")):
            try:
                found |= _by_file(git(root, *ask, "--", path))
            except subprocess.CalledProcessError:
                found[path] = None
    return spark.createDataFrame(sorted(found.items()), "rel_path string, diff string")


def changed_ranges(diffs: DataFrame, files: DataFrame) -> DataFrame:
    """(rel_path, start, end). diffs: rel_path, diff (unified, no context; null where it failed). files: rel_path, status, source_text.

    Added files, and others whose diff failed, change as a whole (an added one without a text in line 1, another not at all); deleted ones change nowhere.
    """
    other = files.where("status not in ('added', 'deleted')")
    hunks = diffs.join(other.select("rel_path"), "rel_path", "left_semi").select("rel_path", F.explode(T.hunks(F.col("diff"))).alias("h")).select("rel_path", F.col("h.start").alias("start"), F.col("h.end").alias("end"))
    failed = other.where("source_text is not null").join(diffs.where("diff is null"), "rel_path", "left_semi")
    end = F.coalesce(T.line_count(F.col("source_text")).cast("int"), F.lit(1))
    whole = files.where("status = 'added'").unionByName(failed).select("rel_path", F.lit(1).alias("start"), end.alias("end"))
    return intervals.merged(hunks.unionByName(whole), ["rel_path"])
