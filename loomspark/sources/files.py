"""Source files as a table: listing, ignore and include rules, size limit, binary guard, limit with counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources import ignore

#: Ignore rules that become one expression.
FEW_RULES = 50


def listing(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, ext, size_bytes of every file below root; contents are not read (binaryFile prunes them)."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", F.col("length").alias("size_bytes"))
    rel = F.regexp_replace("path", "^.*?" + _quoted(base.split(":", 1)[-1].lstrip("/")) + "/", "")
    return files.select(rel.alias("rel_path"), F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("ext"), "size_bytes")


def single(spark: SparkSession, path: str) -> DataFrame:
    """The listing of one file. It is reviewed whatever the ignore and include rules say; only the size limit holds."""
    file = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"))
    return file.select(F.regexp_extract("path", "([^/]+)$", 1).alias("rel_path"), F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("ext"), "size_bytes")


def without_links(files: DataFrame, links: list[str]) -> DataFrame:
    """files without those that are symbolic links or stand below one. links: all of a local root; other storage has none."""
    below = [F.col("rel_path").startswith(f"{link}/") for link in links]
    return files.where(~reduce(Column.__or__, below, F.col("rel_path").isin(links))) if links else files


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def discovered(files: DataFrame, *, include: list[str], exclude: list[str], max_kb: int, allowed: DataFrame | None = None) -> DataFrame:
    """files with status: ok, ignored or too-large; paths that no include pattern names are dropped.

    An allow-list (rel_path) takes the place of the include patterns. Up to FEW_RULES rules are one expression, more are a table
    that paths are joined with; the answers are the same.
    """
    kept = files.join(allowed.select("rel_path").distinct(), "rel_path", "left_semi") if allowed is not None else files.where(ignore.is_included(F.col("rel_path"), include))
    out = ignore.is_ignored(F.col("rel_path"), exclude if len(exclude) <= FEW_RULES else [])
    if len(exclude) > FEW_RULES:
        lines = files.sparkSession.createDataFrame(list(enumerate(exclude)), "no long, line string")
        bad = ignore.ignored_by(kept.select(F.col("rel_path").alias("path")), lines)
        kept, out = kept.join(bad.select(F.col("path").alias("rel_path"), F.lit(True).alias("out")), "rel_path", "left"), F.coalesce("out", F.lit(False))
    status = F.when(out, "ignored").when(F.col("size_bytes") > max_kb * 1024, "too-large").otherwise("ok")
    return kept.withColumn("status", status).drop("out")


def skip_counters(found: DataFrame, max_files: int) -> DataFrame:
    return found.agg(F.count_if(F.col("status") == "ignored").alias("ignored"), F.count_if(F.col("status") == "too-large").alias("too_large"), F.greatest(F.count_if(F.col("status") == "ok") - max_files, F.lit(0)).alias("limited"))


def contents(spark: SparkSession, root: str, files: DataFrame, only: str | None = None) -> DataFrame:
    """rel_path, source_text of the ok files; binary is true and the text null where a NUL byte occurs. only: the one file to read."""
    base = root.rstrip("/")
    read = spark.read.format("binaryFile").load(f"{base}/{only}") if only else spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.regexp_replace("path", "^.*?" + _quoted(base.split(":", 1)[-1].lstrip("/")) + "/", "")
    text = F.decode("content", "UTF-8")
    rows = read.select(rel.alias("rel_path"), text.alias("t")).join(files.where("status = 'ok'").select("rel_path"), "rel_path", "left_semi")
    binary = F.contains("t", F.lit("\u0000"))
    return rows.select("rel_path", F.when(~binary, F.col("t")).alias("source_text"), binary.alias("binary"))
