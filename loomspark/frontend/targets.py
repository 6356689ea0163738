"""Files that split candidates would move to: names, allocation within a file's plan, and clashes with what exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.frontend.dependencies import joined_path

# Endings that a file's name loses, names that say nothing, what a symbol's name loses at both ends, endings of the target by kind, and names of kinds for people.
LOST = "(?i)(?:[-_.]?(?:page|view|screen|container|component))+$"
SAYS_NOTHING = ["index", "main", "app", "mod", "module"]
VERBS = "(?i)^(fetch|get|post|put|delete|update|handle|use|format|calc|calculate)"
NOUNS = "(?i)(Service|Utils|Constants|Labels|Config|Data|State|Status)$"
ENDINGS = {"service": ".service.js", "utility": ".utils.js", "constant-group": ".constants.js"}
KIND_NAMES = {"react-component": "React component", "custom-hook": "custom hook", "service": "service", "utility": "utility", "constant-group": "constant group"}


def stem(path: Column) -> Column:
    """The file's name without its last extension; a leading dot begins none."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def singular(name: Column) -> Column:
    return F.when(F.length(name) > 3, F.regexp_replace(name, "s$", "")).otherwise(name)


def domain(symbol: Column, source: Column) -> Column:
    """The word that names a group of moved parts: from the file's name, else from the symbol's."""
    of_file = singular(F.regexp_replace(F.lower(F.regexp_replace(stem(source), LOST, "")), "[-_.]+$", ""))
    of_symbol = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(symbol, F.lit("")), VERBS, ""), NOUNS, ""))
    told = F.when((of_file != "") & ~of_file.isin(SAYS_NOTHING), of_file)
    return F.coalesce(told, F.when(of_symbol != "", singular(of_symbol)), F.when(of_file != "", of_file), F.lit("common"))


def file_name(kind: Column, symbol: Column, source: Column) -> Column:
    safe = F.regexp_replace(symbol, "[^a-zA-Z0-9_.-]", "")
    grouped = F.coalesce(*[F.when(kind == k, F.concat(domain(symbol, source), F.lit(ending))) for k, ending in ENDINGS.items()])
    return F.coalesce(grouped, F.concat(safe, F.when(kind == "react-component", ".jsx").otherwise(".js")))


def folder(source: Column) -> Column:
    """A folder beside the source file, named like it."""
    return F.regexp_replace(F.concat_ws("/", F.regexp_replace(source, "/?[^/]*$", ""), stem(source)), "^/+", "")


def kind_name(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in KIND_NAMES.items()], kind)


def relative_import(source: Column, target: Column) -> Column:
    """How source names target in an import: relative, with a leading dot. Both are paths from the same root."""
    a, b = F.filter(F.split(F.regexp_replace(source, "/?[^/]*$", ""), "/"), lambda p: p != ""), F.split(target, "/")
    places = F.sequence(F.lit(0), F.least(F.size(a), F.size(b) - 1))
    same = lambda n: F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)
    common = F.array_max(F.filter(places, same))
    path = F.concat(F.repeat(F.lit("../"), F.size(a) - common), F.array_join(F.slice(b, common + 1, F.size(b)), "/"))
    return F.when(path.startswith("."), path).otherwise(F.concat(F.lit("./"), path))


def allocated(candidates: DataFrame, target_folder: str | None = None) -> DataFrame:
    """candidates (rel_path, kind, symbol, line_start, ...) with target_file.

    Parts of one kind share a file. Where a file is taken by another kind (that of its first part by line and symbol), a part
    gets a file named like itself. A folder that leaves the root is an error.
    """
    at = folder(F.col("rel_path")) if target_folder is None else F.lit(target_folder.replace("\\", "/"))
    path = lambda name: F.coalesce(joined_path(at, name), F.raise_error(F.concat(F.lit("target folder leaves the root: "), at)).cast("string"))
    out = candidates.withColumn("_first", path(file_name(F.col("kind"), F.col("symbol"), F.col("rel_path"))))
    holder = F.first("kind").over(Window.partitionBy("rel_path", "_first").orderBy("line_start", "symbol"))
    own = path(F.concat(F.regexp_replace("symbol", "[^a-zA-Z0-9_.-]", ""), F.lit(".js")))
    return out.withColumn("_holder", holder).withColumn("target_file", F.when(F.col("_holder") == F.col("kind"), F.col("_first")).otherwise(own)).drop("_first", "_holder")


def conflicts(targets: DataFrame, listing: DataFrame) -> DataFrame:
    """rel_path, id, target_file, reason: targets that exist already (listing: rel_path of all files)."""
    there = listing.select(F.col("rel_path").alias("target_file")).distinct()
    return targets.join(there, "target_file", "left_semi").select("rel_path", "id", "target_file", F.format_string('Target file already exists: "%s"', "target_file").alias("reason"))
