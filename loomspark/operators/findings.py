"""Finding rows: filters, counts, first-wins deduplication, order, validation, model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T

CATEGORIES = ["correctness", "maintainability", "performance", "security"]


def at_least(df: DataFrame, severity: str) -> DataFrame:
    return df.where(T.severity_weight(F.col("severity")) >= T.SEVERITIES[severity])


def any_at_least(df: DataFrame, severity: str) -> DataFrame:
    hit = F.bool_or(T.severity_weight(F.col("severity")) >= T.SEVERITIES[severity])
    return df.agg(F.coalesce(hit, F.lit(False)).alias("hit"))


def dense_counts(df: DataFrame, column: str, values: list[str], *, strict: bool = False) -> DataFrame:
    """(column, n) for each value in order, zeros included: one aggregate row, unpivoted. strict: any other value is an error."""
    other = F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column), F.lit("null")))).cast("boolean")
    is_ = lambda v: F.when(F.col(column).isin(values), F.col(column) == v).otherwise(other) if strict else F.col(column) == v
    row = df.agg(*[F.count_if(is_(v)).alias(v) for v in values])
    return row.select(F.explode(F.array(*[F.struct(F.lit(v).alias(column), F.col(v).alias("n")) for v in values])).alias("x")).select("x.*")


def first_of_each(df: DataFrame, *order: str) -> DataFrame:
    """One row of each fingerprint, the first in the given order (of equal ones, that of the smallest other values). A partial minimum, so a hot fingerprint is not sorted in one task."""
    keyed = df.withColumn("fingerprint", T.fingerprint(*[F.col(c) for c in ("source", "rule_id", "rel_path", "line_start", "column_start", "message")]))
    rest = [c for c in df.columns if c not in order]
    least = keyed.groupBy("fingerprint").agg(F.min(F.struct(*order, *rest)).alias("x"))
    return least.select(*[F.col(f"x.{c}").alias(c) for c in df.columns], "fingerprint")


def ordered(df: DataFrame, *, locale: bool = False) -> DataFrame:
    path = F.expr("rel_path COLLATE UNICODE") if locale else F.col("rel_path")
    return df.orderBy(path, "line_start", "column_start", F.desc(T.severity_weight(F.col("severity"))), "rule_id")


def limit_with_rest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key with their rank, and on each how many were left out. The limit is the feature; only n rows are ranked."""
    total = df.agg(F.count("*").alias("_all"))
    top = df.orderBy(key).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(key))).join(F.broadcast(total)).withColumn("left_out", F.greatest(F.col("_all") - n, F.lit(0))).drop("_all")


def is_valid(prefix: str = "") -> Column:
    """Whether a row meets the data model of findings; null suggestion and confidence are allowed."""
    c = lambda n: F.col(prefix + n)
    ok = F.lit(True)
    for n in ("source", "rule_id", "title", "message", "rel_path"):
        ok = ok & (F.length(c(n)) > 0)
    for n in ("line_start", "column_start", "line_end", "column_end"):
        ok = ok & (c(n) > 0)
    after = (c("line_end") > c("line_start")) | ((c("line_end") == c("line_start")) & (c("column_end") >= c("column_start")))
    ok = ok & c("severity").isin(*T.SEVERITIES) & c("category").isin(CATEGORIES) & after & c("fixable").isNotNull() & (c("confidence").isNull() | c("confidence").between(0, 1))
    return F.coalesce(ok, F.lit(False))


# What a model's row gets where it says nothing.
RULE, TITLE, MESSAGE, SUGGESTION, CONFIDENCE, LEAST_CONFIDENCE = "ai/code-issue", "Code Issue", "Potential issue identified in code.", "Review and update the code.", 0.85, 0.65


def sanitised(raw: DataFrame) -> DataFrame:
    """Model rows, with their other columns, in the shape of findings.

    Reads rule_id (else rule, else type), severity, category, title, message (else description), line_start
    (else line), line_end, suggestion and confidence; columns that raw lacks are null.
    """
    kinds = dict.fromkeys(("rule_id", "rule", "type", "severity", "category", "title", "message", "description", "suggestion"), "string") | dict.fromkeys(("line", "line_start", "line_end"), "int") | {"confidence": "double"}
    c = {n: F.col(n).cast(t) if n in raw.columns else F.lit(None).cast(t) for n, t in kinds.items()}
    said = {n: F.nullif(T.trimmed(c[n]), F.lit("")) for n in ("title", "message", "description", "suggestion")}
    named = F.coalesce(c["rule_id"], F.nullif(c["rule"], F.lit("")), F.nullif(c["type"], F.lit("")), F.lit(RULE))
    start = F.coalesce(c["line_start"], F.nullif(c["line"], F.lit(0)), F.lit(1))
    sure = F.when(F.isnan(c["confidence"]), None).otherwise(c["confidence"])
    made = {
        "rule_id": T.slug_rule(named), "severity": F.when(c["severity"].isin("low", "medium", "high"), c["severity"]).otherwise("medium"), "category": F.when(c["category"].isin(CATEGORIES), c["category"]).otherwise("correctness"),
        "title": F.coalesce(said["title"], F.substring(said["message"], 1, 60), F.lit(TITLE)), "message": F.coalesce(said["message"], said["description"], F.lit(MESSAGE)), "line_start": start, "line_end": F.coalesce(c["line_end"], start),
        "suggestion": F.coalesce(said["suggestion"], F.lit(SUGGESTION)), "confidence": F.least(F.greatest(F.coalesce(sure, F.lit(CONFIDENCE)), F.lit(0.0)), F.lit(1.0)),
    }
    return raw.select(*[x for x in raw.columns if x not in kinds], *[v.alias(n) for n, v in made.items()])


def inside_chunk() -> Column:
    """The line guard: a row's lines stand in order and inside its chunk (chunk_line_start, chunk_line_end)."""
    return F.coalesce((F.col("line_start") >= F.col("chunk_line_start")) & (F.col("line_end") <= F.col("chunk_line_end")) & (F.col("line_end") >= F.col("line_start")), F.lit(False))


def normalised(clean: DataFrame) -> DataFrame:
    """Sanitised rows (with rel_path and the bounds of their chunk) as valid findings of the model: sure enough, inside the chunk, valid."""
    named = {"source": F.lit("ai"), "title": T.trimmed(F.col("title")), "message": T.trimmed(F.col("message")), "column_start": F.lit(1), "column_end": F.lit(1), "suggestion": F.nullif(T.trimmed(F.col("suggestion")), F.lit("")), "fixable": F.lit(False)}
    return confident(clean).where(inside_chunk()).withColumns(named).drop("chunk_line_start", "chunk_line_end").where(is_valid())


def confident(df: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    return df.where(F.col("confidence") >= least)
