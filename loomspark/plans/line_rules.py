"""Rules over the lines of a text table, as finding rows; the relational part of a review without a parser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG, SHOUT = 200, 20


def lines(texts: DataFrame) -> DataFrame:
    """rel_path, line_start (from 1), line."""
    return texts.select("rel_path", F.posexplode(F.split(F.coalesce("source_text", F.lit("")), "\n", -1))).select("rel_path", (F.col("pos") + 1).alias("line_start"), F.col("col").alias("line"))


def findings(texts: DataFrame) -> DataFrame:
    """One pass over the lines, without a shuffle: each line carries the array of its findings, so rules share the scan, and meets the line before inside its text's array."""
    split = F.split(F.coalesce("source_text", F.lit("")), "\n", -1)
    beside = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_start"), x.alias("line"), F.coalesce((i > 0) & (F.get("lines", i - 1) == x) & (x != ""), F.lit(False)).alias("again")))
    base = texts.select("rel_path", split.alias("lines")).select("rel_path", F.explode(beside).alias("x")).select("rel_path", "x.*", F.length("x.line").alias("n"))
    made = lambda ord_, source, rule, severity, category, message: F.struct(F.lit(ord_).alias("emit_ord"), F.lit(source).alias("source"), F.lit(rule).alias("rule_id"), severity.alias("severity"), F.lit(category).alias("category"), message.alias("message"))
    long_ = F.when(F.col("n") > LONG, made(2, "complexity", "text/long-line", F.when(F.col("n") >= 2 * LONG, "high").otherwise("medium"), "maintainability", F.concat(F.lit("Line has "), F.col("n").cast("string"), F.lit(" characters"))))
    again = F.when(F.col("again"), made(1, "eslint", "text/repeated-line", F.lit("low"), "maintainability", F.lit("Line repeats the one before")))
    loud = F.when((F.col("n") >= SHOUT) & (F.upper("line") == F.col("line")) & (F.lower("line") != F.col("line")), made(3, "react", "text/shouting", F.lit("critical"), "correctness", F.lit("Line is in capitals")))
    out = base.select("rel_path", "line_start", F.explode(F.array_compact(F.array(again, long_, loud))).alias("f"))
    return out.select(
        "f.source", "f.rule_id", "f.severity", "f.category", F.col("f.rule_id").alias("title"), "f.message", "rel_path", "line_start", F.lit(1).alias("column_start"), F.col("line_start").alias("line_end"), F.lit(1).alias("column_end"),
        F.lit(None).cast("string").alias("suggestion"), F.lit(False).alias("fixable"), F.lit(None).cast("double").alias("confidence"), "f.emit_ord",
    )
