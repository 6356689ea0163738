"""A review of source files: parse once, apply the code rules, keep what the scope covers, drop repeats, order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.frontend import nodes as N
from loomspark.frontend import outline, rules
from loomspark.operators import findings as O
from loomspark.operators import intervals as I
from loomspark.plans.store import written


@dataclass
class Options:
    """Which rule families run, and their limits."""

    complexity: dict[str, int] | None = field(default_factory=lambda: dict(rules.COMPLEXITY_LIMITS))
    react: dict[str, int] | None = field(default_factory=lambda: dict(rules.REACT_LIMITS))
    lint: list[str] | None = field(default_factory=lambda: list(rules.LINT))


@dataclass
class Review:
    nodes: DataFrame
    findings: DataFrame
    failures: DataFrame

    def summary(self) -> DataFrame:
        """One row: files parsed and failed, functions, components, effects, states, findings."""
        n = self.nodes
        counts = n.agg(F.count_if(F.col("type") == "Program").alias("parsed"), F.count_if(F.col("type") == "#failure").alias("failed"), F.count_if(F.col("type").isin(*N.FUNCTIONS)).alias("functions"))
        more = {"components": rules.components(n), "effects": rules.effects(n), "states": rules.states(n), "findings": self.findings}
        for name, df in more.items():
            counts = counts.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))  # one row each
        return counts


def review(files: DataFrame, ranges: DataFrame | None = None, options: Options | None = None) -> Review:
    """files: rel_path, source_text. ranges: changed lines (rel_path, start, end), or none for all. The nodes are stored: every rule reads them."""
    options = options or Options()
    nodes = written(N.parsed(files), "nodes")
    parts = []
    if options.lint:
        parts.append(rules.lint_findings(nodes, options.lint).withColumn("emit_ord", F.lit(1)))
    if options.complexity:
        parts.append(rules.complexity_findings(nodes, options.complexity).withColumn("emit_ord", F.lit(2)))
    if options.react:
        parts.append(rules.react_findings(nodes, options.react).withColumn("emit_ord", F.lit(3)))
    if not parts:
        raise ValueError("no rule family is on")
    found = written(rules.union(parts), "findings")
    kept = O.first_of_each(I.in_scope(found, ranges), "emit_ord", "line_end", "column_end", "severity").dropDuplicates(["fingerprint"])
    return Review(nodes, O.ordered(kept).select(*rules.FINDING), N.failures(nodes))


def chunks(files: DataFrame, nodes: DataFrame, ranges: DataFrame | None = None, *, max_tokens: int = 12_000) -> DataFrame:
    """Chunks for a reviewer; with ranges, those that meet changed lines."""
    return I.in_scope(outline.chunks(files, nodes, max_tokens=max_tokens), ranges)
