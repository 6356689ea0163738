"""Top-level outlines of files: imports, exports, functions, classes, and chunks of code for a reviewer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.frontend.nodes import FUNCTIONS
from loomspark.functions import text as T

#: Tokens that a chunk costs besides its code and imports.
OVERHEAD = 150


def imports(nodes: DataFrame) -> DataFrame:
    """rel_path, node_id, import_source, n_specifiers, line, and bounds of the text."""
    specifiers = nodes.where("parent_type = 'ImportDeclaration' and role = 'specifier'").groupBy("rel_path", F.col("parent_id").alias("node_id")).agg(F.count("*").cast("int").alias("n"))
    found = nodes.where("type = 'ImportDeclaration'").join(specifiers, ["rel_path", "node_id"], "left")
    return found.select("rel_path", "node_id", F.col("value").alias("import_source"), F.coalesce("n", F.lit(0)).alias("n_specifiers"), F.col("line_start").alias("line"), "off_start", "off_end")


def bindings_imported(nodes: DataFrame) -> DataFrame:
    """rel_path, import_source, imported_name, local_name, kind (default, named or namespace), line."""
    local = nodes.where("binding_kind = 'import' and access = 'd'").select("rel_path", F.col("parent_id").alias("node_id"), F.col("name").alias("local_name"), F.col("grand_id"))
    spec = nodes.where("parent_type = 'ImportDeclaration' and role = 'specifier'").select("rel_path", "node_id", "type", F.col("name").alias("imported"), "line_start")
    source = nodes.where("type = 'ImportDeclaration'").select("rel_path", F.col("node_id").alias("grand_id"), F.col("value").alias("import_source"))
    kind = F.when(F.col("type") == "ImportDefaultSpecifier", "default").when(F.col("type") == "ImportNamespaceSpecifier", "namespace").otherwise("named")
    both = local.join(spec, ["rel_path", "node_id"]).join(source, ["rel_path", "grand_id"])
    return both.select("rel_path", "import_source", F.when(kind == "default", "default").when(kind == "namespace", "*").otherwise(F.col("imported")).alias("imported_name"), "local_name", kind.alias("kind"), F.col("line_start").alias("line"))


def units(nodes: DataFrame) -> DataFrame:
    """Top-level functions and classes, also those exported or assigned to a variable.

    rel_path, node_id, name, type, is_async, line (of the declaration or declarator), and bounds of the whole statement
    (export included); is_default for default exports.
    """
    outer = nodes.where("parent_type = 'Program' and role = 'body'").select("rel_path", F.col("node_id").alias("top_id"), F.col("type").alias("top_type"), *[F.col(c).alias(f"top_{c}") for c in ("line_start", "line_end", "off_start", "off_end")])
    default = F.col("parent_type") == "ExportDefaultDeclaration"
    direct = nodes.where("type in ('FunctionDeclaration', 'ClassDeclaration')").where((F.col("parent_type").isin("Program", "ExportNamedDeclaration")) | default)
    direct = direct.unionByName(nodes.where("type in ('FunctionExpression', 'ArrowFunctionExpression')").where(default))
    direct = direct.select("rel_path", "top_id", "node_id", "type", F.coalesce("name", F.when(default, "defaultExport").otherwise("anonymous")).alias("name"), F.array_contains("flags", "async").alias("is_async"), F.col("line_start").alias("line"), default.alias("is_default"))
    valued = nodes.where("type in ('FunctionExpression', 'ArrowFunctionExpression') and role = 'init' and parent_type = 'VariableDeclarator' and depth <= 4 and fn_id is null and class_id is null")
    outermost = nodes.where("type = 'VariableDeclaration' and parent_type in ('Program', 'ExportNamedDeclaration')").select("rel_path", F.col("node_id").alias("grand_id"))
    held = nodes.where("type = 'VariableDeclarator'").select("rel_path", F.col("node_id").alias("parent_id"), F.col("line_start").alias("line"))
    ids = nodes.where("parent_type = 'VariableDeclarator' and role = 'id'").select("rel_path", "parent_id", F.coalesce("name", F.lit("anonymous")).alias("held_name"))
    valued = valued.join(outermost, ["rel_path", "grand_id"], "left_semi").join(held, ["rel_path", "parent_id"]).join(ids, ["rel_path", "parent_id"])
    valued = valued.select("rel_path", "top_id", "node_id", "type", F.col("held_name").alias("name"), F.array_contains("flags", "async").alias("is_async"), "line", F.lit(False).alias("is_default"))
    return direct.unionByName(valued).join(outer, ["rel_path", "top_id"])


def exports(nodes: DataFrame) -> DataFrame:
    """rel_path, kind (named, default or all), name, line."""
    named = nodes.where("type in ('ExportSpecifier', 'ExportNamespaceSpecifier')").select("rel_path", F.lit("named").alias("kind"), "name", F.col("parent_id").alias("node_id"))
    declared = nodes.where("type in ('FunctionDeclaration', 'ClassDeclaration') and parent_type = 'ExportNamedDeclaration'").select("rel_path", F.lit("named").alias("kind"), "name", F.col("parent_id").alias("node_id"))
    holder = nodes.where("type = 'VariableDeclaration' and parent_type = 'ExportNamedDeclaration'").select("rel_path", F.col("node_id").alias("grand_id"), F.col("parent_id").alias("export_id"))
    variables = nodes.where("parent_type = 'VariableDeclarator' and role = 'id'").join(holder, ["rel_path", "grand_id"]).select("rel_path", F.lit("named").alias("kind"), F.coalesce("name", F.lit("anonymous")).alias("name"), F.col("export_id").alias("node_id"))
    default = nodes.where("parent_type = 'ExportDefaultDeclaration' and role = 'declaration'").select("rel_path", F.lit("default").alias("kind"), F.coalesce("name", F.lit("default")).alias("name"), F.col("parent_id").alias("node_id"))
    every = nodes.where("type = 'ExportAllDeclaration'").select("rel_path", F.lit("all").alias("kind"), F.concat(F.lit("* from "), "value").alias("name"), "node_id")
    lines = nodes.where(F.col("type").startswith("Export") & (F.col("parent_type") == "Program")).select("rel_path", "node_id", F.col("line_start").alias("line"))
    return named.unionByName(declared).unionByName(variables).unionByName(default).unionByName(every).join(lines, ["rel_path", "node_id"]).select("rel_path", "kind", "name", "line")


def summaries(nodes: DataFrame) -> DataFrame:
    """One row per file that parses: statement_count and the arrays imports, exports, functions, classes and react_component_candidates."""
    files = nodes.where("type = 'Program'").select("rel_path")
    count = nodes.where("parent_type = 'Program' and role = 'body'").groupBy("rel_path").agg(F.count("*").cast("int").alias("statement_count"))
    gather = lambda df, name, *cols: df.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    u = units(nodes).withColumn("name", F.when(F.col("is_default") & (F.col("name") == "defaultExport"), "default").otherwise(F.col("name")))
    kind = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in FUNCTIONS.items()])
    parts = [
        gather(imports(nodes), "imports", "line", "import_source", "n_specifiers"), gather(exports(nodes), "exports", "line", "kind", "name"),
        gather(u.where("type <> 'ClassDeclaration'"), "functions", "line", "name", kind.alias("kind"), "is_async"), gather(u.where("type = 'ClassDeclaration'"), "classes", "line", "name"),
        gather(u.where("name rlike '^[A-Z]'"), "react_component_candidates", "line", "name", F.when(F.col("type") == "ClassDeclaration", "class").otherwise("function").alias("kind")),
    ]
    out = files.join(count, "rel_path", "left").withColumn("statement_count", F.coalesce("statement_count", F.lit(0)))
    for p in parts:
        out = out.join(p, "rel_path", "left")
        name = p.columns[-1]
        out = out.withColumn(name, F.coalesce(name, F.array().cast(p.schema[name].dataType)))
    return out


def chunks(files: DataFrame, nodes: DataFrame, *, max_tokens: int = 12_000) -> DataFrame:
    """A chunk for each unit of each file (rel_path, source_text), the whole file where it has none.

    id, rel_path, kind, symbol, bounds, code, imports (texts of the file's imports), tokens, and reason: token-limit for chunks over
    max_tokens. Of units of the same lines the first stays. Files without code, and files that do not parse, have none.
    """
    cut = lambda a, b: F.regexp_replace(F.substring(F.col("source_text"), F.col(a) + 1, F.col(b) - F.col(a)), r"(?U)\A\s+|\s+\z", "")
    texts = files.select("rel_path", "source_text")
    u = units(nodes)
    kind = F.when(T.is_component(F.col("name")), "react-component").when(F.col("type") == "ClassDeclaration", "class-declaration").otherwise(F.coalesce(*[F.when(F.col("type") == k, v) for k, v in FUNCTIONS.items()]))
    cuts = u.select("rel_path", kind.alias("kind"), F.col("name").alias("symbol"), F.col("top_line_start").alias("line_start"), F.col("top_line_end").alias("line_end"), F.col("top_off_start").alias("a"), F.col("top_off_end").alias("b"), "node_id")
    cuts = cuts.withColumn("nth", F.row_number().over(Window.partitionBy("rel_path", "line_start", "line_end").orderBy("node_id"))).where("nth = 1").drop("nth", "node_id")
    # each text meets the list of its cuts once
    lists = cuts.groupBy("rel_path").agg(F.collect_list(F.struct("kind", "symbol", "line_start", "line_end", "a", "b")).alias("cuts"))
    context = imports(nodes).groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("off_start", "off_end"))).alias("imported"))
    whole = F.array(F.struct(F.lit("module").alias("kind"), F.lit("module").alias("symbol"), F.lit(1).alias("line_start"), F.size(F.split("source_text", "\r?\n", -1)).alias("line_end"), F.lit(0).alias("a"), F.length("source_text").alias("b")))
    ok = nodes.where("type = 'Program'").select("rel_path")
    out = texts.where(F.rlike("source_text", F.lit(r"(?U)\S"))).join(ok, "rel_path", "left_semi").join(lists, "rel_path", "left").join(context, "rel_path", "left")
    out = out.withColumn("imports", F.coalesce(F.transform("imported", lambda i: F.substring(F.col("source_text"), i["off_start"] + 1, i["off_end"] - i["off_start"])), F.array().cast("array<string>")))
    out = out.select("rel_path", "source_text", "imports", F.explode(F.coalesce("cuts", whole)).alias("c")).select("rel_path", "source_text", "imports", "c.*")
    out = out.withColumn("code", cut("a", "b")).withColumn("tokens", T.token_estimate(F.col("code")) + T.token_estimate(F.array_join("imports", "\n")) + OVERHEAD)
    return out.select(F.concat_ws(":", "rel_path", "symbol", F.concat_ws("-", "line_start", "line_end")).alias("id"), "rel_path", "kind", "symbol", "line_start", "line_end", "code", "imports", "tokens", F.when(F.col("tokens") > max_tokens, "token-limit").alias("reason"))
