"""Graphs of source files: what top-level declarations and files depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.frontend.nodes import parsed
from loomspark.operators.cycles import cycle_paths
from loomspark.operators.graph import closure
from loomspark.plans.store import written

# The endings tried for a relative import, in order.
ENDINGS = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]


def declarations(nodes: DataFrame) -> DataFrame:
    """Top-level functions, classes and variables with a plain name.

    rel_path, decl_id, name, kind, line_start, line_end, exported, is_default, and last_id. Kinds: custom-hook, react-component,
    class, function, constant, variable, by the first that fits.
    """
    outer = nodes.where("parent_type = 'Program' and role = 'body'").select("rel_path", F.col("node_id").alias("top_id"), F.col("type").alias("top_type"))
    whole = nodes.where("type in ('FunctionDeclaration', 'ClassDeclaration') and parent_type in ('Program', 'ExportNamedDeclaration', 'ExportDefaultDeclaration') and name is not null")
    whole = whole.select("rel_path", "top_id", F.col("node_id").alias("decl_id"), "last_id", "name", "line_start", "line_end", "type", F.lit(None).cast("string").alias("var_kind"), F.col("node_id").alias("value_id"), F.lit(None).cast("string").alias("value_path"))
    statement = nodes.where("type = 'VariableDeclaration' and parent_type in ('Program', 'ExportNamedDeclaration')").select("rel_path", F.col("node_id").alias("parent_id"), F.col("op").alias("var_kind"))
    declarators = nodes.where("type = 'VariableDeclarator'").select("rel_path", "top_id", F.col("node_id").alias("decl_id"), "parent_id", "last_id", "line_start", "line_end").join(statement, ["rel_path", "parent_id"])
    ids = nodes.where("parent_type = 'VariableDeclarator' and role = 'id' and type = 'Identifier'").select("rel_path", F.col("parent_id").alias("decl_id"), "name")
    inits = nodes.where("parent_type = 'VariableDeclarator' and role = 'init'").select("rel_path", F.col("parent_id").alias("decl_id"), "type", F.col("node_id").alias("value_id"), F.when(F.col("type") == "CallExpression", F.col("path")).alias("value_path"))
    held = declarators.join(ids, ["rel_path", "decl_id"]).join(inits, ["rel_path", "decl_id"], "left")
    every = whole.unionByName(held.select(*whole.columns)).join(outer, ["rel_path", "top_id"])
    # what returns elements: a function's or method's own return statement, an arrow's value, or the value itself
    made = F.col("type").isin("JSXElement", "JSXFragment") | ((F.col("type") == "CallExpression") & F.col("path").isin("createElement", "React.createElement"))
    jsx = nodes.where(made & (F.col("parent_type") == "ReturnStatement") & F.col("fn_id").isNotNull()).select("rel_path", F.col("fn_id").alias("value_id"))
    jsx = jsx.unionByName(nodes.where(made & (F.col("role") == "init")).select("rel_path", F.col("node_id").alias("value_id")))
    every = every.join(jsx.distinct().withColumn("makes_jsx", F.lit(True)), ["rel_path", "value_id"], "left")
    supers = nodes.where("role = 'superClass' and path in ('Component', 'PureComponent', 'React.Component', 'React.PureComponent')").select("rel_path", F.col("parent_id").alias("decl_id"), F.lit(True).alias("is_component"))
    every = every.join(supers, ["rel_path", "decl_id"], "left")
    kind = (
        F.when(F.col("name").rlike("^use[A-Z]"), "custom-hook").when(F.col("name").rlike("^[A-Z]") & F.coalesce("makes_jsx", F.lit(False)), "react-component")
        .when(F.col("type") == "ClassDeclaration", F.when(F.col("is_component"), "react-component").otherwise("class")).when(F.col("type").isin("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression"), "function")
        .when(F.col("value_path").isin("memo", "forwardRef", "React.memo", "React.forwardRef"), "react-component").when(F.col("var_kind") == "const", "constant").otherwise("variable")
    )
    later = nodes.where("role = 'local' and parent_type = 'ExportSpecifier' and access is not null").select("rel_path", "name", F.lit(True).alias("listed")).distinct()
    default = nodes.where("parent_type = 'ExportDefaultDeclaration' and type = 'Identifier'").select("rel_path", "name", F.lit(True).alias("default_later")).distinct()
    out = every.join(later, ["rel_path", "name"], "left").join(default, ["rel_path", "name"], "left")
    is_default = (F.col("top_type") == "ExportDefaultDeclaration") | F.coalesce("default_later", F.lit(False))
    exported = F.col("top_type").isin("ExportNamedDeclaration", "ExportDefaultDeclaration") | F.coalesce("listed", F.lit(False)) | F.coalesce("default_later", F.lit(False))
    return out.select("rel_path", "decl_id", "last_id", "top_id", "name", kind.alias("kind"), "line_start", "line_end", exported.alias("exported"), is_default.alias("is_default"))


def uses(nodes: DataFrame, decls: DataFrame) -> DataFrame:
    """rel_path, src, dst, kind (declaration or import): names of the file's top level that a declaration uses, its own name left out."""
    d = decls.select("rel_path", "top_id", "decl_id", "last_id", F.col("name").alias("src"))
    # parameters, caught errors and own names of expressions are neither declarations of the top level nor imports
    refs = nodes.where("access in ('r', 'w', 'rw') and binding_id is not null and binding_kind not in ('param', 'catch', 'fn-name')").select("rel_path", "top_id", "node_id", "binding_id", "binding_kind", F.col("name").alias("dst"))
    inside = refs.join(d, ["rel_path", "top_id"]).where("node_id between decl_id and last_id and dst <> src")
    names = nodes.where("access = 'd' and role = 'id'").select("rel_path", F.col("node_id").alias("binding_id"), F.col("parent_id").alias("holder"))
    targets = names.join(decls.select("rel_path", F.col("decl_id").alias("holder")), ["rel_path", "holder"], "left_semi").select("rel_path", "binding_id").withColumn("known", F.lit(True))
    out = inside.join(targets, ["rel_path", "binding_id"], "left").where("known or binding_kind = 'import'")
    return out.select("rel_path", "src", "dst", F.when(F.col("binding_kind") == "import", "import").otherwise("declaration").alias("kind")).distinct()


def graph(nodes: DataFrame) -> DataFrame:
    """declarations with the sorted arrays dependencies, dependents and external_imports."""
    decls = declarations(nodes)
    found = uses(nodes, decls)
    names = lambda c: F.array_sort(F.collect_set(c))
    out_ = found.groupBy("rel_path", F.col("src").alias("name")).agg(names(F.when(F.col("kind") == "declaration", F.col("dst"))).alias("dependencies"), names(F.when(F.col("kind") == "import", F.col("dst"))).alias("external_imports"))
    in_ = found.where("kind = 'declaration'").groupBy("rel_path", F.col("dst").alias("name")).agg(names("src").alias("dependents"))
    both = decls.join(out_, ["rel_path", "name"], "left").join(in_, ["rel_path", "name"], "left")
    for c in ("dependencies", "external_imports", "dependents"):
        both = both.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return both


def joined_path(folder: Column, relative: Column) -> Column:
    """A relative path from a folder, with . and .. resolved; null where it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))
    step = lambda s, p: F.struct(
        F.when(p == "..", F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0)))).otherwise(F.concat(s["at"], F.array(p))).alias("at"),
        (s["out"] | ((p == "..") & (F.size(s["at"]) == 0))).alias("out"),
    )
    return F.aggregate(parts, start, step, lambda s: F.when(~s["out"], F.array_join(s["at"], "/")))


def module_edges(nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(src, dst): the files that each file imports or re-exports by a relative path.

    files: rel_path of all files that exist; those of nodes if none. The path as it is comes first, then with each
    ending, then the folder's index file with each. Paths that reach no file have no edge.
    """
    known = (nodes if files is None else files).select(F.col("rel_path").alias("dst")).distinct()
    asked = nodes.where("type in ('ImportDeclaration', 'ExportNamedDeclaration', 'ExportAllDeclaration') and startswith(value, '.')").select(F.col("rel_path").alias("src"), "value").distinct()
    folder = F.regexp_replace("src", "/?[^/]*$", "")
    asked = asked.withColumn("base", joined_path(folder, F.col("value"))).where("base is not null")
    tries = [F.col("base"), *[F.concat("base", F.lit(e)) for e in ENDINGS], *[F.concat_ws("/", F.when(F.col("base") != "", F.col("base")), F.lit(f"index{e}")) for e in ENDINGS]]
    tried = asked.select("src", "value", F.posexplode(F.array(*tries)).alias("rank", "dst"))
    return tried.join(known, "dst").groupBy("src", "value").agg(F.min_by("dst", "rank").alias("dst")).select("src", "dst").distinct()


def overlaid(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """nodes as they would be with the files in texts (rel_path, source_text; null: the file is gone) written. Only those are parsed."""
    kept = nodes.join(texts.select("rel_path").distinct(), "rel_path", "left_anti")
    return kept.select(nodes.columns).unionByName(parsed(texts).select(nodes.columns))


def import_cycles(nodes: DataFrame, texts: DataFrame | None = None, start: str | None = None) -> DataFrame:
    """(component, path): a closed walk through each group of files that import each other; a path begins and ends with its least file.

    texts: files that are about to be written (see overlaid), which imports may reach already. start: only cycles that this
    file reaches by imports.
    """
    edges = written(module_edges(nodes if texts is None else overlaid(nodes, texts)), "modules")
    if start is not None:
        from_there = edges.sparkSession.createDataFrame([(start,)], "start string")
        reached = closure(edges, from_there).select("node").unionByName(from_there.withColumnRenamed("start", "node")).distinct()
        edges = edges.join(reached.withColumnRenamed("node", "src"), "src", "left_semi")
    return cycle_paths(edges)
