"""Parts of a file that could move to files of their own, and how safe that would be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.frontend import dependencies
from loomspark.frontend.nodes import FUNCTIONS, LOOPS
from loomspark.functions import text as T
from loomspark.plans.store import written

# Objects, methods and functions that reach services; confidence when safe and when not, and the reason, by kind.
SERVICE_OBJECTS = ["axios", "ky", "api", "apiClient", "http", "client", "localStorage", "sessionStorage", "indexedDB"]
SERVICE_METHODS = ["get", "post", "put", "delete", "patch", "request"]
SERVICE_CALLS = ["fetch", "apiClient", "axios", "request", "postData", "fetchData"]
KINDS = {
    "react-component": (0.91, 0.65, "Independent JSX section with explicit dependencies."),
    "custom-hook": (0.93, 0.60, "Cohesive custom Hook managing state and side-effect logic."),
    "service": (0.90, 0.62, "Performs external API or data persistence operations."),
    "utility": (0.89, 0.60, "Pure utility function with clear inputs and outputs."),
    "constant-group": (0.88, 0.55, "Group of related constants and static configuration data."),
}
BLOCKING = ["Conditional hook", "eval()", "with statement", "CommonJS", "mutable variable"]
#: What detected() reads of the nodes; see nodes.parsed().
READ = ["rel_path", "node_id", "parent_id", "last_id", "role", "type", "name", "op", "value", "path", "line_start", "line_end", "parent_type", "grand_type", "fn_id", "top_id", "access", "binding_id", "binding_kind"]
BRANCHES = ("IfStatement", "SwitchStatement", *LOOPS, "ConditionalExpression", "LogicalExpression")
DECLARED = ("FunctionDeclaration", "ClassDeclaration", "VariableDeclarator")
_TYPES = {*FUNCTIONS, *BRANCHES, *DECLARED, "VariableDeclaration", "CallExpression", "NewExpression", "AssignmentExpression", "ObjectMethod", "SpreadElement", "MemberExpression", "WithStatement", "JSXElement", "JSXFragment"}
HOOK = r"^(React\.)?use[A-Z][A-Za-z0-9_$]*$"


def told(row: dict) -> bool:
    """Whether a node tells detected() something: names in use, declarations and their values, what has effects or branches, and what the file's top level holds."""
    return row["type"] in _TYPES or row["access"] is not None or row["role"] in ("id", "init", "superClass", "local") or row["parent_type"] in ("Program", "ExportDefaultDeclaration")


def facts(nodes: DataFrame, decls: DataFrame) -> DataFrame:
    """For each declaration: is_service, has_hooks, has_effects (of a variable's value), init_type, returns_jsx, risks."""
    d = decls.select("rel_path", "top_id", "decl_id", "last_id")
    inner = nodes.select("rel_path", "top_id", "node_id", F.col("last_id").alias("inner_last"), "type", "name", "path", "role", "parent_id", "parent_type", "grand_type", "fn_id", "value")
    call = F.col("type") == "CallExpression"
    callee = (F.col("role") == "callee") & (F.col("parent_type") == "CallExpression") & (F.col("type") == "MemberExpression")
    parts = F.split("path", r"\.")
    service = (call & F.col("path").isin(*SERVICE_CALLS)) | (callee & (F.col("name").isin(*SERVICE_METHODS) | ((F.size(parts) == 2) & F.get(parts, F.lit(0)).isin(*SERVICE_OBJECTS))))
    hook = call & F.col("path").rlike(HOOK)
    member = F.col("type") == "MemberExpression"
    common = member & ((F.col("path") == "module.exports") | F.col("path").rlike(r"^exports\.[^.]+$"))
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    # what runs when a variable is set, outside of nested functions
    acts = F.col("fn_id").isNull() & (F.col("type").isin("NewExpression", "AssignmentExpression", "ObjectMethod") | (call & ~F.coalesce(F.col("path") == "Object.freeze", F.lit(False))) | ((F.col("type") == "SpreadElement") & (F.col("parent_type") == "ObjectExpression")))
    made = F.col("type").isin("JSXElement", "JSXFragment") | (call & F.col("path").isin("createElement", "React.createElement"))
    # nodes that tell nothing stay out of the join; each declaration tells of itself
    tells = [service, hook, acts, F.col("type") == "WithStatement", call & (F.col("path") == "eval"), common, F.col("role") == "init", made, F.col("type").isin(*BRANCHES, *DECLARED)]
    tells = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in tells])
    inside = inner.where(tells).join(d, ["rel_path", "top_id"]).where("node_id between decl_id and last_id")
    found = inside.groupBy("rel_path", "decl_id").agg(
        has(service).alias("is_service"), has(hook).alias("has_hooks"), has(acts & (F.col("node_id") > F.col("decl_id"))).alias("has_effects"), has((F.col("type") == "WithStatement")).alias("r_with"), has(call & (F.col("path") == "eval")).alias("r_eval"), has(common).alias("r_common"),
        F.max(F.when((F.col("role") == "init") & (F.col("parent_id") == F.col("decl_id")), F.col("type"))).alias("init_type"), has(made & (F.col("parent_type") == "ReturnStatement") & (F.col("fn_id") == F.col("decl_id"))).alias("returns_jsx"),
    )
    branches = inside.where(F.col("type").isin(*BRANCHES)).select("rel_path", "decl_id", F.col("node_id").alias("b_id"), F.col("inner_last").alias("b_last"))
    hooks = inside.where(hook).select("rel_path", "decl_id", "node_id")
    conditional = hooks.join(branches, ["rel_path", "decl_id"]).where("node_id > b_id and node_id <= b_last").select("rel_path", "decl_id").distinct().withColumn("r_hook", F.lit(True))
    found = found.join(conditional, ["rel_path", "decl_id"], "left")
    risks = [(F.coalesce("r_hook", F.lit(False)), "Conditional hook execution detected"), (F.col("r_with"), "Uses with statement"), (F.col("r_eval"), "Uses dynamic eval()"), (F.col("r_common"), "Unsupported CommonJS module exports")]
    return found.withColumn("risks", F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in risks]))).drop("r_hook", "r_with", "r_eval", "r_common")


def nested(nodes: DataFrame) -> DataFrame:
    """Named functions inside of others that use what these declare: kind, bounds, captured names, and risks.

    A name that the function itself declares is none of its captures.
    """
    f = nodes.where("type in ('FunctionDeclaration', 'FunctionExpression', 'ArrowFunctionExpression') and fn_id is not null")
    holders = nodes.where("parent_type = 'VariableDeclarator' and role = 'id' and type = 'Identifier'").select("rel_path", "parent_id", F.col("name").alias("held_name"))
    declarators = nodes.where("type = 'VariableDeclarator'").select("rel_path", F.col("node_id").alias("parent_id"), F.col("line_start").alias("d_start"), F.col("line_end").alias("d_end"))
    f = f.join(holders, ["rel_path", "parent_id"], "left").join(declarators, ["rel_path", "parent_id"], "left")
    own = F.col("name").isNull() & F.col("held_name").isNotNull()
    f = f.select("rel_path", F.col("node_id").alias("f_id"), F.col("last_id").alias("f_last"), F.col("fn_id").alias("outer_id"), "top_id", "type", F.coalesce("name", "held_name").alias("symbol"), F.when(own, F.col("d_start")).otherwise(F.col("line_start")).alias("line_start"), F.when(own, F.col("d_end")).otherwise(F.col("line_end")).alias("line_end")).where("symbol is not null")
    outer = nodes.where(F.col("type").isin(*FUNCTIONS)).select("rel_path", F.col("node_id").alias("outer_id"), F.col("last_id").alias("outer_last"))
    f = f.join(outer, ["rel_path", "outer_id"])
    refs = nodes.where("access in ('r', 'w', 'rw') and binding_id is not null").select("rel_path", "top_id", "node_id", "binding_id", F.col("name").alias("used"), "access")
    hits = f.join(refs, ["rel_path", "top_id"]).where("node_id between f_id and f_last and binding_id between outer_id and outer_last and not binding_id between f_id and f_last")
    hits = hits.groupBy("rel_path", "f_id").agg(F.array_sort(F.collect_set("used")).alias("captured"), F.array_sort(F.collect_set(F.when(F.col("access") != "r", F.col("used")))).alias("changed"))
    made = F.col("type").isin("JSXElement", "JSXFragment") & ((F.col("parent_type") == "ReturnStatement") & F.col("fn_id").isNotNull())
    jsx = nodes.where(made).select("rel_path", F.col("fn_id").alias("f_id")).distinct().withColumn("returns_jsx", F.lit(True))
    out = f.join(hits, ["rel_path", "f_id"]).join(jsx, ["rel_path", "f_id"], "left")
    component = F.col("symbol").rlike("^[A-Z]") & F.coalesce("returns_jsx", F.lit(False))
    out = out.withColumn("is_component", component).where("is_component or type = 'FunctionDeclaration' or symbol rlike '^(handle|render)' or line_end - line_start + 1 >= 4")
    risks = F.concat(F.transform("captured", lambda c: F.concat(F.lit("Captures "), c, F.lit(" from outer scope"))), F.transform("changed", lambda c: F.concat(F.lit("Captures mutable variable "), c, F.lit(" which cannot safely become a prop"))))
    reason = F.when(F.col("is_component"), "Nested React component capturing outer component state.").otherwise("Nested function capturing surrounding state closures.")
    return out.select("rel_path", F.when(F.col("is_component"), "react-component").otherwise("utility").alias("kind"), "symbol", "line_start", "line_end", reason.alias("reason"), F.lit(0.6).alias("confidence"), "captured", risks.alias("risks"))


def detected(nodes: DataFrame, *, min_lines: int = 20, most: int = 10) -> DataFrame:
    """Candidates of each file, the first `most` by line and name (the limit is the feature).

    rel_path, id (unique in its file), kind, symbol, line_start, line_end, lines, reason, confidence, dependencies, dependents,
    external_imports, captured, risks, safety (automatic-ready, manual-review or blocked). A file's main component stays: its default export, else the
    one named like the file. A value counts as having effects if a call, assignment or spread runs while it is set.
    """
    g = written(dependencies.graph(nodes), "graph")  # read four times below
    stem = F.regexp_extract("rel_path", r"([^/]+?)(\.[^./]*)?$", 1)
    rank = F.when(F.col("is_default"), 1).when(F.col("name") == stem, 2)
    main = g.where("kind = 'react-component'").withColumn("rank", rank).where("rank is not null").groupBy("rel_path").agg(F.min_by("name", F.struct("rank", "line_start", "decl_id")).alias("main"))
    d = g.join(facts(nodes, g), ["rel_path", "decl_id"]).join(main, "rel_path", "left").where("main is null or name <> main")
    lines, used = F.col("line_end") - F.col("line_start") + 1, F.size("dependents") > 0
    function = (F.col("kind") == "function") | F.col("init_type").isin("ArrowFunctionExpression", "FunctionExpression")
    component = (F.col("kind") == "react-component") | (F.col("returns_jsx") & F.col("name").rlike("^[A-Z]"))
    plain = F.col("kind").isin("constant", "variable")
    constant = plain & F.col("init_type").isNotNull() & (F.col("init_type").isin("ObjectExpression", "ArrayExpression") | (T.is_constant(F.col("name")) & ((lines >= 4) | used)))
    what = (
        F.when(component, F.when((lines >= min_lines) | used, "react-component").otherwise("none")).when(F.col("kind") == "custom-hook", "custom-hook").when((function | plain) & F.col("is_service"), "service")
        .when(function & ~F.col("returns_jsx") & ~F.col("has_hooks") & ((lines >= min_lines) | ((lines >= 5) & (used | F.col("exported")))), "utility").when(constant, "constant-group").otherwise("none")
    )
    d = d.withColumn("what", what).where("what <> 'none'")
    effects = (F.col("what") == "constant-group") & F.col("has_effects")
    d = d.withColumn("risks", F.when(effects, F.array_append("risks", F.lit("Constant initialization contains potential side effects"))).otherwise(F.col("risks")))
    safe = F.size("risks") == 0
    pick = lambda k: F.coalesce(*[F.when(F.col("what") == w, F.lit(v[k])) for w, v in KINDS.items()])
    none = F.array().cast("array<string>")
    top = d.select("rel_path", F.col("what").alias("kind"), F.col("name").alias("symbol"), "line_start", "line_end", pick(2).alias("reason"), F.when(safe, pick(0)).otherwise(pick(1)).alias("confidence"), "dependencies", "dependents", "external_imports", none.alias("captured"), "risks")
    top = written(top, "top")
    files = main.withColumnRenamed("main", "_main")
    inner = nested(nodes).join(top.select("rel_path", "symbol"), ["rel_path", "symbol"], "left_anti").join(files, "rel_path", "left")
    inner = inner.withColumn("dependents", F.array(F.coalesce("_main", stem))).withColumn("dependencies", none).withColumn("external_imports", none).drop("_main")
    order = Window.partitionBy("rel_path").orderBy("line_start", "symbol", "line_end")
    out = top.unionByName(inner).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    base = T.kebab(F.col("symbol"))
    again = F.row_number().over(Window.partitionBy("rel_path", "base").orderBy("nth"))
    out = out.withColumn("base", base).withColumn("again", again).withColumn("id", F.when(F.col("again") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("again").cast("string"))))
    blocked = F.exists("risks", lambda r: r.contains(BLOCKING[0]) | r.contains(BLOCKING[1]) | r.contains(BLOCKING[2]) | r.contains(BLOCKING[3]) | r.contains(BLOCKING[4]))
    safety = F.when(blocked, "blocked").when((F.size("risks") > 0) | (F.size("captured") > 0), "manual-review").otherwise("automatic-ready")
    return out.select("rel_path", "id", "kind", "symbol", "line_start", "line_end", (F.col("line_end") - F.col("line_start") + 1).alias("lines"), "reason", "confidence", "dependencies", "dependents", "external_imports", "captured", "risks", safety.alias("safety"))
