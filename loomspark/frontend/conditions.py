"""Conditions as sets and as constants: what earlier conditions of an if chain cover, and what is always true or false.

Both read the tests that enclose a node (spans.enclosing, column tests), so a condition's parts come together by file and test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is constant wherever it stands, and what is a literal of which the value is known.
ALWAYS = ("StringLiteral", "NumericLiteral", "BooleanLiteral", "NullLiteral", "BigIntLiteral", "RegExpLiteral", "ObjectExpression", "ArrowFunctionExpression", "FunctionExpression", "ClassExpression")


def _largest(parts: DataFrame, by: list[str], op: str, name: str) -> DataFrame:
    """parts with `name`: the operand of a chain of the logical operator op, below the root of `by`, that a node belongs to.

    An operand is a node other than op that no operand before it (in source order) spans.
    """
    order = Window.partitionBy("rel_path", *by).orderBy("node_id")
    joint = (F.col("type") == "LogicalExpression") & (F.col("op") == op)
    open_until = F.max(F.when(~joint, F.col("last_id"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = parts.withColumn("_own", F.when(~joint & (F.col("node_id") > F.coalesce(open_until, F.lit(-1))), F.col("node_id")))
    return out.withColumn(name, F.last("_own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_own").where(F.col(name).isNotNull())


def covered(n: DataFrame, around: DataFrame) -> DataFrame:
    """(rel_path, node_id) of tests of else-if branches that can never hold, since earlier tests of the chain cover them.

    A condition is a disjunction of conjunctions. One is dead if each of its conjunctions contains all
    conjuncts of one of an earlier test, and so is a conjunction one of whose operands is dead.
    """
    heads = n.where("if_head is not null").select("rel_path", F.col("node_id").alias("test"), "if_head")
    inside = around.where(F.size("tests") > 0).select("rel_path", "node_id", F.element_at("tests", -1).alias("test")).join(heads, ["rel_path", "test"])
    parts = n.select("rel_path", "node_id", "last_id", "type", F.coalesce("op", F.lit("")).alias("op"), "shape").join(inside, ["rel_path", "node_id"])
    # the condition itself, and the operands of one that is a conjunction
    split = _largest(parts, ["test"], "&&", "root").where("root <> test")
    roots = parts.withColumn("root", F.col("test")).unionByName(split.select(*parts.columns, "root"))
    ors = _largest(roots, ["test", "root"], "||", "either")
    ands = _largest(ors, ["test", "root", "either"], "&&", "each").where("each = node_id")
    sets = ands.groupBy("rel_path", "if_head", "test", "root", "either").agg(F.collect_set("shape").alias("all_of"))
    before = sets.where("root = test").select("rel_path", "if_head", F.col("test").alias("earlier"), F.col("all_of").alias("some_of"))
    met = sets.join(before, ["rel_path", "if_head"], "left")
    hit = (F.col("earlier") < F.col("test")) & (F.size(F.array_except("some_of", "all_of")) == 0)
    each = met.groupBy("rel_path", "test", "root", "either").agg(F.max(F.coalesce(hit, F.lit(False))).alias("hit"))
    dead = each.groupBy("rel_path", "test", "root").agg(F.min("hit").alias("dead")).where("dead")
    return dead.select("rel_path", F.col("test").alias("node_id")).distinct()


def constant(n: DataFrame, around: DataFrame) -> DataFrame:
    """(rel_path, node_id) of tests that are always true or always false.

    A fold over a test's nodes from the last to the first, so that operands come before what holds them. Its
    state has, for each operand that still waits: whether it is constant as a condition (c) and as a value (v), and
    whether it settles an `||` or an `&&` alone (t, f).
    """
    inside = around.select("rel_path", "node_id", F.explode("tests").alias("test"))
    kept = F.struct(F.col("node_id").alias("id"), F.col("parent_id").alias("up"), "role", "type", F.coalesce("op", F.lit("")).alias("op"), F.coalesce("value", F.lit("")).alias("value"), F.coalesce("path", F.lit("")).alias("path"))
    trees = n.join(inside, ["rel_path", "node_id"]).groupBy("rel_path", "test").agg(F.sort_array(F.collect_list(kept), asc=False).alias("xs"))
    none = F.array().cast("array<struct<id:int,up:int,role:string,c:boolean,v:boolean,t:boolean,f:boolean>>")

    def step(waiting: Column, x: Column) -> Column:
        kids = F.filter(waiting, lambda k: k["up"] == x["id"])
        named = lambda role: F.filter(kids, lambda k: k["role"] == role)
        every = lambda ks, what: F.forall(ks, lambda k: k[what])
        has = lambda role, what: F.exists(named(role), lambda k: k[what])
        kind, op = x["type"], x["op"]
        is_ = lambda t: kind == t
        values = every(kids, "v")
        quasis = named("quasi")

        def logical(what: str) -> Column:
            alone = lambda side: has(side, what) & ((op == "||") & has(side, "t") | (op == "&&") & has(side, "f"))
            both = has("left", what) & has("right", what)
            return both | alone("left") | (alone("right") if what == "c" else F.lit(False))

        def told(what: str) -> Column:
            cond = F.lit(what == "c")
            return (
                F.when(kind.isin(*ALWAYS) | (x["path"] == "undefined"), True).when(is_("ArrayExpression"), cond | values)
                .when(is_("TemplateElement"), True if what == "v" else x["value"] != "").when(is_("TemplateLiteral"), values | (cond & F.exists(quasis, lambda k: k["c"])))
                .when(is_("UnaryExpression"), F.when(op == "void", True).when(op == "typeof", cond | values).when(op == "!", every(kids, "c")).otherwise(values))
                .when(is_("BinaryExpression"), values & (op != "in")).when(is_("LogicalExpression"), logical(what)).when(is_("NewExpression"), cond)
                .when(is_("AssignmentExpression"), F.when(op == "=", has("right", what)).when((op == "||=") & cond, has("right", "t")).when((op == "&&=") & cond, has("right", "f")).otherwise(False))
                .when(is_("SequenceExpression"), F.coalesce(F.get(kids, F.lit(0))[what], F.lit(False))).when(is_("SpreadElement"), values)
                .when(is_("CallExpression") & (x["path"] == "Boolean"), every(F.slice(F.reverse(named("argument")), F.lit(1), F.lit(1)), "c")).otherwise(False)
            )

        either = lambda what: has("left", what) | has("right", what)
        t = F.when(is_("BooleanLiteral"), x["value"] == "true").when(is_("LogicalExpression"), (op == "||") & either("t")).otherwise(False)
        f = F.when(is_("BooleanLiteral"), x["value"] == "false").when(is_("UnaryExpression"), op == "void").when(is_("LogicalExpression"), (op == "&&") & either("f")).otherwise(False)
        new = F.struct(x["id"].alias("id"), x["up"].alias("up"), x["role"].alias("role"), told("c").alias("c"), told("v").alias("v"), t.alias("t"), f.alias("f"))
        return F.concat(F.filter(waiting, lambda k: k["up"] != x["id"]), F.array(new))

    folded = trees.select("rel_path", "test", F.aggregate("xs", none, step, lambda s: F.element_at(s, -1)["c"]).alias("told"))
    return folded.where("told").select("rel_path", F.col("test").alias("node_id"))
