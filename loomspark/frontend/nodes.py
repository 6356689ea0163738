"""Syntax trees as a flat table: each file is parsed once, in Arrow batches, into rows of nodes.

node_id numbers the nodes of a file in source order, from 0; last_id is the largest below
a node, so d is inside n where n.node_id < d.node_id <= n.last_id. A file that does not
parse has one row of type '#failure' with the reason as value.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.frontend.javascript import JavaScriptError, Node, Parser, parse
from loomspark.frontend.notes import flags_of

FUNCTIONS = {
    "FunctionDeclaration": "function-declaration", "FunctionExpression": "function-expression", "ArrowFunctionExpression": "arrow-function",
    "ObjectMethod": "object-method", "ClassMethod": "class-method", "ClassPrivateMethod": "class-method",
}
LOOPS = ("ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoWhileStatement")
SCHEMA = """rel_path string, node_id int, parent_id int, last_id int, depth int, role string, idx int, type string, name string, op string, value string, path string,
line_start int, col_start int, line_end int, col_end int, off_start int, off_end int, parent_type string, parent_role string, grand_id int, grand_type string,
fn_id int, class_id int, top_id int, nesting int, in_body boolean, label string, n_params int, flags array<string>, shape long, access string, binding_id int, binding_kind string, chain_id int, if_head int"""
_NAMES = [x.split()[0] for x in SCHEMA.replace("\n", " ").split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
ARROW = pa.schema([(n, _KINDS[t]) for n, t in (x.split() for x in SCHEMA.replace("\n", " ").split(", "))])
#: Types without children of their own, and those that bind, write or declare what is below them.
LEAVES = {"Identifier", "NumericLiteral", "StringLiteral", "BooleanLiteral", "NullLiteral", "ThisExpression", "TemplateElement"}
BINDING = {
    *FUNCTIONS, "ArrayPattern", "ObjectPattern", "RestElement", "AssignmentPattern", "ObjectProperty", "VariableDeclaration", "VariableDeclarator", "CatchClause", "ImportSpecifier", "ImportDefaultSpecifier",
    "ImportNamespaceSpecifier", "ClassDeclaration", "ClassExpression", "AssignmentExpression", "UpdateExpression", "ForInStatement", "ForOfStatement",
}
_EMPTY = dict.fromkeys(_NAMES)
#: Rows of one batch; a file's nodes may span several.
ROWS = 4_000
#: Characters of source that a task parses, about; one file at least.
TASK_CHARS = 1 << 18


class _Scope:
    def __init__(self, up: _Scope | None, function: bool):
        self.up, self.names = up, {}
        self.function = self if function or up is None else up.function

    def find(self, name: str):
        at: _Scope | None = self
        while at is not None:
            if name in at.names:
                return at.names[name]
            at = at.up
        return None


def _dotted(n: Node) -> str | None:
    if n.type == "Identifier":
        return n.name
    if n.type == "ThisExpression":
        return "this"
    if n.type == "MemberExpression" and n.name:
        inner = _dotted(n.kids[0][1])
        return inner and f"{inner}.{n.name}"
    return None


def _label(n: Node, line: int, parent: Node | None, klass: Node | None) -> str:
    """The name by which a function is reported."""
    nameless = f"<anonymous@{line}>"
    default = parent is not None and parent.type == "ExportDefaultDeclaration"
    if n.type == "FunctionDeclaration":
        return n.name or (f"<default-export@{line}>" if default else nameless)
    if n.type in ("ObjectMethod", "ClassMethod", "ClassPrivateMethod"):
        key = n.get("key")
        plain = (key.name if key.type in ("Identifier", "PrivateName") else key.value if key.type in ("StringLiteral", "NumericLiteral") else None) or (f"<computed@{line}>" if "computed" in n.flags else nameless)
        plain = f"{n.op} {plain}" if n.op in ("get", "set") else plain
        return f"{klass.name}.{plain}" if klass is not None and klass.name else plain
    if parent is not None:
        held = parent.get("id") if parent.type == "VariableDeclarator" else parent.get("left") if parent.type == "AssignmentExpression" else None
        if held is not None and held.type == "Identifier":
            return held.name
        if parent.type == "ObjectProperty" and parent.get("key") is not n and (parent.name or parent.get("key").name):
            return parent.name or parent.get("key").name
        if default:
            return f"<default-export@{line}>"
    return n.name or nameless


class _Flat:
    """One file's rows; see SCHEMA."""

    def __init__(self, rel_path: str, root: Node, parser: Parser, shapes: bool = True):
        self.rel_path, self.parser, self.rows, self.refs, self.memo, self.shapes = rel_path, parser, [], [], {}, shapes
        self.scope = _Scope(None, True)
        self.visit(root, None, "", 0, {"depth": 0, "fn": None, "class": None, "top": None, "nesting": 0, "body": True, "else_if": False, "head": None}, self.scope, None)
        for row, name, scope in self.refs:
            found = scope.find(name)
            if found:
                row["binding_id"], row["binding_kind"] = found

    def declare(self, scope: _Scope, row: dict, kind: str) -> None:
        at = scope.function if kind == "var" else scope
        row["access"], row["binding_kind"] = "d", kind
        if row["name"] not in at.names or at.names[row["name"]][1] == "fn-name":
            at.names[row["name"]] = (row["node_id"], kind)
        row["binding_id"] = at.names[row["name"]][0]

    def visit(self, n: Node, up: dict | None, role: str, idx: int, c: dict, scope: _Scope, target: str | None, parents: tuple = ()) -> int:
        """target: how identifiers here are used: None (read), 'w', 'rw' or the kind of binding they declare."""
        parent = parents[-1] if parents else None
        line, col = self.parser.position(n.start)
        if n.type == "Identifier":  # about half of all nodes: on one line, and nothing to note
            end_line, end_col = line, col + n.end - n.start
        else:
            n.flags |= flags_of(n, parent, self.parser.s, self.memo)
            end_line, end_col = self.parser.position(n.end)
        row = _EMPTY.copy()
        row["rel_path"], row["node_id"], row["depth"], row["role"], row["idx"], row["type"], row["name"], row["op"], row["value"] = self.rel_path, len(self.rows), c["depth"], role, idx, n.type, n.name, n.op, n.value
        row["line_start"], row["col_start"], row["line_end"], row["col_end"], row["off_start"], row["off_end"] = line, col + 1, end_line, end_col + 1, n.start, n.end
        if up is not None:
            row["parent_id"], row["parent_type"], row["parent_role"], row["grand_id"], row["grand_type"] = up["node_id"], up["type"], up["role"], up["parent_id"], up["parent_type"]
        row["fn_id"], row["class_id"], row["top_id"], row["in_body"], row["flags"] = c["fn"], c["class"] and c["class"][0], c["top"], c["body"], sorted(n.flags) if n.flags else []
        self.rows.append(row)
        me = row["node_id"]
        if n.type in LEAVES and not n.kids:
            row["nesting"], row["last_id"] = c["nesting"], me
            if role == "test" and parent.type == "IfStatement":
                row["if_head"] = c["head"]
            if n.type == "Identifier":
                row["path"] = n.name
                self.name(n, row, up, role, scope, target, parents)
            return self.shaped(row, [n.type, n.name, n.op, n.value])
        nesting = c["nesting"]
        if n.type in LOOPS or n.type in ("SwitchStatement", "TryStatement") or n.type == "IfStatement" and not c["else_if"]:
            nesting += 1
        row["nesting"] = nesting
        inner = c | {"depth": c["depth"] + 1, "nesting": nesting, "else_if": False}
        if n.type == "IfStatement":
            inner["head"] = c["head"] if c["else_if"] else me
        elif role == "test" and parent.type == "IfStatement":
            row["if_head"] = c["head"]
        if n.type.endswith(("Identifier", "MemberExpression")):
            row["path"] = _dotted(n)
        elif n.type in ("CallExpression", "NewExpression"):
            row["path"] = _dotted(n.get("callee"))
        function = n.type in FUNCTIONS
        if function:
            row["label"], row["n_params"] = _label(n, line, parent, c["class"] and c["class"][1]), len(n.all("param"))
            inner |= {"fn": me, "nesting": 0, "body": False}
        if n.type in ("ClassDeclaration", "ClassExpression"):
            inner["class"] = (me, n)
        if up is not None and up["type"] == "Program":
            inner["top"] = row["top_id"] = me
        own = scope
        if function or n.type in (*LOOPS, "CatchClause", "SwitchStatement", "StaticBlock", "ClassExpression", "ClassDeclaration") or n.type == "BlockStatement" and parent.type not in FUNCTIONS:
            own = _Scope(scope, function or n.type == "StaticBlock")
        if n.type in ("Identifier", "JSXIdentifier"):
            self.name(n, row, up, role, scope, target, parents)
        shape = [n.type, n.name, n.op, n.value]
        seen: dict[str, int] = {}
        below = (*parents[-8:], n) if n.kids else ()
        for r, kid in n.kids:
            k = seen[r] = seen.get(r, -1) + 1
            t = None
            if n.type not in BINDING:
                pass
            elif n.type in ("ArrayPattern", "ObjectPattern", "RestElement") or n.type == "AssignmentPattern" and r == "left" or n.type == "ObjectProperty" and r == "value":
                t = target
            elif n.type == "VariableDeclaration":
                t = n.op
            elif n.type == "VariableDeclarator" and r == "id":
                t = target
            elif function and r == "param":
                t = "param"
            elif n.type == "CatchClause" and r == "param":
                t = "catch"
            elif n.type.startswith("Import") and n.type.endswith("Specifier"):
                t = "import"
            elif r == "id" and n.type in ("FunctionDeclaration", "ClassDeclaration"):
                t = "function" if function else "class"
            elif r == "id" and n.type in ("FunctionExpression", "ClassExpression"):
                t = "fn-name"
            elif n.type == "AssignmentExpression" and r == "left":
                t = "w" if n.op == "=" else "rw"
            elif n.type == "UpdateExpression":
                t = "rw"
            elif n.type in ("ForInStatement", "ForOfStatement") and r == "left" and kid.type != "VariableDeclaration":
                t = "w"
            if t in ("w", "rw") and kid.type not in ("Identifier", "ArrayPattern", "ObjectPattern", "AssignmentPattern", "RestElement", "ObjectProperty"):
                t = None
            here = inner
            if function and r == "body":
                here = dict(inner, body=True)
            elif n.type == "IfStatement" and r == "alternate" and kid.type == "IfStatement":
                here = dict(inner, else_if=True)
            at = scope if r == "id" and n.type in ("FunctionDeclaration", "ClassDeclaration") else own
            shape.append(self.visit(kid, row, r, k, here, at, t, below))
        row["last_id"] = len(self.rows) - 1
        return self.shaped(row, shape)

    def shaped(self, row: dict, shape: list) -> int | None:
        if self.shapes:
            row["shape"] = xxhash.xxh3_64_intdigest(repr(shape)) - (1 << 63)
        return row["shape"]

    def name(self, n: Node, row: dict, up: dict, role: str, scope: _Scope, target: str | None, parents: tuple) -> None:
        parent = parents[-1]
        plain = "computed" not in parent.flags
        if n.type == "JSXIdentifier":
            if not (n.name[:1].islower() and "." not in parent.name) and ":" not in parent.name:
                row["access"] = "r"
                self.refs.append((row, n.name, scope))
            return
        if role == "property" and parent.type.endswith("MemberExpression") and plain or role == "key" and plain:
            return
        if parent.type == "ExportSpecifier":
            if parents[-2].value is None:
                row["access"] = "r"
                self.refs.append((row, n.name, scope))
            return
        if target in (None, "w", "rw"):
            row["access"] = target or "r"
            if parent.type == "UnaryExpression" and parent.op == "typeof":
                row["flags"].append("typeof")
            self.refs.append((row, n.name, scope))
            top = row
            while top["parent_id"] is not None and top["role"] == "object" and top["parent_type"] == "MemberExpression":
                top = self.rows[top["parent_id"]]
            row["chain_id"] = top["node_id"]
        else:
            self.declare(scope, row, target)


def flatten(rel_path: str, source: str, shapes: bool = True) -> list[dict]:
    """The rows of one file (a failure is one row); shapes: whether they tell the shapes of what is below them."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6000))
    try:
        root, parser = parse(source)
        return _Flat(rel_path, root, parser, shapes).rows
    except (JavaScriptError, RecursionError) as e:
        at = (e.line, e.column) if isinstance(e, JavaScriptError) else (1, 0)
        reason = e.reason if isinstance(e, JavaScriptError) else "Nested too deeply"
        return [_EMPTY | {"rel_path": rel_path, "node_id": 0, "type": "#failure", "value": reason, "line_start": at[0], "col_start": at[1]}]


def parsed(files: DataFrame, columns: list[str] | None = None, only: Callable[[dict], bool] | None = None) -> DataFrame:
    """Nodes of files (rel_path, source_text; null texts are left out). Store the result before several rules read it.

    Parsing takes far longer than reading, so files are dealt to tasks by the length of all sources, however few splits their table has; files is read twice.
    columns, and only for rows: what the reader needs of the nodes, if not all; the rest, which may be most, never leaves its task.
    """
    names = columns or ARROW.names
    schema = pa.schema([ARROW.field(c) for c in names])
    kinds = dict(x.split() for x in SCHEMA.replace("\n", " ").split(", "))

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in zip(names, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[dict] = []
            for rel_path, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = flatten(rel_path, source, "shape" in names)
                held += found if only is None else filter(only, found)
                while len(held) >= ROWS:
                    yield batch(held[:ROWS])
                    held = held[ROWS:]
            yield batch(held)

    texts = files.where("source_text is not null").select("rel_path", "source_text")
    tasks = 1 + (texts.agg(F.sum(F.length("source_text"))).first()[0] or 0) // TASK_CHARS
    if tasks > 1:
        texts = texts.repartition(tasks, "rel_path")
    return texts.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def failures(nodes: DataFrame) -> DataFrame:
    """rel_path, stage, line (from 1), column (from 0), reason."""
    return nodes.where("type = '#failure'").select("rel_path", F.lit("parse").alias("stage"), F.col("line_start").alias("line"), F.col("col_start").alias("column"), F.col("value").alias("reason"))
