import pytest
from pyspark.sql import functions as F

from loomspark.frontend import dependencies, javascript, nodes, outline, rules
from loomspark.plans import code


def tree(spark, *sources):
    return nodes.parsed(spark.createDataFrame([(f"f{i}.js", s) for i, s in enumerate(sources)], "rel_path string, source_text string")).cache()


@pytest.mark.parametrize(
    "source",
    [
        "a = b;\n/re[/]/g.test(x) / c / d", "x = (a, b = 1) => ({a, ...b})", "for (const [k, v] of m) if (k) continue; else break", "async x => await x", "`a${`b${c}`}d`", "a?.b?.[c]?.(d).e", "({a = 1} = b)",
        "class A extends B { #p = 1; static s() {} get x() { return 1 } async *g() {} static { a() } constructor() { super() } }", "<a.b c='d' {...e}>t {f} <></> {/* x */}</a.b>", "x\n++y", "new a.b(c).d",
        "import d, * as n from 'm'; export { d as b }; export default class {}", "a = b ? (c) : d => e", "var async; async()", "({ get, set(v) {}, async: 2, get a() { return 1 } })", "#p in o", "label: for (;;) { break label }", "0x1f + 1_000n + .5e3",
    ],
)
def test_parses(source):
    def check(n, low, high):
        assert low <= n.start <= n.end <= high, (n.type, n.start, n.end)
        for _, k in n.kids:
            check(k, n.start, n.end)

    check(javascript.parse(source)[0], 0, len(source))


@pytest.mark.parametrize("source,line,column", [("let x: number = 1", 1, 5), ("foo(", 1, 4), ("a\nb c", 2, 2), ("<a></b>", 1, 6), ("const x", 1, 7), ("if (a) { import 'x' }", 1, 9), ("'abc", 1, 0), ("/* x", 1, 0)])
def test_rejects(source, line, column):
    with pytest.raises(javascript.JavaScriptError) as e:
        javascript.parse(source)
    assert (e.value.line, e.value.column) == (line, column)


def test_failures_are_rows(spark):
    t = tree(spark, "a(", "ok()", "(" * 5000)
    assert [(r.rel_path, r.line) for r in nodes.failures(t).orderBy("rel_path").collect()] == [("f0.js", 1), ("f2.js", 1)]
    assert nodes.parsed(spark.createDataFrame([("n", None), ("e", "")], "rel_path string, source_text string")).count() == 1


COMPLEXITY = [
        ("", 1, 0), ("if (a) {} else {}", 2, 1), ("if (a) {} else if (b) {} else if (c) {}", 4, 1), ("return a ? b : c", 2, 0), ("for (;;) { for (x in y) { while (z) { do {} while (q) } } }", 5, 4),
        ("try { a() } catch (e) { if (b) {} } finally { c() }", 3, 2), ("switch (a) { case 1: case 2: b(); default: c() }", 3, 1), ("return a && b || c ?? 0", None, None), ("return (a && b || c) + (d ?? 0) + a?.b", 4, 0),
        ("function g() { if (a) { if (b) {} } }", 1, 0), ("switch (a) { case b && c: }", 3, 1), ("if (a) { x(() => { if (b) {} }) }", 2, 1), ("a ||= b", 1, 0),
    ]


def test_complexity(spark):
    t = tree(spark, *[f"function f(p = q ? 1 : 2) {{ {body} }}" for body, _, _ in COMPLEXITY])
    got = {r.rel_path: (r.cyclomatic, r.nesting) for r in rules.functions(t).where("name = 'f'").collect()}
    want = {f"f{i}.js": (c, n) for i, (_, c, n) in enumerate(COMPLEXITY) if c}  # ?? beside || does not parse
    assert got == want


def test_function_names(spark):
    t = tree(spark, "class A { m() {} get g() {} #p() {} 'q'() {} [k]() {} [k + 1]() {} }\nconst v = () => {}; x = function y() {}; o = { a: () => 1, b() {} };\nz(() => 1); export default function () {}")
    got = {r.name: r.kind for r in rules.functions(t).collect()}
    assert got == {
        "A.m": "class-method", "A.get g": "class-method", "A.#p": "class-method", "A.q": "class-method", "A.k": "class-method", "v": "arrow-function", "x": "function-expression", "a": "arrow-function", "b": "object-method",
        "A.<computed@1>": "class-method", "<anonymous@3>": "arrow-function", "<default-export@3>": "function-declaration",
    }
    curried = rules.functions(tree(spark, "const c = a => b => { if (a) { return b || 1 } }")).where("name = 'c'").first()
    assert (curried.cyclomatic, curried.nesting) == (3, 1)


def test_complexity_findings(spark):
    source = "function f(a, b, c, d) {\n if (a) { if (b) {} }\n}"
    got = {r.rule_id.split("/")[1]: r.severity for r in rules.complexity_findings(tree(spark, source), {"lines": 1, "params": 3, "cyclomatic": 2, "nesting": 1}).collect()}
    assert got == {"function-too-long": "high", "too-many-parameters": "low", "high-cyclomatic-complexity": "medium", "deep-nesting": "high"}


REACT = """import React, { useState, useEffect as ue, memo, Component as C } from 'react';
class K extends C { render() { return null } }
class N extends Other {}
const App = () => {
  const [items, setItems] = useState([]);
  const [n] = React.useState(0);
  items.push(1); items.a.b = 2; n++; delete items.x; items.map(x => x); [...items].sort(); items = 3;
  ue(async () => { await n });
  useEffect(() => { n });
  return <ul>{items.map((it, i) => <li key={i}>{it}</li>)}{items.map((it, i) => <li key={`${i}`} k={i} />)}{items.map((it, i) => [1].map(i => <b key={i} />))}</ul>;
};
const Wrapped = memo(function Inner() { return <div /> });
function Helper() { return c ? <a /> : null }
function lower() { return <a /> }
export default () => <a />;
"""


def test_react(spark):
    t = tree(spark, REACT)
    assert {(r.name, r.kind) for r in rules.components(t).collect()} == {("K", "class-component"), ("App", "function-component"), ("Wrapped", "memo-component")}
    assert {(r.state_name, r.setter_name, r.line) for r in rules.states(t).collect()} == {("items", "setItems", 5), ("n", "", 6)}
    assert sorted((r.line_start, r.is_async) for r in rules.effects(t).collect()) == [(8, True), (9, False)]
    got = sorted((r.rule_id.split("/")[1], r.line_start, r.message.split(" directly ")[-1]) for r in rules.react_findings(t, {"component": 7, "effect": 50}).collect())
    assert got == [
        ("array-index-key", 10, "Array index 'i' is used as a React key."), ("async-effect-callback", 8, "The useEffect callback is async and therefore returns a Promise instead of an effect cleanup function."),
        ("component-too-large", 4, "Component 'App' spans 8 lines, exceeding the configured maximum of 7."), ("direct-state-mutation", 7, "through 'push'."), ("direct-state-mutation", 7, "through an update expression."), ("direct-state-mutation", 7, "through assignment."),
    ]


LINT = [
        ("no-undef", "missing(); z = 1", "let a; a; console; typeof missing; <div/>; ({ missing: 1 }); a.missing"), ("no-unreachable", "function f() { return; a() }", "function f() { return; function g() {} var x }"),
        ("no-dupe-keys", "x = { a: 1, 'a': 2 }", "x = { get a() {}, set a(v) {}, [a]: 1, b: 2 }"), ("no-dupe-args", "function f(a, b, a) {}", "function f(a, b) {}"),
        ("no-dupe-else-if", "if (a) {} else if (b) {} else if (c) {} else if (a) {}", "if (a) {} else if (b) { if (a) {} }"), ("no-duplicate-case", "switch (a) { case 1: case 1: }", "switch (a) { case 1: case 2: }"),
        ("no-self-assign", "a.b = a.b", "a = b; a += a; a() .x = a().x"), ("no-self-compare", "a.b === a.b", "a === b"), ("no-constant-condition", "if (1) {}", "while (true) {}"), ("valid-typeof", "typeof a === 'strin'", "typeof a === 'string'"),
        ("use-isnan", "a === NaN", "isNaN(a)"), ("no-sparse-arrays", "a = [1, , 2]", "a = [1, 2,]; [, b] = a"), ("no-cond-assign", "if (a = b) {}", "if ((a = b)) {}"), ("eqeqeq", "a == null", "a === null"),
        ("no-unused-vars", "const a = 1; function f(p, q) { return p }", "let a = 1; a; export function f(p, q) { return q } export const b = 2"), ("no-empty-pattern", "const {} = a", "const { b } = a; [] = a; x = {}"),
        ("no-func-assign", "function f() {} f = 1", "let f = function () {}; f = 1"), ("no-import-assign", "import a from 'a'; a = 1", "import a from 'a'; a.b = 1"),
        ("no-setter-return", "class A { set x(v) { return 1 } }", "class A { set x(v) { return } get x() { return 1 } }"), ("no-constructor-return", "class A { constructor() { return {} } }", "class A { constructor() { f(() => { return 1 }) } }"),
        ("no-unsafe-finally", "function f() { try { a() } catch (e) { b() } finally { return 1 } }", "function f() { try { a() } finally { for (;;) { break } (() => { return 1 })() } }"),
        ("no-fallthrough", "switch (a) { case 1: b(); case 2: c() }", "switch (a) { case 1: case 2: b(); break; case 3: if (c) { return } else { throw d } case 4: e(); // falls through\n case 5: f() }"),
        ("no-invalid-regexp", "new RegExp('[')", "new RegExp('[a-z]+', 'gi'); RegExp(a)"), ("no-control-regex", r"a = /\x1f\u0002/", r"a = /\x20\t\n/"),
        ("no-unexpected-multiline", "a = b\n(c || d).e()", "a = b;\n(c || d).e(); f(\n1)"), ("no-constant-binary-expression", "a = {} || b", "a = b || {}; c = b ?? 1"),
        ("no-loss-of-precision", "a = 9007199254740993", "a = 9007199254740992; b = 0.1; c = 1e21; d = 5123000000000000000000; e = 0x1FFFFFFFFFFFFF"),
        ("no-unmodified-loop-condition", "let a = 1; while (a) { b() }", "let a = 1, c = 2; while (a < c) { a++ } for (let i = 0; i < c; i++) {} while (c.d) {} let q = 1; function g() { q = 0 } while (q) { g() }"),
        ("react-hooks/rules-of-hooks", "function App() { if (a) { useState(1) } }", "function App() { const [a] = useState(1); useCustom(a); return null }"),
        ("react-hooks/exhaustive-deps", "function App({ a }) { useEffect(() => { b(a) }, []) }", "function App({ a, p }) { const [s, set] = useState(0); const r = useRef(); useEffect(() => { set(a + p.x.y + r.current) }, [a, p.x]); useMemo(() => s, [s]) }"),
    ]


HOOKS = [
    ("function App() { for (;;) { useA() } }", "may be executed more than once"), ("function App() { if (a) return null; useA() }", "after an early return"), ("function helper() { useA() }", "neither a React function component"),
    ("useA()", "at the top level"), ("class K { render() { useA() } }", "in a class component"), ("function App() { a.map(() => { useA() }) }", "inside a callback"), ("async function App() { useA() }", "in an async function"),
    ("const App = () => { const x = a && useA() }", "is called conditionally"), ("const App = memo(() => { useA(); return null })", None), ("function useB() { return useA() }", None), ("function App() { const y = use(a ? b : c) }", None),
]


def test_hooks(spark):
    t = tree(spark, *[s for s, _ in HOOKS])
    got = {r.rel_path: r.message for r in rules.lint_findings(t, ["react-hooks/rules-of-hooks"]).collect()}
    for i, (source, said) in enumerate(HOOKS):
        assert (said is None and f"f{i}.js" not in got) or (said and said in got[f"f{i}.js"]), (source, got.get(f"f{i}.js"))


def test_hook_dependencies(spark):
    source = "function App({ a, b, c }) { const k = 1; const f = () => 1; useCallback(() => { f(); b.go(); c.x.y; k; let z = a; function own() {} own() }, []) }"
    got = rules.lint_findings(tree(spark, source), ["react-hooks/exhaustive-deps"]).collect()
    assert [r.message for r in got] == ["React Hook useCallback has missing dependencies: 'a', 'b', 'c.x.y', and 'f'. Either include them or remove the dependency array."]


def test_literals():
    from loomspark.frontend import notes

    assert all(notes.regex_fault(x, f) for x, f in [("(", ""), (")", ""), ("*a", ""), ("a{2,1}", ""), ("[a", ""), ("a\\", ""), ("a", "gg"), ("a", "z"), ("(?<1a>b)", ""), ("(?<n>a)(?<n>b)", ""), ("(?x)", "")])
    assert not any(notes.regex_fault(x, f) for x, f in [("a{2,3}?", ""), ("[\\]]", ""), ("(?:a|b)*", "gimsuy"), ("(?<n>a)\\k<n>", "u"), ("^a$", ""), ("a{", ""), ("(?<=a)b(?!c)", "")])
    assert [notes.loses_precision(x) for x in ("5e-324", "1.0000000000000001", "123456789012345678", "0b11", "100000000000000000000000", "0x20000000000001", "1e400", "0.0", "3.14")] == [False, True, True, False, False, True, True, False, False]


def test_lint(spark):
    t = tree(spark, *[source for _, bad, good in LINT for source in (bad, good)])
    found = {(r.rule_id, r.rel_path): r.n for r in rules.lint_findings(t).groupBy("rule_id", "rel_path").agg(F.count("*").alias("n")).collect()}
    assert {r for r, _, _ in LINT} == set(rules.LINT)
    for i, (rule, _, _) in enumerate(LINT):
        many = {"no-undef": 2, "no-unused-vars": 3}.get(rule, 1)
        # an empty target of an assignment is an empty pattern, too
        assert (found.get((rule, f"f{2 * i}.js")), found.get((rule, f"f{2 * i + 1}.js"))) == (many, 1 if rule == "no-empty-pattern" else None), rule


OUTLINE = """import React, { useState as us } from 'react';
import * as all from './b';
export const A = () => 1, B = 2;
export default async function main() {}
export { A as C };
export * from './c';
class K {}
const plain = 3;
"""


def test_outline(spark):
    t = tree(spark, OUTLINE, "let x = 1;")
    s = {r.rel_path: r for r in outline.summaries(t).collect()}
    one = s["f0.js"]
    assert one.statement_count == 8 and [(r.line, r.import_source, r.n_specifiers) for r in one.imports] == [(1, "react", 2), (2, "./b", 1)]
    assert [tuple(r) for r in one.exports] == [(3, "named", "A"), (3, "named", "B"), (4, "default", "main"), (5, "named", "C"), (6, "all", "* from ./c")]
    assert [tuple(r) for r in one.functions] == [(3, "A", "arrow-function", False), (4, "main", "function-declaration", True)] and [tuple(r) for r in one.classes] == [(7, "K")]
    assert [(r.name, r.kind) for r in one.react_component_candidates] == [("A", "function"), ("K", "class")]
    assert s["f1.js"].statement_count == 1 and s["f1.js"].functions == []
    assert {(r.import_source, r.imported_name, r.local_name, r.kind) for r in outline.bindings_imported(t).collect()} == {("react", "default", "React", "default"), ("react", "useState", "us", "named"), ("./b", "*", "all", "namespace")}


def test_chunks(spark):
    files = spark.createDataFrame([("f0.js", OUTLINE), ("f1.js", "let x = 1;\n"), ("f2.js", "  \n"), ("f3.js", "a(")], "rel_path string, source_text string")
    got = {r.id: r for r in outline.chunks(files, nodes.parsed(files), max_tokens=185).collect()}
    assert set(got) == {"f0.js:A:3-3", "f0.js:main:4-4", "f0.js:K:7-7", "f1.js:module:1-2"}
    a = got["f0.js:A:3-3"]
    assert (a.kind, a.code, a.imports) == ("react-component", "export const A = () => 1, B = 2;", OUTLINE.split("\n")[:2]) and a.tokens == 11 + 25 + 150 and a.reason == "token-limit"
    assert got["f1.js:module:1-2"].reason is None and got["f1.js:module:1-2"].code == "let x = 1;"


def test_review(spark):
    files = spark.createDataFrame([("a.js", "const a = 1;\nif (a == 1) {}\nmissing();\n"), ("b.js", "x("), ("c.jsx", REACT)], "rel_path string, source_text string")
    r = code.review(files)
    found = [(x.rel_path, x.line_start, x.rule_id) for x in r.findings.collect()]
    assert found[:2] == [("a.js", 2, "eqeqeq"), ("a.js", 3, "no-undef")] and ("c.jsx", 10, "react/array-index-key") in found and found == sorted(found, key=lambda x: x[:2])
    s = r.summary().first()
    assert (s.parsed, s.failed, s.components, s.effects, s.states, s.findings) == (2, 1, 3, 2, 2, len(found))
    ranges = spark.createDataFrame([("a.js", 3, 3)], "rel_path string, start int, end int")
    assert [(x.rel_path, x.line_start) for x in code.review(files, ranges, code.Options(react=None)).findings.collect()] == [("a.js", 3)]


def test_dependencies(spark):
    source = """import a, { b } from './a';
const LIMIT = 3, other = LIMIT;
let count = 0;
export function useThing() { return helper(b) + LIMIT }
function helper(x) { const LIMIT = 1; return LIMIT + x + a + helper(x) }
export const View = () => { return <div>{useThing()}{local}</div> };
const Memo = memo(View);
class K {}
class P extends React.Component {}
export default Memo;
"""
    got = {r.name: r for r in dependencies.graph(tree(spark, source)).collect()}
    assert {n: r.kind for n, r in got.items()} == {"LIMIT": "constant", "other": "constant", "count": "variable", "useThing": "custom-hook", "helper": "function", "View": "react-component", "Memo": "react-component", "K": "class", "P": "react-component"}
    assert {n: r.dependencies for n, r in got.items() if r.dependencies} == {"other": ["LIMIT"], "useThing": ["LIMIT", "helper"], "View": ["useThing"], "Memo": ["View"]}
    assert got["helper"].external_imports == ["a"] and got["useThing"].external_imports == ["b"] and got["LIMIT"].dependents == ["other", "useThing"] and got["helper"].dependents == ["useThing"]
    assert {n for n, r in got.items() if r.exported} == {"useThing", "View", "Memo"} and [n for n, r in got.items() if r.is_default] == ["Memo"]


def test_module_edges(spark):
    files = {"src/a.js": "import './b'; import x from '../lib'; import 'react'; export * from './c.jsx'; import './none'; import '../../out'", "src/b.js": "", "src/b.jsx": "", "src/c.jsx": "import './a.js'", "lib/index.ts": "interface X {}", "top.js": "export { q } from './src/b'; import '.'", "index.js": ""}
    t = nodes.parsed(spark.createDataFrame(list(files.items()), "rel_path string, source_text string"))
    assert {tuple(r) for r in dependencies.module_edges(t).collect()} == {("src/a.js", "src/b.js"), ("src/a.js", "lib/index.ts"), ("src/a.js", "src/c.jsx"), ("src/c.jsx", "src/a.js"), ("top.js", "src/b.js"), ("top.js", "index.js")}


def test_import_cycles_of_files_about_to_be_written(spark):
    sources = {"a.js": "import './b'", "b.js": "import './c'", "c.js": "export const c = 1", "x.js": "import './y'", "y.js": "export * from './x'"}
    t = nodes.parsed(spark.createDataFrame(list(sources.items()), "rel_path string, source_text string")).cache()
    found = lambda **k: {r.component: r.path for r in dependencies.import_cycles(t, **k).collect()}
    assert found() == {"x.js": ["x.js", "y.js", "x.js"]}
    texts = spark.createDataFrame([("c.js", "import './new'"), ("new.js", "import './a'"), ("y.js", None)], "rel_path string, source_text string")
    assert found(texts=texts) == {"a.js": ["a.js", "b.js", "c.js", "new.js", "a.js"]}
    assert found(start="a.js") == {} and found(start="y.js") == {"x.js": ["x.js", "y.js", "x.js"]}
