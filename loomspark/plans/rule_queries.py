"""Rules over scripts that are built from table columns: every row of `part` gives one script, and SQL states its findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.frontend import candidates, rules, targets
from loomspark.frontend import nodes as N
from loomspark.plans.store import written

#: Scripts in which @ stands for the row's key: the rule, its message and line, or no message where the rule is silent.
SCRIPTS: list[tuple[str, str, str | None, int]] = [
    ("missing_@()", "no-undef", "'missing_@' is not defined.", 1),
    ("let q_@; q_@; typeof missing_@; <div/>", "no-undef", None, 0),
    ("function f() {\n  return;\n  a_@()\n}", "no-unreachable", "Unreachable code.", 3),
    ("function f() { if (a) { return } else { throw b }\n a_@() }", "no-unreachable", "Unreachable code.", 2),
    ("function f() { while (true) { if (a) break }\n a_@() }", "no-unreachable", None, 0),
    ("x = { k_@: 1,\n 'k_@': 2 }", "no-dupe-keys", "Duplicate key 'k_@'.", 2),
    ("x = { get k_@() {}, set k_@(v) {} }", "no-dupe-keys", None, 0),
    ("function f(p_@, b, p_@) {}", "no-dupe-args", "Duplicate param 'p_@'.", 1),
    ("if (a) {} else if (b === @) {} else if (c) {}\n else if (b === @) {}", "no-dupe-else-if", "This branch can never execute. Its condition is a duplicate or covered by previous conditions in the if-else-if chain.", 2),
    ("if (a) {} else if (b === @) { if (a) {} }", "no-dupe-else-if", None, 0),
    ("switch (a) { case @: b(); break;\n case @: c() }", "no-duplicate-case", "Duplicate case label.", 2),
    ("a_@.b = a_@.b", "no-self-assign", "'a_@.b' is assigned to itself.", 1),
    ("a_@ += a_@", "no-self-assign", None, 0),
    ("a_@ >= a_@", "no-self-compare", "Comparing to itself is potentially pointless.", 1),
    ("if (@) {}", "no-constant-condition", "Unexpected constant condition.", 1),
    ("while (true) { a(@) }", "no-constant-condition", None, 0),
    ("typeof a === 'strin@'", "valid-typeof", "Invalid typeof comparison value.", 1),
    ("a_@ < NaN", "use-isnan", "Use the isNaN function to compare with NaN.", 1),
    ("\na = [@, , 2]", "no-sparse-arrays", "Unexpected comma in middle of array.", 2),
    ("if (a = @) {}", "no-cond-assign", "Expected a conditional expression and instead saw an assignment.", 1),
    ("if ((a = @)) {}", "no-cond-assign", None, 0),
    ("a_@ != null", "eqeqeq", "Expected '!==' and instead saw '!='.", 1),
    ("const u_@ = 1", "no-unused-vars", "'u_@' is assigned a value but never used.", 1),
    ("export const u_@ = 1; export function f(p, q) { return q }", "no-unused-vars", None, 0),
    ("const { k: [] } = a_@", "no-empty-pattern", "Unexpected empty array pattern.", 1),
    ("function f_@() {}\nf_@ = 1", "no-func-assign", "'f_@' is a function.", 2),
    ("import i_@ from 'm'; i_@ = 1", "no-import-assign", "'i_@' is read-only.", 1),
    ("class A { set x(v) { return @ } }", "no-setter-return", "Setter cannot return a value.", 1),
    ("class A { constructor() { return { a: @ } } }", "no-constructor-return", "Unexpected return statement in constructor.", 1),
    ("function f() { try { a(@) } finally {\n throw b } }", "no-unsafe-finally", "Unsafe usage of ThrowStatement.", 2),
    ("function f() { try { a(@) } finally { for (;;) { break } } }", "no-unsafe-finally", None, 0),
    ("switch (a) { case @: b();\n default: c() }", "no-fallthrough", "Expected a 'break' statement before 'default'.", 2),
    ("switch (a) { case @: b(); /* falls through */ default: c() }", "no-fallthrough", None, 0),
    ("RegExp('(@')", "no-invalid-regexp", "Invalid regular expression: /(@/: Unterminated group.", 1),
    ("RegExp('(@)', 'gi')", "no-invalid-regexp", None, 0),
    ("a = /\\x07@/", "no-control-regex", "Unexpected control character(s) in regular expression: \\x07.", 1),
    ("a = b_@\n[0, 1].c()", "no-unexpected-multiline", "Unexpected newline between object and [ of property access.", 1),
    ("a = b ?? @;\nc = `x` ?? d", "no-constant-binary-expression", "Unexpected constant nullishness on the left-hand side of a `??` expression.", 2),
    ("a === [@]", "no-constant-binary-expression", "Unexpected comparison to newly constructed object. These two values can never be equal.", 1),
    ("a = 9007199254740993 + @", "no-loss-of-precision", "This number literal will lose precision at runtime.", 1),
    ("a = 9007199254740992 + 0.5", "no-loss-of-precision", None, 0),
    ("let w_@ = 1, x = 2;\nwhile (w_@ < @) { x++ }", "no-unmodified-loop-condition", "'w_@' is not modified in this loop.", 2),
    ("let w_@ = 1; while (w_@ < 9) { w_@++ }", "no-unmodified-loop-condition", None, 0),
    ("function App() {\n for (;;) { useA_@() }\n}", "react-hooks/rules-of-hooks", 'React Hook "useA_@" may be executed more than once. Possibly because it is called in a loop. React Hooks must be called in the exact same order in every component render.', 2),
    ("function App() { useA_@(); return null }", "react-hooks/rules-of-hooks", None, 0),
    ("function App({ p_@ }) { useMemo(() => p_@.a + p_@.b,\n []) }", "react-hooks/exhaustive-deps", "React Hook useMemo has missing dependencies: 'p_@.a' and 'p_@.b'. Either include them or remove the dependency array.", 2),
    ("function App({ p_@ }) { useMemo(() => p_@.a, [p_@]) }", "react-hooks/exhaustive-deps", None, 0),
    ("const App = () => { const [s_@, set] = useState([]);\n s_@.push(1); return <a>{set}</a> }", "react/direct-state-mutation", "React state 's_@' is mutated directly through 'push'.", 2),
    ("const App = () => { const [s, set] = useState(0);\n set(s + @); return <a/> }", "react/direct-state-mutation", None, 0),
    ("function App() { useEffect(async () => { a(@) }); return <a/> }", "react/async-effect-callback", "The useEffect callback is async and therefore returns a Promise instead of an effect cleanup function.", 1),
    ("const App = () => <ul>{a.map((x, i_@) => <li key={i_@}/>)}</ul>", "react/array-index-key", "Array index 'i_@' is used as a React key.", 1),
    ("const App = () => <ul>{a.map((x, i_@) => <li key={x.id}/>)}</ul>", "react/array-index-key", None, 0),
    ("new ResizeObserverEntry(MediaQueryList, CSSStyleSheet, scrollY, BroadcastChannel, ReadableStream, DOMRect, onresize, @)", "no-undef", None, 0),
    ("function f() { return; function g() {}\n ; var v\n x_@() }", "no-unreachable", "Unreachable code.", 3),
    ("function f() { return a_@; function g() {} var v }", "no-unreachable", None, 0),
    ("if (a || b_@) {}\n else if (a) {}", "no-dupe-else-if", "This branch can never execute. Its condition is a duplicate or covered by previous conditions in the if-else-if chain.", 2),
    ("if (a) {}\n else if (a && b_@) {}", "no-dupe-else-if", "This branch can never execute. Its condition is a duplicate or covered by previous conditions in the if-else-if chain.", 2),
    ("if (a) {} else if (a || b_@) {}", "no-dupe-else-if", None, 0),
    ("if (a && b_@) {} else if (c) {}\n else if (d && b_@ && a) {}", "no-dupe-else-if", "This branch can never execute. Its condition is a duplicate or covered by previous conditions in the if-else-if chain.", 2),
    ("if (a) {} else if (b_@) {}\n else if (c && (a || b_@)) {}", "no-dupe-else-if", "This branch can never execute. Its condition is a duplicate or covered by previous conditions in the if-else-if chain.", 2),
    ("if (a && b_@) {} else if (a || b_@) {}", "no-dupe-else-if", None, 0),
    ("[a, b_@] = [b_@, b_@]", "no-self-assign", "'b_@' is assigned to itself.", 1),
    ("[a, b_@] = [b_@, a]", "no-self-assign", None, 0),
    ("({ k: [c.d_@] } = { ...e,\n k: [c.d_@] })", "no-self-assign", "'c.d_@' is assigned to itself.", 2),
    ("if (!@) {}", "no-constant-condition", "Unexpected constant condition.", 1),
    ("a = `x@` ? b : c", "no-constant-condition", "Unexpected constant condition.", 1),
    ("if (a_@ || true) {}", "no-constant-condition", "Unexpected constant condition.", 1),
    ("if (a_@ && @) {}", "no-constant-condition", None, 0),
    ("do { a(@) }\n while (typeof b_@)", "no-constant-condition", "Unexpected constant condition.", 2),
    ("if (!(a_@ && false)) {}", "no-constant-condition", "Unexpected constant condition.", 1),
    ("if (a_@ || false || [b] === @) {}", "no-constant-condition", None, 0),
    ("if ((a, b_@ = -@)) {}", "no-constant-condition", "Unexpected constant condition.", 1),
    ("switch (a) { case @: break;\n case NaN: b() }", "use-isnan", "'case NaN' can never match. Use Number.isNaN before the switch.", 2),
    ("switch (NaN) { case @: b() }", "use-isnan", "'switch(NaN)' can never match a case clause. Use Number.isNaN instead of the switch.", 1),
    ("function f() { try { a(@) } finally { x: for (;;) { while (b) { break x } } } }", "no-unsafe-finally", None, 0),
    ("function f() { x: for (;;) { try { a(@) } finally {\n break x } } }", "no-unsafe-finally", "Unsafe usage of BreakStatement.", 2),
    ("function App_@() {" + "\n" * 210 + "return <a/> }", "react/component-too-large", "Component 'App_@' spans 211 lines, exceeding the configured maximum of 200.", 1),
    ("\nclass Big_@ extends React.Component {" + "\n" * 201 + "render() { return <a/> } }", "react/component-too-large", "Component 'Big_@' spans 202 lines, exceeding the configured maximum of 200.", 2),
    ("import { PureComponent as P } from 'react'; class Big_@ extends P {" + "\n" * 400 + "}", "react/component-too-large", "Component 'Big_@' spans 401 lines, exceeding the configured maximum of 200.", 1),
    ("const Wide_@ =\n memo(() => {" + "\n" * 200 + "return <a/> })", "react/component-too-large", "Component 'Wide_@' spans 201 lines, exceeding the configured maximum of 200.", 2),
    ("class Big_@ extends Other {" + "\n" * 300 + "} function plain() {" + "\n" * 300 + "return @ }", "react/component-too-large", None, 0),
    ("const App = () => { const [s_@, set] = useState({});\n\n s_@.a.b = @; return <a>{set}</a> }", "react/direct-state-mutation", "React state 's_@' is mutated directly through assignment.", 3),
    ("const App = () => { const [s_@, set] = React.useState({});\n s_@.n++; return <a>{set}</a> }", "react/direct-state-mutation", "React state 's_@' is mutated directly through an update expression.", 2),
    ("import { useState as held } from 'react'; const App = () => { const [s_@] = held([]);\n s_@.list.sort(); return <a/> }", "react/direct-state-mutation", "React state 's_@' is mutated directly through 'sort'.", 2),
    ("const App = () => { const [s_@, set] = useState([]); const t = [...s_@]; t.push(@); set(t); return <a/> }", "react/direct-state-mutation", None, 0),
    ("function App() { useEffect(() => {" + "\n" * 50 + "a(@) }); return <a/> }", "react/effect-too-large", "The useEffect callback spans 51 lines, exceeding the configured maximum of 50.", 1),
    ("import { useEffect as after } from 'react'; function App() {\n after(function () {" + "\n" * 60 + "a(@) }, []); return <a/> }", "react/effect-too-large", "The useEffect callback spans 61 lines, exceeding the configured maximum of 50.", 2),
    ("function App() { useEffect(() => {" + "\n" * 49 + "a(@) }); useLayoutEffect(() => {" + "\n" * 90 + "}); return <a/> }", "react/effect-too-large", None, 0),
    ("function App({ p_@, q }) { return useMemo(() => p_@,\n [p_@, q]) }", "react-hooks/exhaustive-deps", "React Hook useMemo has an unnecessary dependency: 'q'. Either exclude it or remove the dependency array.", 2),
    ("let out_@ = 1; function App() { useEffect(() => { a(out_@) },\n [out_@]) }", "react-hooks/exhaustive-deps", "React Hook useEffect has an unnecessary dependency: 'out_@'. Either exclude it or remove the dependency array. Outer scope values like 'out_@' aren't valid dependencies because mutating them doesn't re-render the component.", 2),
    ("function App({ p_@ }) { const r = useRef(); useEffect(() => { a(r.current) },\n [r.current]) }", "react-hooks/exhaustive-deps", None, 0),
    ("function App({ p_@, r }) { useCallback(() => p_@.a,\n [p_@.a, r.current]) }", "react-hooks/exhaustive-deps", "React Hook useCallback has an unnecessary dependency: 'r.current'. Either exclude it or remove the dependency array. Mutable values like 'r.current' aren't valid dependencies because mutating them doesn't re-render the component.", 2),
    ("function App({ p_@, t }) { const [s, set] = useState(0); useEffect(() => { set(p_@) }, [p_@, t, set]) }", "react-hooks/exhaustive-deps", None, 0),
    ("function App({ p_@ }) { const x = p_@; useMemo(() => x,\n [x, p_@()]) }", "react-hooks/exhaustive-deps", "React Hook useMemo has a complex expression in the dependency array. Extract it to a separate variable so it can be statically checked.", 2),
]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _part(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("int").alias("size"))


def _named(key: Column) -> Column:
    return F.concat(F.lit("part/"), key.cast("string"))


def rule_findings(spark, sf_dir: str) -> DataFrame:
    """Every lint and React rule on scripts that break it and on some that do not."""
    kinds = spark.createDataFrame([(k, s, r) for k, (s, r, _, _) in enumerate(SCRIPTS)], "kind int, script string, rule_id string")  # a fixed table
    rows = _part(spark, sf_dir).withColumn("kind", (F.col("key") % len(SCRIPTS)).cast("int")).join(F.broadcast(kinds), "kind")
    files = rows.select(_named(F.col("key")).alias("rel_path"), F.replace("script", F.lit("@"), F.col("key").cast("string")).alias("source_text"), "rule_id")
    nodes = written(N.parsed(files), "nodes")
    found = rules.lint_findings(nodes).unionByName(rules.react_findings(nodes))
    return found.join(files.select("rel_path", "rule_id"), ["rel_path", "rule_id"], "left_semi").select("rel_path", "rule_id", "message", "line_start")


def complexity_findings(spark, sf_dir: str) -> DataFrame:
    """Complexity rules on functions with as many parameters, nested decisions and lines as their row's columns say."""
    k = F.col("key")
    params = F.array_join(F.transform(F.sequence(F.lit(0), (k % 13).cast("int")), lambda i: F.concat(F.lit("p"), i.cast("string"))), ", ")
    depth = (k % 11).cast("int")
    body = F.concat(F.repeat(F.lit("if (a) { "), depth), F.repeat(F.lit("b();\n"), F.col("size") * 2), F.repeat(F.lit(" }"), depth), F.repeat(F.lit(" a && b;"), (k % 17).cast("int")))
    source = F.concat(F.lit("function f"), k.cast("string"), F.lit("("), params, F.lit(") {\n"), body, F.lit("\n}"))
    nodes = written(N.parsed(_part(spark, sf_dir).select(_named(k).alias("rel_path"), source.alias("source_text")), rules.MEASURED, rules.weighed), "nodes")
    return rules.complexity_findings(nodes).select("rel_path", "rule_id", "severity", "message", "line_start", "line_end")


def split_candidates(spark, sf_dir: str) -> DataFrame:
    """What could move out of files that have a constant, a service, a Hook, a function as long as its row's p_size says and a page, and where to."""
    k = F.col("key").cast("string")
    head = "import axios from 'axios';\nconst LIMITS_@ = { a: 1 };\nexport async function fetchItem_@(id) {\n  return axios.get('/x/' + id);\n}\nexport const useItem_@ = () => React.useState(LIMITS_@);\nexport function sum_@(a, b) {\n"
    tail = "  return a + b;\n}\nexport default function Page_@() { return <div>{useItem_@()}</div> }\n"
    source = F.replace(F.concat(F.lit(head), F.repeat(F.lit("  b = a + b;\n"), F.col("size")), F.lit(tail)), F.lit("@"), k)
    nodes = written(N.parsed(_part(spark, sf_dir).select(F.concat(F.lit("p"), k, F.lit("/orders.js")).alias("rel_path"), source.alias("source_text")), candidates.READ, candidates.told), "nodes")
    found = targets.allocated(written(candidates.detected(nodes), "candidates"))
    return found.select("rel_path", "kind", "symbol", "line_start", "line_end", "confidence", "safety", "target_file", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("dependents", ",").alias("dependents"))


QUERIES = {"split_candidates": split_candidates, "rule_findings": rule_findings, "rule_complexity": complexity_findings}
_TOLD = ", ".join(f"({k}, {_quoted(r)}, {_quoted(m)}, {line})" for k, (_, r, m, line) in enumerate(SCRIPTS) if m)
SQL = {
    "split_candidates": """with c as (select p_partkey as k, p_size::int as size from part), v(kind, name, a, b, confidence, file, needs, needed) as (values
('constant-group', 'LIMITS_', 2, 2, 0.88, 'order.constants.js', '', 'useItem_'), ('service', 'fetchItem_', 3, 5, 0.90, 'order.service.js', '', ''), ('custom-hook', 'useItem_', 6, 6, 0.93, '@', 'LIMITS_', 'Page_'), ('utility', 'sum_', 7, 9, 0.89, 'order.utils.js', '', ''))
select 'p' || k || '/orders.js' as rel_path, kind, name || k as symbol, a::int as line_start, (b + case kind when 'utility' then size else 0 end)::int as line_end, confidence::double as confidence, 'automatic-ready' as safety,
  'p' || k || '/orders/' || case file when '@' then name || k || '.js' else file end as target_file, case needs when '' then '' else needs || k end as dependencies, case needed when '' then '' else needed || k end as dependents
from c, v where kind <> 'utility' or size >= 2""",
    "rule_findings": f"select 'part/' || p_partkey as rel_path, rule_id, replace(message, '@', p_partkey::varchar) as message, line_start from part join (values {_TOLD}) v(kind, rule_id, message, line_start) on p_partkey % {len(SCRIPTS)} = kind",
    "rule_complexity": """with f as (select p_partkey as k, p_size::int * 2 + 3 as lines, p_partkey % 13 + 1 as params, p_partkey % 11 as depth, 1 + p_partkey % 11 + p_partkey % 17 as cyclomatic from part),
m as (select k, lines, 'complexity/function-too-long' as rule_id, lines as v, 80 as most, 'has ' || lines || ' lines' as says from f union all select k, lines, 'complexity/too-many-parameters', params, 5, 'has ' || params || ' parameters' from f
union all select k, lines, 'complexity/high-cyclomatic-complexity', cyclomatic, 10, 'has cyclomatic complexity ' || cyclomatic from f union all select k, lines, 'complexity/deep-nesting', depth, 4, 'has a nesting depth of ' || depth from f)
select 'part/' || k as rel_path, rule_id, case when v >= 2 * most then 'high' when rule_id like '%parameters' and v = most + 1 then 'low' else 'medium' end as severity, 'Function ''f' || k || ''' ' || says || ', exceeding the configured maximum of ' || most || '.' as message, 1 as line_start, lines as line_end from m where v > most""",
}
