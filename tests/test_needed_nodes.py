"""Rules that need few nodes get them alone, in few reads, with the findings that all nodes give."""

import re

from pyspark.sql import functions as F

from loomspark.frontend import candidates, rules
from loomspark.frontend import nodes as N
from loomspark.plans import rule_queries as Q
from loomspark.plans.store import written

MORE = [
    "function f(a, b, c, d, e, g) { if (a && b || c) { for (;;) { while (b) { switch (a) { case 1: case (b ? 1 : 2): try { g() } catch { } } } } } return (x) => (y) => y ? x : 0 }",
    "import k from 'k'; export const Big_@ = { a: [1, ...k] }; export { Big_@ as c }; function Inner_@() { let n = 0; function step() { n++; return <b>{n}</b> }\n\n\n return step }\nexport default Inner_@",
    "const api_@ = { get() { return axios.get(u) } };\nexport function useT_@() { if (a) { useB() } with (x) { eval(y) } module.exports = 1 }\nclass P_@ extends React.Component { render() { return <i/> } }",
]


def files(spark):
    return spark.createDataFrame([(f"f{i}", s.replace("@", str(i))) for i, s in enumerate([*(s for s, *_ in Q.SCRIPTS), *MORE, "broken ("])], "rel_path string, source_text string")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_complexity_needs_few_nodes_and_measures_once(spark):
    every, some = written(N.parsed(files(spark))), written(N.parsed(files(spark), rules.MEASURED, rules.weighed))
    limits = {"lines": 1, "params": 0, "cyclomatic": 1, "nesting": 0}
    found = rules.complexity_findings(some, limits)
    assert rows(found) == rows(rules.complexity_findings(every, limits)) and {r.rule_id for r in found.select("rule_id").distinct().collect()} == {"complexity/function-too-long", "complexity/too-many-parameters", "complexity/high-cyclomatic-complexity", "complexity/deep-nesting"}
    assert some.columns == rules.MEASURED and 3 * some.count() < every.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) <= 3  # before: for each of the four rules


def test_candidates_need_few_nodes(spark):
    every, some = written(N.parsed(files(spark))), written(N.parsed(files(spark), candidates.READ, candidates.told))
    found = candidates.detected(some, min_lines=1)
    assert rows(found) == rows(candidates.detected(every, min_lines=1)) and found.select(F.countDistinct("kind")).first()[0] >= 4
    assert some.columns == candidates.READ and some.count() < every.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) <= 16  # the graph of declarations is made once


def test_no_plan_holds_all_rules(spark):
    """Few rules are found and stored at a time; what is returned reads their findings."""
    nodes = written(N.parsed(files(spark)))
    found = rules.lint_findings(nodes)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(rules.lint_findings(nodes, ["eqeqeq", "no-dupe-keys"])) == rows(found.where("rule_id in ('eqeqeq', 'no-dupe-keys')")) and found.select(F.countDistinct("rule_id")).first()[0] >= 25
