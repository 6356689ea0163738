from loomspark.frontend import candidates, nodes

SOURCE = """import { api } from './api';
export const COLORS = { red: 1 };
const BAD = [make()];
export async function loadUser(id) { return fetch('/u/' + id) }
function useUser() { if (a) { useState(1) } return 1 }
export function formatDate(d) {
  const a = d;
  const b = a;
  return b;
}
function small() { return 1 }
const Card = () => { return <div>{COLORS.red}</div> };
function risky() {
  eval('x');
  const a = 1;
  return a;
}
export default function Page() {
  let count = 0;
  const handleClick = () => { count += 1 };
  const plain = () => 1;
  function inner(p) { return p }
  return <Card onClick={handleClick}>{useUser()}{risky()}</Card>;
}
"""


def test_candidates(spark):
    t = nodes.parsed(spark.createDataFrame([("src/Page.jsx", SOURCE), ("b.js", "const x = 1;")], "rel_path string, source_text string")).cache()
    got = {r.symbol: r for r in candidates.detected(t).collect()}
    assert {s: (r.id, r.kind, r.safety, r.confidence) for s, r in got.items()} == {
        "COLORS": ("colors", "constant-group", "automatic-ready", 0.88), "BAD": ("bad", "constant-group", "manual-review", 0.55), "loadUser": ("load-user", "service", "automatic-ready", 0.90), "useUser": ("use-user", "custom-hook", "blocked", 0.60),
        "formatDate": ("format-date", "utility", "automatic-ready", 0.89), "Card": ("card", "react-component", "automatic-ready", 0.91), "risky": ("risky", "utility", "blocked", 0.60), "handleClick": ("handle-click", "utility", "blocked", 0.60),
    }
    assert got["Card"].dependencies == ["COLORS"] and got["Card"].dependents == ["Page"] and got["handleClick"].captured == ["count"] and got["handleClick"].dependents == ["Page"]
    assert got["useUser"].risks == ["Conditional hook execution detected"] and got["risky"].risks == ["Uses dynamic eval()"]
    assert [r.symbol for r in candidates.detected(t, most=2).orderBy("line_start").collect()] == ["COLORS", "BAD"]


def test_equal_names(spark):
    source = "const A_B = [1];\nconst aB = [2];\n"
    t = nodes.parsed(spark.createDataFrame([("f.js", source)], "rel_path string, source_text string"))
    assert sorted((r.line_start, r.id) for r in candidates.detected(t).collect()) == [(1, "a-b"), (2, "a-b-2")]
