import pytest
from pyspark.sql import functions as F

from loomspark.frontend import candidates, dependencies, splitting, targets
from loomspark.frontend.nodes import parsed

SOURCE = """import axios from 'axios';
import { format } from './format';
import React from 'react';

const LIMIT = 10;
const SHARED = { a: 1 };
function pick(x) { return x + LIMIT; }

export async function fetchOrders(id) {
  const r = await axios.get('/o/' + id);
  return pick(r.data) + SHARED.a;
}

export const useOrders = () => {
  const [s, setS] = React.useState(SHARED);
  return format(s);
};

export default function OrdersPage() {
  let n = 0;
  function handleClick(e) {
    n = n + 1;
    return e + n;
  }
  return <div onClick={handleClick}>{useOrders()}</div>;
}
"""


@pytest.fixture(scope="module")
def made(spark):
    files = spark.createDataFrame([("src/OrdersPage.jsx", SOURCE)], "rel_path string, source_text string").cache()
    nodes = parsed(files).cache()
    nodes.count()
    stored = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  (a few rows; the plans above them stay small)
    graph = stored(dependencies.graph(nodes))
    planned = stored(targets.allocated(stored(candidates.detected(nodes))))
    return files, nodes, graph, planned


@pytest.mark.parametrize(
    "kind, symbol, source, name",
    [
        ("react-component", "ProductCard", "src/ProductPage.jsx", "ProductCard.jsx"), ("custom-hook", "useCart", "src/ProductPage.jsx", "useCart.js"), ("service", "fetchProducts", "src/ProductPage.jsx", "product.service.js"),
        ("utility", "formatPrice", "src/index.js", "price.utils.js"), ("constant-group", "ORDER_LABELS", "orders.js", "order.constants.js"), ("utility", "get", "src/app.js", "app.utils.js"), ("other", "a$b", "x.js", "ab.js"),
        ("service", "x", "src/user-list-view.js", "user-list.service.js"), ("utility", "y", "bus.js", "bus.utils.js"),
    ],
)
def test_file_names(spark, kind, symbol, source, name):
    assert spark.range(1).select(targets.file_name(F.lit(kind), F.lit(symbol), F.lit(source))).first()[0] == name


@pytest.mark.parametrize("a, b, path", [("src/A.jsx", "src/A/b.js", "./A/b.js"), ("src/A/b.js", "src/A.jsx", "../A.jsx"), ("a.js", "b.js", "./b.js"), ("x/y/a.js", "z/b.js", "../../z/b.js"), ("x/a.js", "x/x/a.js", "./x/a.js")])
def test_relative_imports(spark, a, b, path):
    assert spark.range(1).select(targets.relative_import(F.lit(a), F.lit(b))).first()[0] == path


def test_targets(spark, made):
    rows = [("f.js", 1, "hook", "a"), ("f.js", 2, "utility", "getFoo"), ("f.js", 3, "utility", "getBar"), ("index.js", 1, "utility", "x")]
    df = spark.createDataFrame(rows, "rel_path string, line_start int, kind string, symbol string").withColumn("id", F.col("symbol"))
    got = {r.symbol: r.target_file for r in targets.allocated(df).collect()}
    assert got == {"a": "f/a.js", "getFoo": "f/f.utils.js", "getBar": "f/f.utils.js", "x": "index/x.utils.js"}
    clash = spark.createDataFrame([("f.js", 1, "one", "x"), ("f.js", 2, "two", "x")], "rel_path string, line_start int, kind string, symbol string")
    assert {r.target_file for r in targets.allocated(clash, "lib").collect()} == {"lib/x.js"}
    there = spark.createDataFrame([("f/a.js",)], "rel_path string")
    assert [r.id for r in targets.conflicts(targets.allocated(df), there).collect()] == ["a"]
    with pytest.raises(Exception, match="leaves the root"):
        targets.allocated(df, "../out").collect()


def test_plan(spark, made):
    files, nodes, graph, planned = made
    ids = {r.symbol: r.id for r in planned.collect()}
    assert ids.keys() >= {"fetchOrders", "useOrders", "handleClick"} and "OrdersPage" not in ids
    placed = splitting.placement(planned, graph)
    by_id = {r.id: r for r in placed.collect()}
    fetch = by_id[ids["fetchOrders"]]
    assert (fetch.moved, fetch.remaining) == (["LIMIT", "pick"], ["SHARED"])
    told = {(r.id, r.name): r for r in splitting.contract(planned, nodes).collect()}
    n = told[ids["handleClick"], "n"]
    assert (n.usage, n.resolution, n.passed_as) == ("mutate", "unresolved", "n")
    got = {(r.into, r.import_source, r.local_name, r.kind) for r in splitting.imports(planned, placed, nodes).collect() if r.id == ids["fetchOrders"]}
    assert got == {("target", "axios", "axios", "default"), ("target", "../OrdersPage.jsx", "SHARED", "named"), ("source", "./OrdersPage/order.service.js", "fetchOrders", "named")}
    out = {(r.place, r.name, r.kind) for r in splitting.exports(planned, placed, graph).collect() if r.id == ids["fetchOrders"]}
    assert out == {("target", "fetchOrders", "named"), ("re-export", "fetchOrders", "named")}
    listing = spark.createDataFrame([("src/OrdersPage/useOrders.js",)], "rel_path string")
    found = {(r.level, r.rule, r.symbol) for r in splitting.problems(planned, graph, files, listing).collect()}
    assert found == {("warning", "target-exists", "useOrders")}
    row = splitting.summary(planned, graph, files, nodes, listing).first()
    assert (row.lines, row.declarations, row.imports, row.exports, row.conflicts) == (SOURCE.count("\n") + 1, 6, 3, 3, 1) and row.detected == row.safe + row.unsafe == len(ids)


def test_problems(spark, made):
    files, _, graph, planned = made
    one = planned.where("symbol = 'useOrders'")
    bad = one.withColumn("line_end", F.lit(999)).withColumn("target_file", F.col("rel_path")).withColumn("captured", F.array(F.lit("q"))).withColumn("safety", F.lit("automatic-ready")).withColumn("dependencies", F.array(F.lit("nowhere"), F.lit("fetchOrders")))
    other = planned.where("symbol = 'fetchOrders'").withColumn("dependencies", F.array(F.lit("useOrders")))
    got = {(r.rule, r.symbol) for r in splitting.problems(bad.unionByName(bad).unionByName(other), graph, files, files.select("rel_path")).collect()}
    assert got == {("repeated-id", "useOrders"), ("lines-beyond-file", "useOrders"), ("target-is-source", "useOrders"), ("safe-with-captures", "useOrders"), ("target-exists", "useOrders"), ("unknown-dependency", "useOrders"), ("mutual-dependency", "useOrders"), ("mutual-dependency", "fetchOrders")}


def test_advice(spark, made):
    planned = made[3].where("symbol = 'useOrders'")
    rel, id_ = planned.select("rel_path", "id").first()
    advice = spark.createDataFrame([(rel, id_, "  ", 1.5, ["slow", " "]), (rel, "none", "x", 0.1, ["y"])], "rel_path string, id string, reason string, confidence double, risks array<string>")
    old, new = planned.first(), splitting.advised(planned, advice).first()
    assert (new.reason, new.confidence, new.risks, new.safety) == (old.reason, old.confidence, [*old.risks, "slow"], "manual-review")


def test_inputs(tmp_path):
    (tmp_path / "a.js").write_text("x")
    (tmp_path / "b.js").write_bytes(b"a\0b")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "d.js").write_text("x" * 2048)
    (tmp_path / "l.js").symlink_to(tmp_path / "a.js")
    (tmp_path / "dir").mkdir()
    want = {"a.js": None, "b.js": "binary-file", "c.txt": "unsupported-extension", "d.js": "file-too-large", "l.js": "symlink", "dir": "is-directory", " ": "empty-path", "../x.js": "outside-project-root", "no.js": "not-found"}
    assert {p: splitting.input_problem(str(tmp_path), p, 1) for p in want} == want
