import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import findings as O
from loomspark.operators import graph as G
from loomspark.operators import intervals as I
from loomspark.operators import ranking as R
from loomspark.sources import ignore


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize("name,out", [("UserCard", "user-card"), ("PRODUCT_STATUS_LABELS", "product-status-labels"), ("formatDate", "format-date"), ("", "candidate"), ("$$", "$$"), ("$store", "$store"), ("ABC1", "ab-c1"), ("useHTTPClient", "use-http-client"), ("_a.b c_", "a-b-c"), ("__", "")])
def test_kebab(spark, name, out):
    assert one(spark, T.kebab(F.lit(name))) == out


def test_hunks(spark):
    diff = "@@ -5 +5 @@\n@@ -15,2 +15,3 @@ f\n@@ -20,2 +22,0 @@\n"
    assert [(h.start, h.end) for h in one(spark, T.hunks(F.lit(diff)))] == [(5, 5), (15, 17)]


def test_scalars(spark):
    assert one(spark, T.squash(F.lit(" a\n\t b "))) == "a b"
    assert one(spark, T.token_estimate(F.lit("abcd"))) == 2
    assert one(spark, T.line_count(F.lit("a\nb\n"))) == 2 and one(spark, T.line_count(F.lit(""))) == 1
    assert one(spark, T.prop_name(F.lit("handleClick"))) == "onClick" and one(spark, T.normal_path(F.lit(".\\a\\b"))) == "a/b"
    assert one(spark, T.redact(F.lit("api_key=abc key=abc123 Bearer  x.y"))) == "api_[REDACTED_API_KEY] [REDACTED_API_KEY] [REDACTED_API_KEY]"
    for said, slug in (("Bad Rule", "ai/bad-rule"), ("ai-null-deref", "ai/null-deref"), ("ai/x_y", "ai/x-y"), ("", "ai/issue"), ("--", "ai/issue"), ("AIx", "ai/x")):
        assert one(spark, T.slug_rule(F.lit(said))) == slug
    kinds = {(429, None, "x"): "rate-limit", (None, None, "too many requests"): "rate-limit", (None, None, "socket hang up"): "network", (403, None, ""): "authentication", (None, None, "api key"): "provider-error", (408, None, "x"): "provider-error", (500, "ZodError", "timed out"): "timeout", (None, "ZodError", None): "invalid-response"}
    for (status, name, said), kind in kinds.items():
        assert one(spark, T.error_kind(F.lit(status).cast("int"), F.lit(name).cast("string"), F.lit(said).cast("string"))) == kind
    with pytest.raises(Exception, match="unknown severity"):
        one(spark, T.severity_weight(F.lit("odd")))


def test_intervals_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, a, a + rng.randint(0, 4)) for k in range(20) for a in [rng.randint(1, 60) for _ in range(rng.randint(1, 15))]]
    got = {(r.k, r.start, r.end) for r in I.merged(spark.createDataFrame(rows, "k int, start int, end int"), ["k"]).collect()}
    want = set()
    for k in range(20):
        on = {x for q, a, b in rows if q == k for x in range(a, b + 1)}
        for x in on:
            if x - 1 not in on:
                y = x
                while y + 1 in on:
                    y += 1
                want.add((k, x, y))
    assert got == want


def test_scope(spark):
    f = spark.createDataFrame([("a", 5, 6), ("a", 1, 4), ("a", 9, None), ("b", 1, 1), (None, 1, 1), ("a", None, None)], "rel_path string, line_start int, line_end int")
    r = spark.createDataFrame([("a", 6, 9)], "rel_path string, start int, end int")
    assert {tuple(x) for x in I.in_scope(f, r).collect()} == {("a", 5, 6), ("a", 9, None), (None, 1, 1), ("a", None, None)}
    assert I.in_scope(f, None).count() == 6


def test_findings(spark):
    f = spark.createDataFrame([("eslint", "r", "a", 1, 1, "m  x", "high", 0), ("eslint", "r", "a", 1, 1, "m x", "low", 1), ("eslint", "r", "a", 2, 1, "m x", "low", 2)], "source string, rule_id string, rel_path string, line_start int, column_start int, message string, severity string, ord int")
    assert sorted(r.ord for r in O.first_of_each(f, "ord").collect()) == [0, 2]
    twice = O.first_of_each(f.unionByName(f), "ord")
    assert sorted(r.ord for r in twice.collect()) == [0, 2] and set(twice.columns) == {*f.columns, "fingerprint"}
    with pytest.raises(Exception, match="unknown severity"):
        O.dense_counts(f.withColumn("severity", F.lit("odd")), "severity", list(T.SEVERITIES), strict=True).collect()
    assert {r.severity: r.n for r in O.dense_counts(f, "severity", list(T.SEVERITIES)).collect()} == {"low": 2, "medium": 0, "high": 1, "critical": 0}
    assert O.at_least(f, "medium").count() == 1 and O.any_at_least(f, "critical").first().hit is False
    assert [r.line_start for r in O.ordered(f).collect()] == [1, 1, 2] and O.ordered(f).first().severity == "high"


def test_budget(spark):
    rows = spark.createDataFrame([(1, i, t, c) for i, (t, c) in enumerate([(10, 1.0), (999, 1.0), (10, 1.0), (10, 1.0), (10, 0.0)])], "g int, o int, t int, c double")
    gate = lambda **k: [r.decision for r in R.budget_gate(rows, "g", "o", max_tokens=100, tokens="t", cost="c", **k).orderBy("o").collect()]
    assert gate(max_requests=2, max_cost=9.0) == ["accepted", "chunk-exceeds-max-tokens", "accepted", "max-requests-reached", "max-requests-reached"]
    assert gate(max_requests=9, max_cost=1.5) == ["accepted", "chunk-exceeds-max-tokens", "max-cost-exceeded", "max-cost-exceeded", "max-cost-exceeded"]
    assert gate(max_requests=1, max_cost=9.0) == ["accepted"] + ["max-requests-reached"] * 4  # checked before the second, oversized one
    long = spark.range(1500).select(F.lit(1).alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 2 == 0, 200).otherwise(1).alias("t"), F.lit(None).cast("double").alias("c"))
    said = R.budget_gate(long, "g", "o", max_requests=700, max_cost=1.0, max_tokens=100, tokens="t", cost="c").orderBy("o").collect()
    assert [r.decision for r in said] == [("max-requests-reached" if i >= 1400 else "chunk-exceeds-max-tokens" if i % 2 == 0 else "accepted") for i in range(1500)]


def test_model_rows(spark):
    raw = spark.createDataFrame([(1, "ai-x", None, " T ", " m ", 3, None, float("nan")), (2, None, "odd", None, None, None, None, 7.0), (3, "r", "critical", None, "x" * 80, 5, 4, 0.1)], "id int, rule_id string, severity string, title string, message string, line int, line_end int, confidence double")
    got = {r.id: r for r in O.sanitised(raw).collect()}
    assert (got[1].rule_id, got[1].title, got[1].message, got[1].line_start, got[1].line_end, got[1].confidence) == ("ai/x", "T", "m", 3, 3, 0.85)
    assert (got[2].rule_id, got[2].severity, got[2].title, got[2].message, got[2].line_start, got[2].confidence, got[2].suggestion) == ("ai/code-issue", "medium", "Code Issue", "Potential issue identified in code.", 1, 1.0, "Review and update the code.")
    assert got[3].severity == "medium" and got[3].title == "x" * 60
    placed = O.sanitised(raw).withColumns({"rel_path": F.lit("a.js"), "chunk_line_start": F.lit(2), "chunk_line_end": F.lit(9)})
    made = O.normalised(placed).collect()
    assert [(r.id, r.source, r.column_start, r.fixable) for r in made] == [(1, "ai", 1, False)]


def test_ranking(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "name string, k int")
    assert {(r.k, r.unique_id) for r in R.suffixed(df, "name", "k").collect()} == {(1, "a"), (2, "a-2"), (3, "b")}
    assert {tuple(r) for r in R.first_per(df, ["name"], "k").collect()} == {("a", 1), ("b", 3)}
    assert [r.k for r in R.evicted(df, 2, "k", "k").collect()] == [1]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert {tuple(r) for r in G.closure(e).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)}
    assert {r.node for r in G.on_cycles(e).collect()} == {1, 2, 3}
    assert G.on_cycles(spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "src long, dst long")).count() == 0
    tail = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(3, 1), (9, 9), (20, 0), (5, 30)], "src long, dst long")
    assert {r.node for r in G.on_cycles(tail).collect()} == {1, 2, 3, 9}
    d = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (10, 12)], "src long, dst long")  # 11 is shared, 12 is exclusive
    assert {r.node for r in G.exclusive(d, spark.createDataFrame([(1,)], "node long")).collect()} == {1, 10, 12}


def test_ignore(spark):
    paths = ["node_modules/x.js", "a/node_modules/y.js", "src/a.log", "src/keep.log", "build", "lib/build/x", "../up", ""]
    rules = ["# c", "", "node_modules/", "*.log", "!keep.log", "/build"]
    got = dict(spark.createDataFrame([(p,) for p in paths], "p string").select("p", ignore.is_ignored(F.col("p"), rules)).collect())
    assert [p for p in paths if got[p]] == ["node_modules/x.js", "a/node_modules/y.js", "src/a.log", "build", "../up"]
    cases = [("build/keep.js", ["build/", "!build/keep.js"], True), ("build/keep.js", ["build/*", "!build/keep.js"], False), ("./build/x.js", ["/build"], True), ("/src/a.js", ["lib"], False), ("build", ["build/"], False), ("A/NODE_MODULES/x", ["node_modules/"], True), ("node_modules/a/b.js", ["node_modules/**"], True), ("node_modules", ["node_modules/**"], False), ("a/x/b", ["a/**/b"], True), ("a/b", ["a/**/b"], True), ("src\\gen\\x.js", ["src/gen/"], True), (".", ["*"], False), ("a/../b", ["c"], False)]
    for path, lines, want in cases:
        assert one(spark, ignore.is_ignored(F.lit(path), lines)) == want, (path, lines)
    assert one(spark, ignore.is_included(F.lit("a/b/c.jsx"), ["**/*.{js,jsx}"])) and not one(spark, ignore.is_included(F.lit("c.ts"), ["**/*.{js,jsx}"]))
