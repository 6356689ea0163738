import io
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loomspark.plans import model_review as M
from loomspark.sources import cache, changes, config, environment, files

CHUNK = "id string, rel_path string, kind string, symbol string, line_start int, line_end int, code string, imports array<string>, tokens long, reason string"
FINDING = "source string, rule_id string, severity string, category string, title string, message string, rel_path string, line_start int, column_start int, line_end int, column_end int, suggestion string, fixable boolean"


class Fake:
    """Answers by the symbol in the prompt."""

    def review_chunk(self, request):
        assert request["system"] == M.SYSTEM
        if "Symbol: bad" in request["user"]:
            raise ValueError("no answer")
        line = 11 if "Symbol: two" in request["user"] else 1
        good = {"ruleId": "null deref", "severity": "high", "message": " breaks ", "lineStart": line, "lineEnd": line, "confidence": 0.9}
        return {"findings": [good, dict(good), good | {"confidence": 0.3}, good | {"lineStart": 500, "lineEnd": 500}], "usage": {"input_tokens": 10, "output_tokens": 2}}


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("a:one:1-5", "a.js", "function-declaration", "one", 1, 5, "code 1", ["import x"], 100, None), ("a:two:10-15", "a.js", "function-declaration", "two", 10, 15, "code 2", [], 100, None),
        ("b:bad:1-9", "b.js", "module", "bad", 1, 9, "code 3", [], 100, None), ("b:big:20-900", "b.js", "module", "big", 20, 900, "...", [], 99999, "token-limit"),
    ]
    return spark.createDataFrame(rows, CHUNK)


@pytest.fixture(scope="module")
def static(spark):
    return spark.createDataFrame([("eslint", "no-undef", "high", "correctness", "t", "m <b>", "a.js", 2, 3, 2, 4, None, False)], FINDING)


def test_review(spark, chunks, static):
    got = M.review(chunks, static, Fake(), price_in=1.0, price_out=1.0)
    rows = got.findings.collect()
    assert [(r.rel_path, r.line_start, r.rule_id, r.source, r.message) for r in rows] == [("a.js", 1, "ai/null-deref", "ai", "breaks"), ("a.js", 11, "ai/null-deref", "ai", "breaks")]
    assert [tuple(r) for r in got.failures.collect()] == [("b.js", "ai", 1, 1, "no answer")]
    assert got.totals.first().asDict() == {"created": 4, "reviewed": 2, "skipped": 1, "failed": 1, "input_tokens": 20, "output_tokens": 4, "cost": 0.000024}


def test_prices_of_models(spark, chunks, static):
    for model, limit, reviewed in (("gpt-5.6-luna", 0.003, 1), ("gpt-5.6-luna", 0.0, 0), ("unpriced", 0.0, 2)):
        assert M.review(chunks, static, Fake(), model=model, max_cost=limit).totals.first().reviewed == reviewed


def test_changed_lines(spark, chunks, static):
    ranges = spark.createDataFrame([("a.js", 11, 11)], "rel_path string, start int, end int")
    got = M.review(chunks, static, Fake(), ranges)
    assert [r.line_start for r in got.findings.collect()] == [11]
    assert got.totals.first().skipped == 3


def test_prompts(spark, chunks, static):
    said = {r.symbol: r.user for r in M.prompts(chunks, static).collect()}
    assert "- [eslint/no-undef] line 2:3 - m <b>" in said["one"] and "- import x" in said["one"] and "<untrusted_code>\ncode 1\n</untrusted_code>" in said["one"]
    assert "Already found, not to be repeated:\nNone" in said["two"] and "Imports:\nNone" in said["two"] and "Changed lines" not in said["two"]


@pytest.mark.parametrize("requests, cost, want", [(10, 1.0, 4), (2, 1.0, 2), (10, 0.25, 2), (10, 0.0, 0)])
def test_budget(chunks, requests, cost, want):
    assert M.within_budget(chunks, max_requests=requests, max_cost=cost, cost=F.lit(0.1)).count() == want


def test_provider():
    calls = []

    def client(payload):
        calls.append(payload)
        if len(calls) == 1:
            raise M.ProviderError("busy", 429)
        return {"choices": [{"message": {"content": json.dumps({"findings": [{"a": 1}], "candidates": [{"id": "x"}]})}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}

    p = M.provider({"ai.provider": "groq", "ai.model": "m"}, {}, client)
    assert p.review_chunk({"system": "s", "user": "u"}) == {"findings": [{"a": 1}], "usage": {"input_tokens": 3, "output_tokens": 1}} and len(calls) == 2
    assert p.plan_split({"source": "x" * 9000, "candidates": []}) == {"candidates": [{"id": "x"}]} and len(calls[-1]["messages"][1]["content"]) < 4100
    refuse = M.ChatProvider("m", client=lambda _: {"choices": [{"message": {"refusal": "no"}}]})
    assert refuse.review_chunk({"system": "", "user": ""})["findings"] == []
    with pytest.raises(M.ProviderError, match="not JSON"):
        M.ChatProvider("m", client=lambda _: {"choices": [{"message": {"content": "{"}}]}).review_chunk({"system": "", "user": ""})

    def denied(_):
        calls.append(None)
        raise M.ProviderError("denied", 401)

    before = len(calls)
    with pytest.raises(M.ProviderError, match="denied"):
        M.ChatProvider("m", client=denied).review_chunk({"system": "", "user": ""})
    assert len(calls) == before + 1
    with pytest.raises(M.ProviderError):
        M.provider({"ai.provider": "openai", "ai.model": "m"}, {})


def test_cache(spark, static, tmp_path):
    c = cache.Cache(spark, str(tmp_path / "c"), max_entries=2)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    hits, misses = c.lookup(keys("k1", "k2"))
    assert (hits.count(), misses.count()) == (0, 2)
    assert c.put(keys("k1", "k2", None), static.withColumn("key", F.lit("k1")).withColumn("source_text", F.lit("secret")))
    hits, misses = c.lookup(keys("k1", "k2", "k3"))
    got = {r.key: r.findings for r in hits.collect()}
    assert [f.rule_id for f in got["k1"]] == ["no-undef"] and got["k2"] == [] and [r.key for r in misses.collect()] == ["k3"]
    assert "source_text" not in str(c.entries().schema)
    assert c.put(keys("k3"), static.withColumn("key", F.lit("none")))
    assert c.entries().count() == 2 and "k3" in {r.key for r in c.entries().collect()}
    assert c.statistics() == {"enabled": True, "hits": 2, "misses": 3, "writes": 3, "evictions": 1, "invalid": 0, "directory": str(tmp_path / "c")}
    assert c.clear() == 2 and c.clear() == 0
    off = cache.Cache(spark, str(tmp_path / "d"), enabled=False)
    assert not off.put(keys("k"), static.withColumn("key", F.lit("k"))) and off.lookup(keys("k"))[1].count() == 1


def test_keys(spark):
    row = spark.range(1).select(F.lit("text").alias("t"), F.lit("a.js").alias("p"), F.expr("array(named_struct('start', 5, 'end', 6), named_struct('start', 1, 'end', 2))").alias("s"))
    key = lambda scope, options, version="1": row.select(cache.review_key(F.col("t"), F.col("p"), scope, version, options)).first()[0]
    assert key(F.col("s"), {"a": 1, "b": 2}) == key(F.reverse("s"), {"b": 2, "a": 1})
    assert len({key(F.col("s"), {}), key(F.lit(None), {}), key(F.col("s"), {"a": 1}), key(F.col("s"), {}, "2")}) == 4
    assert cache.stable({"b": [{"d": 1, "c": 2}], "a": None}) == '{"a":null,"b":[{"c":2,"d":1}]}'


def test_environment(tmp_path):
    (tmp_path / ".env").write_text("# x\nOPENAI_API_KEY='abc'\nGROQ_API_KEY = \"gsk_1\"\nOTHER=1\nbroken\n")
    assert environment.environment_file(str(tmp_path), {"OPENAI_API_KEY": "set", "GROQ_API_KEY": "old"}) == {"OPENAI_API_KEY": "set", "GROQ_API_KEY": "gsk_1"}
    assert environment.environment_file(str(tmp_path), {}) == {"OPENAI_API_KEY": "abc", "GROQ_API_KEY": "gsk_1"}
    assert environment.environment_file(str(tmp_path / "no"), {}) == {}
    made = environment.init(str(tmp_path), "settings.json")
    assert config.load(made) == config.load(None) and "splitter" not in json.loads((tmp_path / "settings.json").read_text())
    with pytest.raises(FileExistsError):
        environment.init(str(tmp_path), "settings.json")
    environment.init(str(tmp_path), "settings.json", force=True)
    rows, ok = environment.probe(str(tmp_path), made, {})
    assert ok and {r["name"]: r["status"] for r in rows}["Key"] == "info"
    (tmp_path / "on.json").write_text('{"ai": {"enabled": true}}')
    assert not environment.probe(str(tmp_path), str(tmp_path / "on.json"), {})[1] and environment.probe(str(tmp_path), str(tmp_path / "on.json"), {"GROQ_API_KEY": "x"})[1]
    assert not environment.probe(str(tmp_path / "no"), None, {})[1]


@pytest.mark.parametrize("key, value", [("ai.maxRequests", 101), ("ai.provider", "x"), ("ai.enabled", 1), ("ai.maxEstimatedCostUsd", 0), ("cache.directory", "../x"), ("cache.directory", "/x"), ("splitter.targetDirectory", ""), ("splitter.maxCandidates", 51)])
def test_settings(key, value):
    with pytest.raises(config.ConfigurationError):
        config.checked({key: value})


def test_log():
    out = io.StringIO()
    log = environment.logger("warn", out)
    log.info("hidden")
    log.warning("key=%s", "abc123")
    environment.logger("silent", out).error("nothing")
    assert out.getvalue() == "[REDACTED_API_KEY]\n"


def test_links(spark, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "real" / "a.js").write_text("1")
    (tmp_path / "b.js").write_text("2")
    (tmp_path / "linked").symlink_to(tmp_path / "real")
    (tmp_path / "l.js").symlink_to(tmp_path / "b.js")
    assert environment.links_below(str(tmp_path)) == ["l.js", "linked"]
    names = spark.createDataFrame([(p,) for p in ("real/a.js", "b.js", "linked/a.js", "l.js", "linked.js")], "rel_path string")
    assert {r.rel_path for r in files.without_links(names, environment.links_below(str(tmp_path))).collect()} == {"real/a.js", "b.js", "linked.js"}
    assert [(r.rel_path, r.ext, r.size_bytes) for r in files.single(spark, str(tmp_path / "b.js")).collect()] == [("b.js", ".js", 1)]
    assert changes.git_root(str(tmp_path)) is None
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert changes.git_root(str(tmp_path / "real")) == str(tmp_path)
