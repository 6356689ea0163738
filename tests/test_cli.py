import json
import subprocess

from loomspark import cli
from loomspark.sources import config, transactions
from tests.test_splitting import SOURCE


def test_review(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.js").write_text("export const a = (x) => x == 1;\n")
    (tmp_path / "b.js").write_text("export const b = 1;\n")
    (tmp_path / "skip.js").write_text("x(")
    (tmp_path / ".gitignore").write_text("skip.js\n")
    assert cli.main(["review", str(tmp_path), "--json"], spark) == 1
    report = json.loads(capsys.readouterr().out)
    assert [(f["rel_path"], f["rule_id"], f["line_start"], f["column_start"]) for f in report["findings"]] == [("src/a.js", "eqeqeq", 1, 25)] and report["failures"] == []
    s = report["summary"]
    assert (s["discovered"], s["parsed"], s["findings"], s["by_severity"]["medium"], s["skipped"]["ignored"]) == (2, 2, 1, 1, 1)
    assert cli.main(["review", str(tmp_path), "--severity", "high"], spark) == 0
    assert "eqeqeq" in capsys.readouterr().out


def test_changed_lines(spark, tmp_path, capsys):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.js").write_text("one();\ntwo();\nthree();\n")
    (tmp_path / "b.js").write_text("four();\n")
    git("add", "."), git("commit", "-qm", "one")
    (tmp_path / "a.js").write_text("one();\nother();\nthree();\n")
    (tmp_path / "c.js").write_text("five();\n")
    assert cli.main(["review", str(tmp_path), "--changed", "--json"], spark) == 1
    assert [(f["rel_path"], f["line_start"]) for f in json.loads(capsys.readouterr().out)["findings"]] == [("a.js", 2), ("c.js", 1)]


def test_refusals(spark, tmp_path, capsys):
    (tmp_path / "bad.js").write_text("x(")
    (tmp_path / "nul.js").write_bytes(b"a\x00")
    assert cli.main(["review", str(tmp_path)], spark) == 2
    out = capsys.readouterr().out
    assert "bad.js (parse)" in out and "nul.js (read)" in out
    assert cli.main(["review", str(tmp_path / "none")], spark) == 2 and cli.main(["review", str(tmp_path), "--severity", "odd"], spark) == 2 and cli.main(["odd"], spark) == 2


def test_one_file(spark, tmp_path, capsys):
    (tmp_path / "a.js").write_text("export const a = (x) => x == 1;\n")
    (tmp_path / "b.js").write_text("export const b = (x) => x == 2;\n")
    (tmp_path / ".gitignore").write_text("*.js\n")
    (tmp_path / "link.js").symlink_to(tmp_path / "a.js")
    assert cli.main([str(tmp_path / "a.js"), "--json", "--no-cache"], spark) == 1
    report = json.loads(capsys.readouterr().out)
    assert [f["rel_path"] for f in report["findings"]] == ["a.js"] and report["summary"]["discovered"] == 1
    assert cli.main(["review", str(tmp_path / "link.js"), "--json", "--no-cache"], spark) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["discovered"] == 0


def test_cached(spark, tmp_path, capsys):
    (tmp_path / "a.js").write_text("export const a = (x) => x == 1;\n")
    (tmp_path / "b.js").write_text("export const b = 1;\n")
    reports = []
    for text in (None, None, "export const b = (x) => x == 2;\n"):
        if text:
            (tmp_path / "b.js").write_text(text)
        assert cli.main(["review", str(tmp_path), "--json"], spark) == 1
        reports.append(json.loads(capsys.readouterr().out))
    counts = [(r["summary"]["cache"]["hits"], r["summary"]["cache"]["misses"], r["summary"]["findings"]) for r in reports]
    assert counts == [(0, 2, 1), (2, 0, 1), (1, 1, 2)] and reports[0]["findings"] == reports[1]["findings"]
    assert cli.main(["cache", "clear", str(tmp_path), "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["deleted"] == 3


class Fake:
    def review_chunk(self, request):
        return {"findings": [{"ruleId": "leak", "severity": "high", "message": "leaks", "lineStart": 1, "lineEnd": 1, "confidence": 0.9}], "usage": {"input_tokens": 7, "output_tokens": 1}}


def test_model(spark, tmp_path):
    (tmp_path / "a.js").write_text("export const b = 1;\n")
    report = cli.run(spark, str(tmp_path), config.load(None), provider=Fake())
    assert [(f["rel_path"], f["rule_id"]) for f in report["findings"]] == [("a.js", "ai/leak")]
    assert report["summary"]["ai"]["reviewed"] == 1 and not report["summary"]["ai"]["stopped_by_budget"] and report["summary"]["by_source"]["ai"] == 1
    assert not (tmp_path / ".loom-cache").exists()


def test_model_stops_on_cost(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.js").write_text("export const b = 1;\n")
    (tmp_path / "b.js").write_text("export const c = 2;\n")
    monkeypatch.setattr(cli.model_review, "provider", lambda *a, **k: Fake())
    for limit, code, asked in (("0.0025", 2, 1), ("1", 1, 2)):
        assert cli.main(["review", str(tmp_path), "--ai", "--max-ai-cost", limit, "--json"], spark) == code
        said = json.loads(capsys.readouterr().out)["summary"]["ai"]
        assert (said["reviewed"], said["stopped_by_budget"]) == (asked, code == 2) and said["cost"] > 0


def test_small_commands(tmp_path, capsys, monkeypatch):
    assert cli.main(["init", str(tmp_path)]) == 0 and (tmp_path / cli.SETTINGS).is_file()
    assert cli.main(["init", str(tmp_path)]) == 0 and "already" in capsys.readouterr().out
    assert cli.main(["doctor", str(tmp_path), "--json"]) == 0 and json.loads(capsys.readouterr().out)["ok"]
    (tmp_path / cli.SETTINGS).write_text('{"maxFiles": 0}')
    assert cli.main(["doctor", str(tmp_path)]) == 2 and cli.main(["review", str(tmp_path)]) == 2
    (tmp_path / cli.SETTINGS).write_text('{"ai": {"enabled": true}}')
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    assert cli.main(["review", str(tmp_path)]) == 2


def test_split(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/Page.jsx").write_text(SOURCE)
    assert cli.main(["split", "src/Page.jsx", "--root", str(tmp_path), "--json"], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert {c["symbol"] for c in report["candidates"]} >= {"fetchOrders", "useOrders"} and report["summary"]["declarations"] == 6 and report["file"] == "src/Page.jsx"
    assert {c["target_file"] for c in report["candidates"] if c["symbol"] == "useOrders"} == {"src/Page/useOrders.js"}
    assert cli.main(["split", "none.js", "--root", str(tmp_path)], spark) == 2


def test_operations(tmp_path, capsys):
    (tmp_path / "a.js").write_text("one();\n")
    name = transactions.apply(str(tmp_path), "a.js", "b.js", "two();\n", "one();\n")
    at = ["--root", str(tmp_path), "--json"]
    assert cli.main(["split", "history", *at]) == 0 and [r["id"] for r in json.loads(capsys.readouterr().out)] == [name]
    assert cli.main(["split", "history", "none", *at]) == 2 and cli.main(["split", "rollback", "none", *at]) == 2 and cli.main(["split", "rollback", *at]) == 2
    (tmp_path / "b.js").write_text("changed();\n")
    assert cli.main(["split", "rollback", name, *at]) == 7
    (tmp_path / "b.js").write_text("one();\n")
    capsys.readouterr()
    assert cli.main(["split", "rollback", name, *at]) == 0 and json.loads(capsys.readouterr().out)["status"] == "rolled-back"
    assert (tmp_path / "a.js").read_text() == "one();\n" and not (tmp_path / "b.js").exists()
