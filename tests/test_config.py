import json

import pytest

from loomspark.sources import config


def test_layers(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"maxFiles": 7, "complexity": {"maxParameters": 3}}))
    got = config.load(str(f), {"maxFiles": 9, "concurrency": None})
    assert (got["maxFiles"], got["complexity.maxParameters"], got["concurrency"]) == (9, 3, 2)
    assert config.load(str(tmp_path / "none.json"))["severityThreshold"] == "medium"


@pytest.mark.parametrize("bad", [{"maxFiles": 0}, {"odd": 1}, {"concurrency": True}, {"severityThreshold": "huge"}, []])
def test_refused(tmp_path, bad):
    f = tmp_path / "c.json"
    f.write_text(json.dumps(bad))
    with pytest.raises(config.ConfigurationError):
        config.load(str(f))


def test_exit_codes():
    code = lambda a, b, c: config.exit_code(failures=a, budget_stopped=b, threshold_hit=c)
    assert [code(0, False, False), code(0, False, True), code(1, False, True), code(0, True, False)] == [0, 1, 2, 2]
