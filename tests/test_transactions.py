import os

import pytest

from loomspark.frontend import javascript
from loomspark.sources import transactions as X


@pytest.fixture
def root(tmp_path):
    (tmp_path / "a.js").write_bytes(b"one()\r\ntwo()\r\n")
    return tmp_path


def check(rel_path, text):
    javascript.parse(text)


def test_apply_and_roll_back(root):
    name = X.apply(str(root), "a.js", "parts/b.js", "one()\n", "two()\n", expected_sha=X.sha((root / "a.js").read_bytes()), check=check)
    assert (root / "a.js").read_bytes() == b"one()\r\n" and (root / "parts/b.js").read_bytes() == b"two()\r\n"
    assert [(h["id"], h["status"]) for h in X.history(str(root))] == [(name, "completed")] and not (root / X.STATE / "lock").exists()
    assert [X.rollback(str(root), name) for _ in range(2)] == ["rolled-back"] * 2
    assert (root / "a.js").read_bytes() == b"one()\r\ntwo()\r\n" and not (root / "parts/b.js").exists()


@pytest.mark.parametrize("at", ["after_target", "after_source"])
def test_failures_leave_all_as_it_was(root, at):
    def fail():
        raise OSError("disk full")

    with pytest.raises(X.ApplyError, match="disk full"):
        X.apply(str(root), "a.js", "b.js", "x()", "y()", hooks={at: fail})
    assert (root / "a.js").read_bytes() == b"one()\r\ntwo()\r\n" and not (root / "b.js").exists() and not list(root.glob(".*.tmp"))
    assert X.history(str(root))[0]["status"] == "rolled-back-after-failure"


@pytest.mark.parametrize("args,kind", [(("a.js", "../b.js", "", ""), "unsafe-path"), (("a.js", "a.js", "", ""), "conflict"), (("none.js", "b.js", "", ""), "missing"), (("a.js", "b.js", "x(", ""), "invalid"), (("a.js", "link/b.js", "", ""), "unsafe-path"), (("a.js", "/b.js", "", ""), "unsafe-path")])
def test_refusals(root, args, kind):
    os.symlink("/tmp", root / "link")
    with pytest.raises(X.ApplyError) as e:
        X.apply(str(root), *args, check=check)
    assert e.value.kind == kind and (root / "a.js").read_bytes() == b"one()\r\ntwo()\r\n"
    with pytest.raises(X.ApplyError, match="since it was planned"):
        X.apply(str(root), "a.js", "b.js", "", "", expected_sha="0" * 64)


def test_conflicts_and_locks(root):
    name = X.apply(str(root), "a.js", "b.js", "x()", "y()")
    (root / "b.js").write_text("changed()")
    with pytest.raises(X.ApplyError, match="changed since"):
        X.rollback(str(root), name)
    (root / X.STATE / "lock").write_text(str(os.getpid()))
    with pytest.raises(X.ApplyError, match="under way"):
        X.rollback(str(root), name)
    os.utime(root / X.STATE / "lock", (1, 1))
    with pytest.raises(X.ApplyError, match="changed since"):
        X.rollback(str(root), name)
    (root / X.STATE / "operations" / name / "manifest.json").write_text("{")
    assert X.history(str(root))[0]["status"] == "corrupted"
    with pytest.raises(X.ApplyError):
        X.rollback(str(root), "../x")
