import random
import subprocess

from pyspark.sql import functions as F

from loomspark.sources import changes, files, ignore
from loomspark.streaming import incremental


def test_discovery(spark, tmp_path):
    for name, body in {"a.js": b"x", "src/b.jsx": b"y" * 3000, "src/c.ts": b"z", "node_modules/d.js": b"w", "e.js": b"\x00"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    found = files.discovered(files.listing(spark, str(tmp_path)), include=["**/*.{js,jsx}"], exclude=["node_modules/"], max_kb=2)
    assert {r.rel_path: r.status for r in found.collect()} == {"a.js": "ok", "e.js": "ok", "src/b.jsx": "too-large", "node_modules/d.js": "ignored"}
    assert tuple(files.skip_counters(found, 1).first()) == (1, 1, 1)
    assert {(r.rel_path, r.source_text, r.binary) for r in files.contents(spark, str(tmp_path), found).collect()} == {("a.js", "x", False), ("e.js", None, True)}


def test_changes(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    (tmp_path / "f.txt").write_text("".join(f"line {i}\n" for i in range(1, 21)))
    (tmp_path / "g.txt").write_text("g\n")
    git("add", "."), git("commit", "-qm", "one")
    (tmp_path / "f.txt").write_text("".join(f"{'new' if i in (3, 4, 15) else 'line'} {i}\n" for i in range(1, 21)))
    (tmp_path / "g.txt").unlink()
    (tmp_path / "n.txt").write_text("a\nb\n")
    found = changes.changed_files(spark, str(tmp_path))
    assert dict(map(tuple, found.collect())) == {"f.txt": "modified", "g.txt": "deleted", "n.txt": "added"}
    texts = spark.createDataFrame([("f.txt", "x"), ("n.txt", "a\nb\n")], "rel_path string, source_text string")
    diffs = spark.createDataFrame([("f.txt", git("diff", "--unified=0", "f.txt"))], "rel_path string, diff string")
    got = changes.changed_ranges(diffs, found.join(texts, "rel_path", "left"))
    assert {tuple(r) for r in got.collect()} == {("f.txt", 3, 4), ("f.txt", 15, 15), ("n.txt", 1, 2)}


def test_files_whose_diff_fails_change_as_a_whole(spark, tmp_path, monkeypatch):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    for name in ("f.txt", "g.txt", "h.txt"):
        (tmp_path / name).write_text("a\nb\nc\n")
    git("add", "."), git("commit", "-qm", "one")
    for name in ("f.txt", "g.txt", "h.txt"):
        (tmp_path / name).write_text("a\nB\nc\nd\n")
    real = changes.git

    def failing(root, *args):
        if "--unified=0" in args and (args[-1] in ("f.txt", "h.txt") or "--" not in args):
            raise subprocess.CalledProcessError(128, "git")
        return real(root, *args)

    monkeypatch.setattr(changes, "git", failing)
    got = changes.diffs(spark, str(tmp_path))
    assert {r.rel_path: r.diff is None for r in got.collect()} == {"f.txt": True, "g.txt": False, "h.txt": True}
    files = spark.createDataFrame([("f.txt", "modified", "a\nB\nc\nd\n"), ("g.txt", "modified", "a\nB\nc\nd\n"), ("h.txt", "modified", None), ("n.txt", "added", None), ("z.txt", "modified", "x")], "rel_path string, status string, source_text string")
    assert {tuple(r) for r in changes.changed_ranges(got, files).collect()} == {("f.txt", 1, 4), ("g.txt", 2, 2), ("g.txt", 4, 4), ("n.txt", 1, 1)}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "AAAAAAAAAA AAAAAAAAAAAA"), ("b", "x\nx")], "rel_path string, source_text string")
    for turn in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        incremental.review_stream(s, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out/findings")).count() == 2


def test_rules_as_a_table_say_the_same(spark):
    rng = random.Random(3)
    names = ["src", "lib", "a.js", "b.min.js", "Build", "x", "node_modules", ".env", "é.JS"]
    paths = ["/".join(rng.choices(names, k=rng.randint(1, 4))) for _ in range(150)] + ["", ".", "../up", "./src/a.js", "lib\\x", "/x"]
    parts = [*names, "*", "*.js", "*.min.*", "**", "?", "[ab].js", "{src,lib}", "s*c", "*.{js,env}"]
    lines = ["", "# note", "\\#x", "  "]
    for _ in range(60):
        body = "/".join(rng.choices(parts, k=rng.choice([1, 1, 2, 3])))
        lines.append(rng.choice(["", "", "!"]) + rng.choice(["", "", "/", "**/"]) + body + rng.choice(["", "", "/"]))
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    want = {r.path for r in df.where(ignore.is_ignored(F.col("path"), lines)).collect()}
    got = [r.path for r in ignore.ignored_by(df, spark.createDataFrame(list(enumerate(lines)), "no long, line string")).collect()]
    assert set(got) == want and len(got) == len(want) and 20 < len(want) < len(set(paths))


def test_ten_thousand_rules(spark):
    lines = [f"/gen/{i}/*.js" if i % 2 else f"name{i}.txt" for i in range(10_000)] + ["!/gen/7/keep.js"]
    rows = [(f"gen/{i}/a.js", ".js", 1) for i in range(40)] + [("gen/7/keep.js", ".js", 1), ("deep/er/name8.txt", ".txt", 1), ("name9.txt", ".txt", 1)]
    found = files.discovered(spark.createDataFrame(rows, "rel_path string, ext string, size_bytes long"), include=[], exclude=lines, max_kb=9)
    assert {r.rel_path for r in found.where("status = 'ignored'").collect()} == {f"gen/{i}/a.js" for i in range(1, 40, 2)} | {"deep/er/name8.txt"} and found.columns == ["rel_path", "ext", "size_bytes", "status"]
