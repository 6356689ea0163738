import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.llm import merkle
from loomspark.llm.queries import op13_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, position int, digest string, n int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """The last node and the siblings of each leaf, as (left, right) level by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k - k % 16 : k - k % 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        at = [k // 16 for k in at]
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def expected(rows):
    by = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if text is not None else None
        own = leaf(doc_id, source, lang, n, text)
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        by[source].append((doc_id, own, leaf(doc_id, source, lang, n, low) if bad else own))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in sources}
    root, tops = climb([trees[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, top in zip(sources, tops):
        for (doc_id, own, other), path in zip(sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), trees[s][1]):
            h = other
            for left, right in path + top:
                h = sha(left, h, right)
            out.append((doc_id, own, trees[s][0], root, sha(*[a + b for a, b in path + top]), h, h == root))
    return sorted(out, key=repr)


def corpus(sizes, seed=1):
    rng, rows = random.Random(seed), []
    for source, n in sizes.items():
        for i in range(n):
            rows.append((len(rows), rng.choice(["Ünï Text", "lower", "A", "", None, f"Row {i}"]), rng.choice(["en", None]), source, rng.choice([None, i])))
    return rows


def got(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "own", 1, "d", 2) for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    out = op13_merkle(spark, str(tmp_path))
    assert out.columns == names
    return sorted((tuple(r[n] for n in names) for r in out.collect()), key=repr)


@pytest.mark.parametrize("width", [4096, 256])
def test_against_brute_force(spark, tmp_path, monkeypatch, width):
    """Sources of one leaf, full and ragged runs, several levels and (with small blocks) several rounds; null and odd names."""
    if width == 256:
        monkeypatch.setattr(merkle, "LEVELS", 2)
        monkeypatch.setattr(merkle, "BLOCK", 256)
    rows = corpus({None: 3, "": 1, "big": 4400, "é": 17, "z": 16, "Z": 1, "s": 257} | {f"src{i}": 1 for i in range(20)})
    rows += [(None, "no id", "en", "big", 1), (None, None, None, None, None)] + rows[7:9] * 3
    assert got(spark, rows, tmp_path) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(7, "Only", "en", "s", 4)]])
def test_none_and_one(spark, tmp_path, rows):
    want = expected(rows)
    assert got(spark, rows, tmp_path) == want
    if rows:
        assert want[0][1] == want[0][2] == want[0][3] and want[0][4] == hashlib.sha256().hexdigest()


def test_a_proof_finds_any_change(spark):
    rows = corpus({"a": 40, "b": 3})
    docs = spark.createDataFrame([(*r, "own", 1, "d", 2) for r in rows], SCHEMA)
    made = merkle.manifest(docs, columns=["doc_id", "text"], other=F.when(F.col("doc_id") == 11, merkle.leaf([F.col("doc_id"), F.lit("changed")])))
    assert {r.key for r in merkle.proofs(made).where("folded_root <> root").collect()} == {11}
    changed = merkle.manifest(docs.withColumn("text", F.when(F.col("doc_id") == 11, "changed").otherwise(F.col("text"))), columns=["doc_id", "text"])
    before, after = ({r.g: r.subroot for r in m.subroots().collect()} for m in (made, changed))
    assert changed.root != made.root and before["sb"] == after["sb"] and before["sa"] != after["sa"]
