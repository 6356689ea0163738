"""Decontamination against a plain greedy tiling of all pairs, on both join paths."""

import random
import re
import time

import numpy as np
import pytest

from loomspark.llm import decontamination

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def greedy(a, b, least):
    """Greedy tiles by trying every pair of positions."""
    least, out = min(least, len(b)), []
    free_a, free_b = [True] * len(a), [True] * len(b)
    while least:
        best, where = 0, (0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best:
                    best, where = n, (i, j)
        if best < least:
            break
        for k in range(best):
            free_a[where[0] + k] = free_b[where[1] + k] = False
        out.append((*where, best))
    return out


def hashes(x):
    return (np.array(x, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def test_tiles_are_the_greedy_ones():
    rng = random.Random(1)
    for _ in range(300):
        k, least = rng.choice([1, 2, 3, 5]), rng.randint(1, 5)
        a, b = ([rng.randrange(k) for _ in range(rng.randint(0, n))] for n in (25, 15))
        assert decontamination.tiles(hashes(a), hashes(b), least) == greedy(a, b, least)


def test_tiles_of_long_repetitive_texts():
    began = time.time()
    same = np.full(200_000, 7, np.uint64)
    assert decontamination.tiles(same, same[:1000], 5) == [(0, 0, 1000)]
    rng = random.Random(2)
    decontamination.tiles(hashes(rng.choices(range(2), k=100_000)), hashes(rng.choices(range(2), k=2000)), 5)
    assert time.time() - began < 20


def cases():
    """Documents that hold whole, shuffled and partial items, equal words, nulls and repeated rows."""
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(60)] + ["É", "AB"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 4, 6, 12, 30, 60])))) for i in range(25)]
    items += [(30, "same " * 40), (31, ""), (32, None), (None, items[5][1]), items[4], (33, "two Words"), (34, items[7][1]), (35, "Lone"), (36, "two\twords")]
    docs = []
    for i in range(90):
        words = rng.choices(vocab, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            part = (rng.choice(items)[1] or "").split()
            cut = rng.randint(0, len(part))
            part = rng.choice([part, part[cut:] + ["x"] + part[:cut], part[: max(1, cut)]])
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if rng.random() < 0.3 and w.isascii() else w for w in part]
        docs.append((i, " ".join(words), i))
    docs += [(200 + i, x, i) for i, x in enumerate(["two words", "TWO  words\n", "so two words", "a\ntwo words \nb", "a\ntwo\nwords\nb", "two\nwords", "lone", "x\n\n LONE\ny", "lone x", "x lone", "two words lone", "lone\ntwo words"])]
    docs += [(3, docs[9][1], 100), (None, items[0][1], 101), (None, None, 102), (None, "clean", 103), docs[11], (7, "", 104), (8, "same " * 500, 105)]
    return docs, items


@pytest.mark.parametrize("share", [0.5, 0.8])
@pytest.mark.parametrize("limit", [1 << 20, -1])
@pytest.mark.parametrize("heavy", [1000, 2])
def test_contamination_by_brute_force(spark, monkeypatch, limit, share, heavy):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(decontamination, "HEAVY", heavy)
    if limit > 0 and heavy == 2:
        return  # the broadcast path has no heavy seeds
    rows, items = cases()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: WORD.findall((t or "").translate(fold))
    want = {}
    for r in rows:
        cover = {}
        for k, (_, t) in enumerate(items):
            b = words(t)
            if len(b) > 2:
                cover[k] = sum(n for *_, n in greedy(words(r[1]), b, 5)) / len(b)
            elif b and b in [words(r[1]), *map(words, (r[1] or "").split("\n"))]:
                cover[k] = 1.0
        found = {k: c for k, c in cover.items() if c >= share}
        want[r] = (sorted({items[k][0] for k in found if items[k][0] is not None}), max(found.values(), default=0.0), bool(found))
    assert sum(x[2] for x in want.values()) > 30 and sum(not x[2] for x in want.values()) > 20
    d, b = spark.createDataFrame(rows, "doc_id long, text string, row_key long"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r["items"], round(r.coverage, 9), r.contaminated) for r in decontamination.contamination(d, b, share=share).collect()), key=repr)
    assert got == sorted(((r[0], want[r][0], round(want[r][1], 9), want[r][2]) for r in rows), key=repr)
    kept = decontamination.drop_contaminated(d, b, share=share)
    assert kept.columns == d.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted((r for r in rows if not want[r][2]), key=repr)


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_empty_tables(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
    rows, items = cases()
    d, b = spark.createDataFrame(rows, "doc_id long, text string, row_key long"), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.contamination(d.limit(0), b).count() == 0 and decontamination.drop_contaminated(d.limit(0), b).count() == 0
    assert decontamination.contamination(d, b.limit(0)).where("contaminated or n_items > 0 or coverage > 0").count() == 0
    assert decontamination.drop_contaminated(d, b.limit(0)).count() == len(rows)
