import hashlib
import random
import re
import zlib
from collections import defaultdict

from loomspark.llm import conversations as C
from loomspark.llm.queries import op11_conversations

SCHEMA = "conv_id long, turn long, role string, text string, g string, position int"
GRAMMAR = re.compile("(s?(ua)+)?")
LINES = ["Yes.", "Really?", "no end", "Go!  \n", "", " \t", "one. two", " ", None]


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edits by breadth: (cost, audit, repaired), with at most two inserted turns in a row."""
    found = faults(rows)
    def fold(letters):
        return letters if len(letters) < 2 else "." + letters[-1] if letters[0] != "s" else "s" + letters[-1]

    def legal(letters):
        return bool(re.fullmatch("s?(ua)*u?", letters))

    full = [(0, "", "", ())]
    for i, (_, _, role, text) in enumerate([*rows, (None, None, None, None)]):
        more = []
        for cost, audit, letters, turns in full:
            for k in range(3):
                if k:
                    r = "assistant" if letters.endswith("u") else "user"
                    cost, audit, letters, turns = cost + 3, audit + "I", letters + r[0], (*turns, f"{r}:")
                if i == len(rows):
                    if GRAMMAR.fullmatch(letters):
                        more.append((cost, audit, letters, turns))
                    continue
                more.append((cost + 4, audit + "D", letters, turns))
                if found[i] in ("blank", "duplicate"):
                    continue
                price = 3 if found[i] == "truncated" else 0
                if role and legal(letters + role[0]):
                    more.append((cost + price, audit + "K", letters + role[0], (*turns, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    if legal(letters + r[0]):
                        more.append((cost + price + 3, audit + "R", letters + r[0], (*turns, f"{r}:{text}")))
        # short conversations keep every way, longer ones the best forty that end alike
        best = defaultdict(list)
        for x in sorted(set(more), key=lambda x: (x[0], x[1])):
            kept = best[fold(x[2])]
            if len(kept) < 40 or len(rows) < 5:
                kept.append(x)
        full = [x for v in best.values() for x in v]
    return min(full, key=lambda x: (x[0], x[1]))


def expected(rows):
    by = defaultdict(list)
    for r in harmed(rows):
        by[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        own = in_order(by[conv])
        turns = [r[1] for r in own if r[1] is not None]
        found = faults(own)
        cost, audit, _, repaired = cheapest(own)
        bad = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], bad, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "sudo", ""])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, rng.choice(LINES) if rng.random() < 0.6 else f"line {turn}."))
    return rows


def report(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "own", 7) for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = op11_conversations(spark, str(tmp_path))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.columns == ["conv_id", *names]
    return {r.conv_id: tuple(r[n] for n in names) for r in got.collect()}


def test_against_brute_force(spark, tmp_path):
    rows = conversations(1, 80) + conversations(2, 80)[5:30]
    rows += rows[3:9]
    assert report(spark, rows, tmp_path) == expected(rows)


def test_segments_and_spans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 3)
    monkeypatch.setattr(C, "SPAN", 2)
    monkeypatch.setattr(C, "BATCH", 10)
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(LINES[:4]) + f" {t}" * (t % 3) + ".") for c in range(4) for t in range(3 + 9 * c)]
    assert report(spark, rows, tmp_path) == expected(rows)


def test_no_turns(spark, tmp_path):
    assert report(spark, [], tmp_path) == {}
    dropped = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert report(spark, [(dropped, 0, "user", "Hi.")], tmp_path) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_long_conversation_keeps_every_turn(spark):
    n = 1200
    turns = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(n)], "conv_id int, turn long, role string, text string")
    got = C.repair(turns).orderBy("seq").collect()
    assert [r.text for r in got] == [f"turn {t}." for t in range(n)] and got[0].conv_id == 1
    only_users = C.audits(C.faults(turns.replace("assistant", "user", "role"))).first()
    assert (only_users.cost, only_users.audit) == (3 * n // 2, "KR" * (n // 2))


def test_moves_are_least():
    rows = {(r["kind"], r["src"], r["dst"]): (r["cost"], r["letters"]) for r in C.moves().to_pylist()}
    state = C.STATES.index
    assert rows["uk", state("0"), state("u")] == (0, "K") and rows["uk", state("0"), state("a")] == (6, "IR")
    assert rows["uk", state("u"), state("u")] == (3, "IK") and rows["ut", state("u"), state("u")] == (4, "D")
    assert rows["sd", state("0"), state("0")] == (4, "D") and rows["sk", state("0"), state("s")] == (0, "K")
