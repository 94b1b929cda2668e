"""Repair of conversations against a search over all edits with their audits, row by row."""

import hashlib
import random
import zlib
from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedjobs.llm import convrepair as cr

SPACE = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def hash_of(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows, insert=5):
    """Report of rows (turn, role, text) by a search for the least (cost, audit) over (rows used up, state)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hash_of(*r[1:])))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, q, out = heappop(heap)
        if i == len(rows) and q in (0, 3):
            break
        if (i, q) in done:
            continue
        done.add((i, q))
        for x, role in (("u", "user"), ("a", "assistant")):
            if (q, x) in NEXT:
                heappush(heap, (cost + insert, audit + "I", i, NEXT[q, x], (*out, role + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heappush(heap, (cost + 2, audit + "D", i + 1, q, out))
            if faults[i] in ("", "truncated"):
                late = 5 * (faults[i] == "truncated")
                if (q, role[:1]) in NEXT:
                    heappush(heap, (cost + late, audit + "K", i + 1, NEXT[q, role[:1]], (*out, f"{role}:{text}")))
                for x, new in (("u", "user"), ("a", "assistant")):
                    if (q, x) in NEXT:
                        heappush(heap, (cost + late + 1, audit + "R", i + 1, NEXT[q, x], (*out, f"{new}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if x == 1:
            text = ""
        if x == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        out += [(conv, turn, "user" if x == 4 else role, text)] * (0 if x == 0 else 2 if x == 3 else 1)
    return out


def wanted(rows, all_ids=()):
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(tuple(row))
    return {c: brute(by.get(c, [])) for c in {*by, *all_ids}}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "umpire"], ["Yes.", "No!", "and so", "", " \t", None, "Why? ", "x.\n", "ünd", "A?"]
    out = []
    for conv in range(150):
        for turn in range(r.randint(1, 9)):
            out += [(conv, turn * r.choice((1, 1, 1, 2)), r.choices(roles, (6, 6, 2, 1, 1, 1, 1))[0], f"{r.choice(texts) or ''}" if r.random() < 0.5 else f"w{r.random()}.")] * r.choice((1, 1, 1, 2))
    out += [(1000, t, "user" if t % 2 else "assistant", f"turn {t}{r.choice(('.', ' and'))}") for t in range(700)]
    out += [(1001, 4, "user", "always the same.")] * 90 + [(1001, 5, "assistant", "same.")]
    out += [(1002, None, "user", "null turn."), (1002, None, "assistant", "null turn."), (1002, 3, "user", "end")]
    out += [(None, i, "user", f"no id {i}.") for i in range(5)] + [(-4, -2, "system", "S."), (-4, 7, "user", "U.")]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("hash"), F.lit(2).alias("copies"), F.lit("x").alias("edits"))


@pytest.mark.parametrize("most", [4096, 7])
def test_report(spark, rows, most):  # with 7, conversations of many segments
    plain = [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows]
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.report(frame(spark, rows).repartition(5), most=most).collect()}
    want = wanted(plain)
    assert got.keys() == want.keys()
    assert {c: (got[c], want[c][:-1]) for c in got if got[c] != want[c][:-1]} == {}


def test_least_paths_with_cheap_inserts(monkeypatch, rows):
    """With the costs as given an insert never pays; here it costs 1, so audits hold all four letters."""
    monkeypatch.setattr(cr, "INSERT", 1)
    end, r, letters = np.array([[0, 2, 1, 0]]), random.Random(9), set()
    for _ in range(300):
        turns = [(i, r.choice(("user", "assistant", "system", "tool")), f"w{r.random()}{r.choice(('', '.'))}") for i in range(r.randint(1, 12))]
        codes = np.array([["suat".index(role[0]) + 4 * (text[-1] != ".") for _, role, text in turns]])
        _, letter, _ = cr._least_paths(codes, end, True, (0,))
        audit = "".join("DIKR"[x] for x in letter[0] if x < 4)
        assert audit == brute(turns, insert=1)[6]
        letters |= set(audit)
    assert letters == set("DIKR")


def test_damage(spark, rows):
    got = sorted(map(repr, (tuple(r) for r in cr.damaged(frame(spark, rows)).collect())))
    assert got == sorted(map(repr, damage(rows))) and len(got) != len(rows)


def test_repaired_rows(spark, rows):
    plain = [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows]
    by = defaultdict(list)
    for r in sorted(cr.repair(frame(spark, rows)).collect(), key=lambda r: (r["part"], r["place"])):
        by[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    want = {c: list(v[-1]) for c, v in wanted(plain).items() if v[-1]}
    assert by == want


def test_query(spark, tmp_path, rows):
    gone = next(c for c in range(5000, 9000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    given = [*rows, (gone, 1, "user", "dropped.")]
    spark.createDataFrame(given, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: v[:-1] for c, v in wanted(damage(given), {r[0] for r in given}).items()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_rows(spark):
    assert cr.report(frame(spark, []).limit(0)).count() == 0 and cr.repair(frame(spark, []).limit(0)).count() == 0
