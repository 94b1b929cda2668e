"""Evidence of the personal-data operator: counts, PMI and both thresholds against plain Python, secrets, near copies."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from feedjobs.llm import pii

MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
WORD = re.compile(r"\w+")


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(r, n, most=10**6):
    return " ".join(f"u{r.randint(0, most)}" for _ in range(n))


def added(df):
    return {r["doc_id"]: [(s["kind"], s["value"]) for s in r["added"]] for r in pii.find_spans(df).collect()}


@pytest.fixture(scope="module")
def staff():
    """People with an address each at a firm whose name stands beside it, in texts that else share nothing; some are there twice."""
    r = random.Random(4)
    rows, i = [], 0
    for firm, domain in (("Acorn", "acorn.org"), ("Birch", "birch.net")):
        for person in ("Whitmore", "Quill", "Yarrow"):
            for _ in range(4):
                rows.append((i, f"{words(r, 12)} {firm} and {person}, {words(r, 9, 40)}: {person.lower()}@{domain} {words(r, 7)}"))
                i += 1
    rows += [(100 + j, rows[j][1]) for j in range(5)] + [(200 + j, f"and {words(r, 25, 40)} Quill") for j in range(8)]
    return rows + [(300 + j, words(r, 20, 300)) for j in range(250)]


def expected(rows, support=pii.SUPPORT):
    """Ratios by entity and term, from all counts in plain Python; every different text is a class of its own."""
    n_t, n_e, n_et, c_e, c_et = (defaultdict(int) for _ in range(5))
    seen = set()
    for _, t in rows:
        for w in set(WORD.findall(t)):
            n_t[w] += 1
        mails = MAIL.findall(t)
        entities = {f"email:{m}" for m in mails} | {f"domain:{m.split('@')[1]}" for m in mails} | {f"name:{m.split('@')[0]}" for m in mails}
        terms = set(WORD.findall(MAIL.sub(" ", t)))
        for e in entities:
            n_e[e] += 1
            c_e[e] += t not in seen
            for w in terms:
                n_et[e, w] += 1
                c_et[e, w] += t not in seen
        seen.add(t)
    out = {}
    for (e, w), n in n_et.items():
        pmi, ic = math.log(len(rows) * n / (n_e[e] * n_t[w])), math.log(len(rows) / n_e[e])
        if c_e[e] >= support and c_et[e, w] >= support and pmi / ic >= pii.GENERALISE and c_et[e, w] * pmi >= pii.SURE * math.log(len(rows)):
            out[e, w] = pmi / ic
    return out


def test_spans_follow_from_plain_counts(spark, staff):
    want, got = expected(staff), added(make(spark, staff))
    assert {w for _, w in want} >= {"Acorn", "Birch", "Whitmore", "Yarrow"}
    assert {pii.REMOVE <= x for x in want.values()} == {True, False}
    for i, t in staff:
        mails = MAIL.findall(t)
        entities = {f"email:{m}" for m in mails} | {f"domain:{m.split('@')[1]}" for m in mails} | {f"name:{m.split('@')[0]}" for m in mails}
        hits = []
        for m in WORD.finditer(MAIL.sub(lambda x: " " * len(x.group()), t)):
            ratio = max((want.get((e, m.group()), 0) for e in entities), default=0)
            if ratio:
                hits.append(("remove" if ratio >= pii.REMOVE else "generalise", m.group()))
        assert got[i] == hits


def test_near_copies_are_no_evidence(spark):
    r = random.Random(8)
    base = words(r, 150).split()
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(3):
            w[r.randrange(60, 150)] = f"x{r.randint(0, 10**6)}"
        near.append((i, " ".join(w[:50]) + " Solitary copied@mail.org " + " ".join(w[50:])))
    near.append((90, near[0][1]))
    other = [(200 + i, words(r, 30)) for i in range(300)]
    df = make(spark, near + other)
    assert not any(added(df).values())
    texts = df.where("doc_id < 100").select(F.md5(F.encode("text", "UTF-8")).alias("_hash"), "text").dropDuplicates(["_hash"])
    assert pii.text_classes(texts).select("class").distinct().count() == 1


def test_secrets_are_told_by_what_names_them(spark):
    r = random.Random(9)
    secret = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    held = [(i, f'{words(r, 20)} token = "{secret()}" {words(r, 20)}') for i in range(12)]
    once = [(50 + i, f"{words(r, 20)} {name}: {secret()} {words(r, 20)}") for i, name in enumerate(["alpha", "beta", "gamma"])]
    common = [(100 + i, f"build {words(r, 30)}") for i in range(200)]  # a name that mostly stands elsewhere tells nothing
    build = [(400 + i, f"{words(r, 20)} build={secret()}") for i in range(4)]
    letters = [(500 + i, f'{words(r, 20)} title = "{"abcdefghij" * 3}"') for i in range(5)]
    rows = held + once + common + build + letters
    got = added(make(spark, rows))
    for i, t in held:
        assert got[i] == [("secret", re.search('"(.*)"', t).group(1))]
    assert not any(got[i] for i, _ in once + common + build + letters)
    clean = pii.sanitise(make(spark, rows)).where("doc_id = 0").first()["text"]
    assert 'token = "[secret]"' in clean


def test_columns_of_any_name_pass_through(spark):
    df = make(spark, [(1, "mail a@b.org now"), (2, None), (None, ""), (1, "mail a@b.org now"), (3, "x " * 30_000 + "c@d.org")])
    clash = df.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(("_id", "_hash", "_spans", "_clean", "base", "added", "row", "a.b"))])
    got = pii.sanitise(clash)
    assert got.columns == clash.columns
    out = sorted(((r["doc_id"] or 0, r["text"]) for r in got.collect()), key=str)
    assert out == sorted([(1, "mail [email] now")] * 2 + [(2, None), (0, ""), (3, "x " * 30_000 + "[email]")], key=str)
