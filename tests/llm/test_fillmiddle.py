"""Fill-in-the-middle against a version that splits texts with a regular expression, and the set of line ends."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedjobs.llm import fillmiddle as fim

SF = "/root/testdata/sf0.001"


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(
    "values",
    [
        np.arange(0),
        np.array([0]),
        np.array([3, 70_000, 70_001, 1 << 33]),
        np.arange(5, 200_000),  # runs
        np.arange(0, 200_000, 3),  # bitmaps
        np.sort(np.random.default_rng(3).choice(400_000, 100_000, replace=False)),
        np.sort(np.random.default_rng(4).choice(10**7, 3_000, replace=False)),  # arrays
    ],
)
def test_boundary_set(values):
    s = fim.BoundarySet(values)
    assert len(s) == len(values) and all(s.select(j) == v for j, v in enumerate(values.tolist()))


def test_kinds_of_containers():
    kinds = lambda values: {type(c).__name__ for c in fim.BoundarySet(np.array(values)).containers}
    assert kinds(range(60_000)) == {"_Runs"} and kinds(range(0, 60_000, 2)) == {"_Bitmap"} and kinds(range(0, 60_000, 500)) == {"_Array"}


def test_awkward_rows(spark):
    texts = [None, "", "\n", "\n\n\n", "one line", "one line\n", "a\nb", "é\r\n x\n漢字😀\nend", "holds <S> itself\nand more", "<\n<P\nS>\n>", "x" * 200_000 + "\n" + "y\n" * 90_000, "\n" * 70_000, "tail <\n<\n<"]
    rows = [(i * 7 + j, t) for i in range(6) for j, t in enumerate(texts)] + [(None, "no\nid\nhere"), (5, "shared\nid"), (5, "shared\nid"), (-3, "negative\nid")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("form"), F.lit("q").alias("output"), F.lit(2).alias("cut"), F.lit(3).alias("a.b"))
    for rate, spm in ((100, 50), (40, 0), (70, 100)):
        out = fim.fill_in_middle(df, rate=rate, spm=spm).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
        got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out)
        assert got == Counter(brute(i, t, rate, spm) for i, t in rows)
        assert all(r["back"] == (r["text"] or "") and r["cut"] == 2 and r["a.b"] == 3 for r in out)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_query_restores_every_text(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = fim.op11_fill_in_middle(spark, SF).collect()
    assert len(got) == len(docs) and {r["form"] for r in got} >= {"psm", "spm"}
    for r in got:
        assert tuple(r)[:5] == brute(r["doc_id"], docs[r["doc_id"]])[:5]
        assert r["output_sha256"] == sha(brute(r["doc_id"], docs[r["doc_id"]])[5]) and r["restored_sha256"] == sha(docs[r["doc_id"]] or "")
