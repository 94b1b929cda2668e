"""Nearest neighbours against brute force: recall on the given vectors, exact scores, awkward rows."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedjobs.llm import annsearch as ann


def brute(rows, asks, k):
    """{query: [(score, id)]} of the k nearest rows of each id for which asks holds."""
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    queries = {}
    for i, v in ok:
        if asks(i) and (i not in queries or v.tolist() < queries[i].tolist()):
            queries[i] = v
    return {q: sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in ok if i != q and len(x) == len(v))[:k] for q, v in queries.items()}


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return out


def recall(got, want):
    return sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items()) / sum(len({i for _, i in w}) for w in want.values())


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0, 10)
    got = found(ann.op13_nearest_neighbours(spark, f"/root/testdata/sf{sf}"))
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    assert recall(got, want) >= 0.93
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    assert all(math.isclose(s, np.sqrt(((vectors[q] - vectors[i]) ** 2).sum()), rel_tol=1e-12) for q, v in got.items() for s, i in v)


def test_awkward_rows(spark):
    r = np.random.default_rng(2)
    make = lambda d: [float(x) for x in r.standard_normal(d).astype(np.float32)]
    copy = make(40)
    rows = [(i, make(40)) for i in range(300)] + [(1_000 + i, copy) for i in range(200)]  # ties beyond k
    rows += [(2_000 + i, make(3)) for i in range(7)] + [(3_000, make(5))]  # fewer than k candidates, none at all
    rows += [(None, copy), (4_000, None), (4_001, []), (4_002, [0.0] * 40), (4_003, [float("nan"), *copy[1:]]), (4_004, [float("inf"), *copy[1:]]), (4_005, [None, *copy[1:]])]
    rows += [(20, make(40)), (20, make(40)), (21, copy), (21, copy), (-10, copy)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("list"), F.lit(2).alias("rank")).repartition(7)
    want = {q: v for q, v in brute(rows, lambda i: i % 10 == 0, 8).items() if v}
    for probes, piece in ((10_000, 512), (10_000, 30), (None, 64)):
        got = found(ann.nearest(df, F.col("vec_id") % 10 == 0, 8, probes=probes, piece=piece))
        assert got.keys() == want.keys() and recall(got, want) >= (0.99 if probes else 0.9)
        assert all(len(v) == len(want[q]) for q, v in got.items())
        for q in (1_000, 1_190, -10, 2_000):  # all candidates of a tie lie in one list: exact, smaller ids first
            assert [i for _, i in got[q]] == [i for _, i in want[q]]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert ann.nearest(df.where("vec_id % 10 <> 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_abandons_early_and_rarely_wrongly():
    """With a bound, far fewer columns are added up than there are, and nearly no candidate within the bound is lost."""
    r = np.random.default_rng(4)
    d, n, lost, kept, work = 128, 2000, 0, 0, 0
    rows = r.standard_normal((n, d))
    turned = rows.astype(np.float32) @ ann.rotation(d)
    blocks = [np.ascontiguousarray(turned[:, i : i + ann.COLUMNS].T) for i in range(0, d, ann.COLUMNS)]
    for _ in range(40):
        query = rows[r.integers(n)] + 0.5 * r.standard_normal(d)
        score = np.sqrt(((rows - query) ** 2).sum(axis=1))
        bound = np.sort(score)[9]
        ids, _, w = ann.scan_piece(np.arange(n), blocks, rows, -1, query, query.astype(np.float32) @ ann.rotation(d), bound, 10)
        lost, kept, work = lost + 10 - len(set(ids) & set(np.argsort(score)[:10])), kept + 10, work + w / (n * d)
    assert lost / kept <= 0.02 and work / 40 < 0.75


def test_limits():
    """The share of a squared length in the first columns of a random direction stays below the limit nearly always."""
    x = np.random.default_rng(1).standard_normal((200_000, 64)) ** 2
    share = np.cumsum(x, axis=1) / x.sum(axis=1, keepdims=True)
    for i, limit in enumerate(ann.limits(64)):
        assert 0.0005 < (share[:, (i + 1) * ann.COLUMNS - 1] > limit).mean() < 0.002
