"""Exact top-k inner products by distributed histogram selection.

Vectors become integers floor(64 x), so every score is an exact integer. Queries are taken in blocks of a
bounded number of rows that are broadcast; all vectors pass by each block where they are stored. Per query
the k-th best score is located by histograms: all scores are counted in 256 bins over the possible range,
the bins are added up over all tasks, and the bin that holds the k-th is split into 256 again until it is one
score wide. A last pass returns the scores above it and, of those equal to it, the smallest vec_ids.

A task reports only bins that can still hold the k-th score (its own k best lie in them), and of the scores
that tie with the k-th only as many as are needed, so what is shuffled is bounded by k rows for each task and
query however many vectors are equal.

Defined results: vectors null, without an id or with a null or non-finite component take no part, neither as
query nor as candidate; only vectors of the query's length are candidates; rows that share the query's
vec_id are the query's own, and the smallest of their vectors asks; repeated rows are candidates of their own; with fewer than k candidates all are
returned. Scores beyond 2^62 are cut there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise

SCALE, BINS = 64, 256
BLOCK = 4096
#: Vectors that meet a block of queries at once: bounds the matrix of scores in a worker.
ROWS = 1000


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))


def _by_length(ids: np.ndarray, rows: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) for each length of the lists in rows."""
    n = np.asarray(rows.value_lengths())
    flat, start = rows.flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)])
    for d in np.unique(n):
        at = np.flatnonzero(n == d)
        yield int(d), at, flat[(start[at][:, None] + np.arange(d)).astype(np.int64)].reshape(len(at), d)


class Block:
    """One block of queries: ids, a matrix for each vector length, and the state of the selection."""

    def __init__(self, ids: np.ndarray, rows: pa.ListArray, bound: int, k: int):
        self.ids, self.k, self.bound = ids, k, bound
        self.kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
        self.groups = {d: (at, m.astype(self.kind)) for d, at, m in _by_length(ids, rows)}
        self.shift = max(0, (2 * bound).bit_length() - 8)  # 256 bins of 2^shift scores
        self.low = np.full(len(ids), -bound, dtype=np.int64)
        self.need = np.full(len(ids), k, dtype=np.int64)  # rank of the k-th within the interval from low
        self.width = 2 * bound + 1

    def scores(self, b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query places, vec_ids, scores [vector, query], mask of the pairs that count)"""
        ids = b["vec_id"].to_numpy()
        rows = b["q"]
        for d, at, m in _by_length(ids, rows):
            if d in self.groups:
                place, q = self.groups[d]
                s = m.astype(self.kind) @ q.T
                s = np.clip(s, -(1 << 62), 1 << 62).astype(np.int64) if self.kind is object else s.astype(np.int64)
                yield place, ids[at], s, ids[at][:, None] != self.ids[place][None, :]


def _histogram(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        counts = np.zeros((len(x.ids), BINS), dtype=np.int64)
        for b in _chunks(batches):
            for place, _, s, on in x.scores(b):
                off = s - x.low[place][None, :]
                on &= (off >= 0) & (off < x.width)
                bin_ = off >> x.shift
                flat = (np.broadcast_to(place[None, :], s.shape)[on] * BINS + bin_[on]).astype(np.int64)
                counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        best = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # scores of this task in the bin and above
        q, bin_ = np.nonzero((counts > 0) & (best - counts < x.need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(counts[q, bin_])], ["q", "bin", "n"])

    return run


def _best(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The k best of each query among kept, in order."""
            q, v, s = (np.concatenate([k[i] for k in kept] or [np.zeros(0, np.int64)]) for i in range(3))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            return q[rank < x.k], v[rank < x.k], s[rank < x.k]

        for b in _chunks(batches):
            for place, ids, s, on in x.scores(b):
                i, j = np.nonzero(on & (s >= x.low[place][None, :]))
                kept.append((place[j].astype(np.int64), ids[i], s[i, j]))
            if sum(len(k[0]) for k in kept) > 500_000:
                kept = [cut()]
        q, v, s = cut()
        yield pa.RecordBatch.from_arrays([pa.array(x.ids[q]), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def _select(vectors: DataFrame, block: Block) -> DataFrame:
    """The k best of each query of the block. Between rounds the driver gets one row for each query."""
    sc = vectors.sparkSession.sparkContext
    while True:
        shared = sc.broadcast(block)
        hist = vectors.mapInArrow(_histogram(shared), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))  # at most BINS rows for each query
        needs = vectors.sparkSession.createDataFrame(pa.table({"q": pa.array(range(len(block.ids)), pa.int32()), "need": pa.array(block.need)}))
        hist = hist.withColumn("above", above).join(F.broadcast(needs), "q").where(F.col("above") >= F.col("need"))
        rows = hist.groupBy("q").agg(F.max_by(F.struct("bin", "n", "above"), "bin").alias("h")).select("q", "h.*").toPandas()
        q, bin_ = rows["q"].to_numpy(), rows["bin"].to_numpy().astype(np.int64)
        found = np.zeros(len(block.ids), dtype=bool)
        found[q] = True
        block.need[q] -= (rows["above"] - rows["n"]).to_numpy()
        block.low[q] += bin_ << block.shift  # without a k-th score low stays: all candidates are returned
        block.need[~found] = np.iinfo(np.int64).max // 2
        block.width = 1 << block.shift
        if block.shift == 0:
            return vectors.mapInArrow(_best(sc.broadcast(block)), "query_id long, vec_id long, score long")
        block.shift = max(0, block.shift - 8)


def top_k(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which `queries` holds, its k best other rows."""
    spark = vectors.sparkSession
    usable_rows = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    all_ = usable_rows.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("q"), queries.alias("is_query"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    top = all_.agg(F.max(norm).alias("any"), F.max(F.when(F.col("is_query"), norm)).alias("query"), F.count(F.when(F.col("is_query"), 1)).alias("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not top["n"]:
        return empty
    bound = min(1 << 62, int(top["any"] * top["query"]) + 2)
    n_blocks = -(-top["n"] // block)
    asked = materialise(all_.where("is_query").groupBy("vec_id").agg(F.min("q").alias("q")).select("vec_id", "q", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")), "queries")
    parts = None
    for i in range(n_blocks):
        rows = asked.where(F.col("block") == i).select("vec_id", "q").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        chunk = rows.to_batches()[0]
        best = _select(all_.select("vec_id", "q"), Block(chunk["vec_id"].to_numpy().copy(), chunk["q"], bound, k))
        best = materialise(best, "best") if n_blocks > 1 else best
        parts = best if parts is None else parts.unionByName(best)
    if parts is None:
        return empty
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op4_sql() -> str:
    return """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
    """
