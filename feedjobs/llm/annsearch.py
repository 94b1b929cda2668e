"""Approximate nearest neighbours by an adaptive scan of dimensions.

Vectors are dealt to lists by their nearest centre (k-means on a bounded sample) and turned by a random rotation, so
that any leading dimensions of a difference are a random sample of it. A list is stored in pieces of a bounded
number of rows, each piece in blocks of 16 columns. A query that meets a piece adds up squared differences block by
block. After each block it tests, for every candidate left, the hypothesis that the candidate is within the query's
present k-th best distance r: then the share of r^2 in the first m of d dimensions would follow a beta distribution
with parameters m / 2 and (d - m) / 2, and a partial sum above its (1 - ALPHA) quantile abandons the candidate.
Candidates that survive all blocks are measured on their original vectors in double precision.

Queries probe their own list first, which gives each a bound r; then the other lists, with that bound from the start.
How many lists are probed is calibrated: for at most `CALIBRATE` queries all rows are measured, and the fewest
lists are taken that hold the wanted share of their true neighbours. Every row is indexed; only the centres come from a
sample, of at most `SAMPLE` rows.

No group is unbounded: large lists are dealt in slots of `SLOT` pieces, queries come in batches of `QUERIES`, and each
pair of a piece and a batch returns k rows for a query at most.

Defined results: vectors null, zero, without an id or with a null or non-finite component take no part, neither
as query nor as candidate; only vectors of the query's length are candidates; rows that share the query's id are
the query's own, and the smallest of their vectors asks; repeated rows are candidates of their own. A query that finds
fewer than k candidates in its lists probes all others too, so it returns all candidates if there are fewer than k.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded_sample, materialise
from .topk import usable

#: Rows of the sample that centres are fitted on for each of them, and in all; lists in all.
PER_CENTRE, SAMPLE, LISTS = 32, 1 << 17, 1 << 12
CALIBRATE, WANTED = 128, 0.97
PIECE, SLOT, QUERIES = 512, 64, 256
COLUMNS, ALPHA = 16, 1e-3
SEED = 13


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, d)).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


@lru_cache(maxsize=8)
def limits(d: int, columns: int = COLUMNS, alpha: float = ALPHA) -> list[float]:
    """After each block but the last: the share of a squared distance that its first dimensions hold with probability 1 - alpha."""
    x = (np.arange(1 << 14) + 0.5) / (1 << 14)
    out = []
    for m in range(columns, d, columns):
        log = (m / 2 - 1) * np.log(x) + ((d - m) / 2 - 1) * np.log1p(-x)
        mass = np.cumsum(np.exp(log - log.max()))
        out.append(float(x[min(len(x) - 1, np.searchsorted(mass, (1 - alpha) * mass[-1]))]))
    return out


def _nearest_order(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to the centres, short of the vectors' own norms."""
    return (centres.astype(np.float64) ** 2).sum(axis=1)[None, :] - 2 * vectors.astype(np.float64) @ centres.T.astype(np.float64)


def fit_centres(rows: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """At most n centres of the rows, by k-means from rows drawn at random."""
    rows = rows.astype(np.float32)
    centres = np.unique(rows[np.random.default_rng(SEED).permutation(len(rows))[:n]], axis=0)
    for _ in range(rounds):
        own = np.concatenate([_nearest_order(rows[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(rows), 4096)])
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros((len(centres), rows.shape[1]))
        np.add.at(sums, own, rows)
        centres = (sums[count > 0] / count[count > 0, None]).astype(np.float32)
    return centres


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) for each length of the lists."""
    n = np.asarray(vectors.value_lengths())
    flat, start = vectors.flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)])
    for d in np.unique(n):
        at = np.flatnonzero(n == d)
        yield int(d), at, flat[start[at][:, None] + np.arange(d)].reshape(len(at), d)


class Lists:
    """Centres for each length, numbered through. A length that the sample lacks is one list, with a number below 0."""

    def __init__(self, sample: pa.ListArray, share: float):
        self.first, self.centres, at = {}, {}, 0
        for d, _, rows in _by_length(sample):
            n = max(1, round((len(rows) / max(share, 1e-12)) ** 0.5))
            self.first[d], self.centres[d] = at, fit_centres(rows, min(n, LISTS, max(1, len(rows) // 4)))
            at += len(self.centres[d])

    def order(self, d: int, rows: np.ndarray, most: int) -> np.ndarray:
        """Numbers of the nearest lists of each row, nearest first: [rows, at most `most`]."""
        if d not in self.centres:
            return np.full((len(rows), 1), -1 - d)
        far = _nearest_order(rows, self.centres[d])
        most = min(most, far.shape[1])
        near = np.argpartition(far, most - 1, axis=1)[:, :most]
        return self.first[d] + np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(b.num_rows, np.int64)
            for d, at, rows in _by_length(b["vector"]):
                for i in range(0, len(at), 1024):
                    out[at[i : i + 1024]] = shared.value.order(d, rows[i : i + 1024], 1)[:, 0]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["vector"], b["asks"], pa.array(out)], ["vec_id", "vector", "asks", "list"])

    return run


def _probe(shared, low: int, high: int):
    """The lists from the low-th nearest to before the high-th of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for d, at, rows in _by_length(part["vector"]):
                    near = shared.value.order(d, rows, high)[:, low:]
                    if near.shape[1]:
                        own = np.repeat(at, near.shape[1])
                        yield pa.RecordBatch.from_arrays([*[part[c].take(pa.array(own)) for c in ("query_id", "vector", "bound")], pa.array(near.reshape(-1).astype(np.int64))], ["query_id", "vector", "bound", "list"])

    return run


def _pack(table: pa.Table) -> pa.Table:
    """The rows of one piece as blocks of rotated columns, beside the original rows."""
    table = table.combine_chunks()
    rows = next(_by_length(table["vector"].combine_chunks()))[2]
    d = rows.shape[1]
    turned = rows.astype(np.float32) @ rotation(d)
    blocks = [np.ascontiguousarray(turned[:, i : i + COLUMNS].T).tobytes() for i in range(0, d, COLUMNS)]
    return pa.table({
        "list": table["list"][:1], "slot": table["slot"][:1], "d": pa.array([d], pa.int32()), "ids": pa.array([table["vec_id"].to_numpy()], pa.list_(pa.int64())),
        "blocks": pa.array([blocks], pa.list_(pa.binary())), "rows": pa.array([rows.astype(np.float64).tobytes()], pa.binary()),
    })


def _batch(table: pa.Table) -> pa.Table:
    """The queries of one batch in a row."""
    table = table.combine_chunks()
    rows = next(_by_length(table["vector"].combine_chunks()))[2].astype(np.float64)
    return pa.table({"list": table["list"][:1], "query_ids": pa.array([table["query_id"].to_numpy()], pa.list_(pa.int64())), "bounds": pa.array([table["bound"].to_numpy()], pa.list_(pa.float64())), "vectors": pa.array([rows.tobytes()], pa.binary())})


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, score))[:k]


def scan_piece(ids: np.ndarray, blocks: list[np.ndarray], rows: np.ndarray, query_id: int, query: np.ndarray, turned: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k nearest candidates of a piece for a query, none of them farther than bound unless few are
    nearer, and how many (candidate, column) differences were added up. The first rows, enough for k candidates, are
    measured at once: they bring a bound where there is none yet."""
    d = rows.shape[1]
    here = np.flatnonzero(ids != query_id)
    head = here[: 4 * k] if bound == np.inf else here[:0]
    score = np.sqrt(((rows[head] - query) ** 2).sum(axis=1))
    if len(head) >= k:
        bound = np.partition(score, k - 1)[k - 1]
    alive, work = here[len(head) :], len(head) * d
    partial = np.zeros(len(alive))
    for i, (block, limit) in enumerate(zip(blocks, [*limits(d), 1.0], strict=True)):
        own = turned[i * COLUMNS : (i + 1) * COLUMNS, None]
        partial += ((block[:, alive] - own) ** 2).sum(axis=0)
        work += len(alive) * len(own)
        near = partial <= bound * bound * limit * (1 + 1e-4) + 1e-6  # rotated columns are in single precision
        alive, partial = alive[near], partial[near]
        if not len(alive):
            break
    left = np.concatenate([head, alive])
    score = np.concatenate([score, np.sqrt(((rows[alive] - query) ** 2).sum(axis=1))])
    best = _best(ids[left], score, k)
    return ids[left[best]], score[best], work


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                d, ids = b["d"][i].as_py(), np.asarray(b["ids"][i].values)
                blocks = [np.frombuffer(x.as_buffer(), np.float32).reshape(-1, len(ids)) for x in b["blocks"][i].values]
                rows = np.frombuffer(b["rows"][i].as_buffer(), np.float64).reshape(-1, d)
                queries, bounds = np.asarray(b["query_ids"][i].values), np.asarray(b["bounds"][i].values)
                vectors = np.frombuffer(b["vectors"][i].as_buffer(), np.float64).reshape(-1, d)
                turned = vectors.astype(np.float32) @ rotation(d)
                found = [scan_piece(ids, blocks, rows, q, v, t, r, k)[:2] for q, v, t, r in zip(queries, vectors, turned, bounds, strict=True)]
                n = [len(x) for x, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, n)), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["query_id", "vec_id", "score"])

    return run


def _all_distances(shared, k: int):
    """For calibration: the k nearest rows of each task to a few queries, with their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kept = ["query_id", "vec_id", "score", "list"], {}
        for b in batches:
            ids, lists = b["vec_id"].to_numpy(), b["list"].to_numpy()
            for d, at, rows in _by_length(b["vector"]):
                for query_id, query in shared.value:
                    if len(query) != d:
                        continue
                    for i in range(0, len(at), 8192):
                        own = at[i : i + 8192][ids[at[i : i + 8192]] != query_id]
                        score = np.sqrt(((rows[i : i + 8192].astype(np.float64)[ids[at[i : i + 8192]] != query_id] - query) ** 2).sum(axis=1))
                        old = kept.get(query_id, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)))
                        v, s, x = (np.concatenate([a, c]) for a, c in zip(old, (ids[own], score, lists[own]), strict=True))
                        best = _best(v, s, k)
                        kept[query_id] = (v[best], s[best], x[best])
        for query_id, (v, s, x) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), query_id)), pa.array(v), pa.array(s), pa.array(x)], names)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def calibrated_probes(assigned: DataFrame, asked: DataFrame, lists: Lists, k: int, wanted: float, most: int = CALIBRATE) -> int:
    """The fewest lists that hold `wanted` of the true neighbours of at most `most` queries."""
    sc = assigned.sparkSession.sparkContext
    some = [(r["query_id"], np.array(r["vector"], np.float64)) for r in bounded_sample(asked, most, "query_id").collect()]
    near = _ranked(assigned.mapInArrow(_all_distances(sc.broadcast(some), k), "query_id long, vec_id long, score double, list long"), k)
    vectors, places = dict(some), []
    of = {i: {int(x): at for at, x in enumerate(lists.order(len(v), v[None, :], LISTS)[0])} for i, v in vectors.items()}
    for r in near.select("query_id", "list").collect():  # k rows for each of the few queries
        places.append(of[r["query_id"]][r["list"]])
    return 1 + (sorted(places)[max(0, int(np.ceil(wanted * len(places))) - 1)] if places else 0)


def _packed(assigned: DataFrame, piece: int) -> DataFrame:
    """list, slot, d, ids, blocks, rows: a row for each piece."""
    sizes = assigned.groupBy("list").agg(F.ceil(F.count("*") / piece).alias("pieces"))
    dealt = assigned.join(F.broadcast(sizes), "list")  # one row for each list, at most LISTS for a length of vectors
    at = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("pieces"))
    dealt = dealt.select("list", "vec_id", "vector", at.alias("piece")).withColumn("slot", F.floor(F.col("piece") / SLOT))
    return dealt.groupBy("list", "slot", "piece").applyInArrow(_pack, "list long, slot long, d int, ids array<long>, blocks array<binary>, rows binary")


def _searched(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query in the lists that it probes, piece by piece."""
    crowd = F.broadcast(probes.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("batches")))
    slots = F.broadcast(index.groupBy("list").agg((F.max("slot") + 1).alias("slots")))
    batch = F.pmod(F.xxhash64("query_id"), F.col("batches"))
    batches = probes.join(crowd, "list").select("list", "query_id", "vector", "bound", batch.alias("batch")).groupBy("list", "batch").applyInArrow(_batch, "list long, query_ids array<long>, bounds array<double>, vectors binary")
    batches = batches.join(slots, "list").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    return index.join(batches, ["list", "slot"]).mapInArrow(_scan(k), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", wanted: float = WANTED, piece: int = PIECE, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which `queries` holds, its k nearest other rows found. `probes`
    fixes the number of lists instead of calibrating it for the `wanted` recall."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fit = F.col(vec_id).isNotNull() & usable(F.col(vector)) & F.exists(F.col(vector), lambda x: x != 0)
    rows = vectors.where(fit).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    total = rows.count()
    if not total:
        return empty
    size = min(SAMPLE, PER_CENTRE * min(LISTS, max(8, round(total**0.5))))
    sample = bounded_sample(rows, size, "vec_id").select("vector").toArrow().combine_chunks()["vector"].combine_chunks()
    lists = Lists(sample, len(sample) / total)
    shared = spark.sparkContext.broadcast(lists)
    assigned = materialise(rows.mapInArrow(_assign(shared), "vec_id long, vector array<double>, asks boolean, list long"), "assigned")
    asked = materialise(assigned.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")), "asked")
    probes = probes or calibrated_probes(assigned, asked, lists, k, wanted)
    index = materialise(_packed(assigned.select("list", "vec_id", "vector"), piece), "lists")
    probed = lambda asked, low, high: asked.mapInArrow(_probe(shared, low, high), "query_id long, vector array<double>, bound double, list long")
    first = materialise(_ranked(_searched(index, probed(asked.withColumn("bound", F.lit(float("inf"))), 0, 1), k), k), "nearest-list")
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("found"))
    bounded = asked.join(bounds, "query_id", "left").select("query_id", "vector", F.coalesce("found", F.lit(float("inf"))).alias("bound"))
    found = first.select("query_id", "vec_id", "score")
    if probes > 1:
        found = found.unionByName(_searched(index, materialise(probed(bounded, 1, probes), "probes"), k))
    found = materialise(_ranked(found, k).select("query_id", "rank", "vec_id", "score"), "found")
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = materialise(probed(bounded.join(enough, "query_id", "left_anti"), probes, LISTS), "short")
    if short.isEmpty():
        return found
    more = found.drop("rank").unionByName(_searched(index, short, k))
    return _ranked(more, k).select("query_id", "rank", "vec_id", "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
