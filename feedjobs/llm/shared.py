"""Helpers that the training-data operators share: scratch tables, batch limits, hashing of words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); one of its own only where that is unset in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="feedjobs-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and each side of a later join
    starts with an exchange of its own, which adaptive execution can split when a key is skewed. Tables of
    hashes do not compress; written plainly they also spare the codec's buffers outside the heap."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that `materialise` wrote and that no frame still to be computed reads."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        folders = {f.rsplit("/", 1)[0] for f in files}
        for folder in folders:
            if scratch_dir(spark).rstrip("/").split(":", 1)[-1].lstrip("/") in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filter_places(id_: Column, bits: int) -> Column:
    """The four bits that an id sets in a Bloom filter of this many bits."""
    return F.array(*[F.pmod(F.xxhash64(id_, F.lit(i)), F.lit(bits)) for i in range(4)])


def id_filter(ids: DataFrame, key: str, most: int = 1 << 27) -> tuple[int, np.ndarray]:
    """A Bloom filter over a column of ids: its number of bits and the bits. It has at most `most` bits (16 MB), so
    it can be broadcast at any size of the table; beyond 10 million ids it only lets more of the others pass."""
    bits = min(most, max(1 << 15, 1 << (12 * ids.count()).bit_length()))
    place = ids.select(F.explode(filter_places(F.col(key), bits)).alias("at"))
    parts = place.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        start = (r["k"] - 1) * (1 << 12)
        out[start : start + (1 << 12)] = np.frombuffer(r["map"], np.uint8)
    return bits, out


def in_filter(filter_: np.ndarray, places: pa.Array) -> np.ndarray:
    """For each row of `filter_places`: are all its bits set?"""
    at = places.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces of about `most` bytes of one text column (a longer text alone), so what a
    worker holds beside the batch is bounded by bytes, however long the texts are."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
            yield b.slice(i, j - i)
            i = j


def bounded_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """n rows of df (all, if fewer), those with the smallest hash of key. Rows are thinned out by the hash first,
    so no task or driver ever gets more than a few times n of them."""
    total = df.count()
    h = F.xxhash64(key)
    thin = df.where(F.pmod(F.xxhash64(h), F.lit(max(1, total))) < 2 * n + 200) if total > 2 * n + 200 else df
    return thin.orderBy(h, key).limit(n)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def strip_spaces(col: Column) -> Column:
    return F.trim(col, F.lit(SPACES))


def words_of(text: Column) -> Column:
    """The array of `[^\\x20\\x09-\\x0D]+` of a text; empty for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


# ------------------------------------------------------------------ word hashes in numpy

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_BLOCK = 1 << 20
_tables: dict[str, np.ndarray] = {}

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_not_space = np.ones(256, dtype=bool)
_not_space[[9, 10, 11, 12, 13, 32]] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or len(_tables["p"]) < n:
        n = max(n, _BLOCK + 4096)
        for name, base in (("p", _P), ("i", _P_INV)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _tables[name] = np.multiply.accumulate(x)
    return _tables["p"], _tables["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) in one array, and the offset where each text begins, plus the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _not_space):
    """Byte starts and ends of all words, and for each text the index of its first word (plus the end).
    inside[b] tells whether byte b belongs to a word; a word never crosses the end of a text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    on = inside[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = on[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = on[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    starts = np.flatnonzero(on & ~before)
    return starts, np.flatnonzero(on & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of words with A-Z lower-cased, as differences of prefix sums of a polynomial; with
    prefix > 0 also those of the first `prefix` bytes of each word. Works in blocks of about 1 MB."""
    out = np.empty(len(starts), dtype=np.uint64)
    short = np.empty(len(starts) if prefix else 0, dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        p, inv = _powers(hi - lo + 1)
        sums = np.empty(hi - lo + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((_lower[data[lo:hi]].astype(np.uint64) + np.uint64(1)) * p[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64)
        if prefix:
            e = np.minimum(e, s + prefix)
            short[i:j] = (sums[e] - sums[s]) * inv[s] + np.uint64(0x51ED27)
        i = j
    return mix(out), mix(short)
