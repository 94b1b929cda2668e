"""Line dedup: two Bloom filters find lines that may repeat; only those shuffle.

1. Each task hashes the different line keys of each of its documents into a filter of hashes seen once and a
   filter of hashes seen twice. Filters are cut into segments of 2^16 bits; per segment the partial filters
   are merged by "twice |= theirs_twice | (once & theirs_once); once |= theirs_once", which never loses a
   hash that two tasks share. Sparse segments travel as lists of bit numbers.
2. The merged filter of twice-seen hashes (FILTER_BITS / 8 bytes at most, a fixed bound) is broadcast. Lines
   whose hash is not in it cannot repeat and never shuffle. A corpus with more lines than one filter serves (134
   million) is scanned in several passes, each for its share of the hashes, so the filter never fills up.
3. The suspected lines are grouped by their whole key: exact confirmation, and the smallest document id of
   each repeated key. The group-by keeps a minimum and a maximum, so a line that a third of all documents
   hold is combined before the shuffle.
4. Only documents that lose a line are joined with the set of their lines to drop, and rewritten; a Bloom filter
   of their ids (16 MB at most) lets all others pass where they are.

Defined results: a null or empty text is one empty line; a line repeated within one document only is kept; in
the smallest doc_id all lines of a key stay; rows that share a doc_id are one document in the count of
documents; rows with a null doc_id are kept as they are and do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, SPACES, UPPER, discard, filter_places, id_filter, in_filter, lower_ascii, materialise, mix, strip_spaces

MIN_CHARS = 10
#: Bits of one filter: at least 2^20, 8 to 16 per line, at most FILTER_BITS (128 MB).
BITS_PER_LINE, FILTER_BITS, HASHES = 8, 1 << 30, 4
_SEGMENT = 1 << 16


def line_key(line: Column) -> Column:
    return lower_ascii(strip_spaces(line))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bit_numbers(h: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit numbers of each hash, all within one segment: row i belongs to h[i]."""
    h = mix(h.astype(np.uint64))
    segment = (h >> np.uint64(40)) % np.uint64(max(1, bits // _SEGMENT))
    inside = np.stack([(h >> np.uint64(s)) & np.uint64(0xFFFF) for s in (0, 12, 24)] + [mix(h) & np.uint64(0xFFFF)], axis=1)
    return (segment[:, None] * np.uint64(_SEGMENT) + inside[:, :HASHES]).astype(np.int64)


def set_bits(filter_: np.ndarray, numbers: np.ndarray) -> None:
    """Sets bits of a packed filter (uint8)."""
    if not len(numbers):
        return
    numbers = np.unique(numbers)
    byte, first = np.unique(numbers >> 3, return_index=True)
    filter_[byte] |= np.bitwise_or.reduceat(np.left_shift(1, numbers & 7).astype(np.uint8), first)


def have_bits(filter_: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """For each row of bit numbers: are all set?"""
    return ((filter_[numbers >> 3] >> (numbers & 7).astype(np.uint8)) & 1).all(axis=1)


def _pack(segment: np.ndarray) -> bytes:
    """A byte for the form, then the bit numbers as uint16, or all bits if that is shorter."""
    numbers = np.flatnonzero(np.unpackbits(segment, bitorder="little"))
    return b"\1" + numbers.astype("<u2").tobytes() if len(numbers) < _SEGMENT // 16 else b"\0" + segment.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, np.uint8, offset=1).copy()
    out = np.zeros(_SEGMENT // 8, np.uint8)
    set_bits(out, np.frombuffer(data, "<u2", offset=1).astype(np.int64))
    return out


def _partial_filters(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            h, n = np.unique(b["hashes"].flatten().to_numpy(zero_copy_only=False), return_counts=True)
            if not len(h):
                continue
            numbers = bit_numbers(h, bits)
            again = (n > 1) | have_bits(once, numbers)
            set_bits(twice, numbers[again].ravel())
            set_bits(once, numbers.ravel())
        used = np.flatnonzero(once.reshape(-1, _SEGMENT // 8).any(axis=1))
        for i in range(0, len(used), 256):
            part = used[i : i + 256]
            cut = lambda f, part=part: pa.array([_pack(f[s * (_SEGMENT // 8) : (s + 1) * (_SEGMENT // 8)]) for s in part], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), cut(once), cut(twice)], ["segment", "once", "twice"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial filters of the segments of one partition -> the merged twice filter of each."""
    state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for s, o, t in zip(b["segment"].to_pylist(), b["once"].to_pylist(), b["twice"].to_pylist(), strict=True):
            o, t = _unpack(o), _unpack(t)
            if s in state:
                once, twice = state[s]
                twice |= t | (once & o)
                once |= o
            else:
                state[s] = (o, t)
    yield pa.RecordBatch.from_arrays([pa.array(list(state), pa.int32()), pa.array([t.tobytes() for _, t in state.values()], pa.binary())], ["segment", "twice"])


def filter_size(n_lines: int, most: int = FILTER_BITS) -> tuple[int, int]:
    """Bits of a filter, and the number of passes that share all hashes out so that each pass fits into it."""
    wanted = n_lines * BITS_PER_LINE
    return min(most, max(1 << 20, 1 << (wanted - 1).bit_length())), max(1, -(-wanted // most))


def twice_filter(keyed: DataFrame, bits: int) -> np.ndarray:
    """keyed (hashes array<long>, one row per document) -> bits of all hashes that two rows may share."""
    parts = keyed.select("hashes").mapInArrow(_partial_filters(bits), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").mapInArrow(_merge, "segment int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        out[r["segment"] * (_SEGMENT // 8) : (r["segment"] + 1) * (_SEGMENT // 8)] = np.frombuffer(r["twice"], np.uint8)
    return out


def suspected_lines(keyed: DataFrame, bits: int) -> DataFrame:
    """keyed (_id, keys, hashes) -> _id, key for the keys whose hash two rows may share."""
    shared = keyed.sparkSession.sparkContext.broadcast(twice_filter(keyed, bits))

    @F.pandas_udf("array<int>")
    def places(hashes: pd.Series) -> pd.Series:
        """Places (from 1) of the hashes that the twice filter has."""
        n = hashes.map(len).to_numpy()
        flat = np.concatenate([np.zeros(0, np.int64), *hashes])
        hit = np.flatnonzero(have_bits(shared.value, bit_numbers(flat, bits)))
        ends = np.cumsum(n)
        where = np.searchsorted(hit, np.concatenate([[0], ends]))
        return pd.Series([hit[a:b] - start + 1 for a, b, start in zip(where[:-1], where[1:], ends - n, strict=True)])

    at = keyed.withColumn("at", places("hashes")).where(F.size("at") > 0)
    return at.select("_id", F.explode(F.transform("at", lambda i: F.element_at("keys", i))).alias("key"))


def _without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    """Texts without the lines whose keys are in drops, and the numbers of those lines."""
    table = str.maketrans(UPPER, LOWER)

    def kept(text: str | None, drop) -> tuple[str, int]:
        lines, gone = (text or "").split("\n"), set(() if drop is None else drop)
        rest = [x for x in lines if x.strip(SPACES).translate(table) not in gone] if gone else lines
        return "\n".join(rest), len(lines) - len(rest)

    return pd.DataFrame([kept(t, d) for t, d in zip(texts, drops, strict=True)], columns=["text", "dropped"])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs with `text` without repeated lines, and _n_lines, _n_dropped (long), in place of columns of these names."""
    spark = docs.sparkSession
    n_lines = docs.agg(F.sum(F.size(lines_of(F.col(f"`{text}`")))).alias("n")).first()["n"] or 0
    bits, passes = filter_size(n_lines, filter_bits)
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text)), line_key), lambda k: F.char_length(k) >= min_chars))
    keyed = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), keys.alias("keys"))
    suspects = []
    for i in range(passes):
        turn = F.lit(i)
        part = keyed if passes == 1 else keyed.withColumn("keys", F.filter("keys", lambda k: F.pmod(F.xxhash64(k, F.lit(1)), F.lit(passes)) == turn))  # noqa: B023
        part = part.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
        suspects.append(materialise(suspected_lines(part, bits), "suspected-lines"))
    sus = reduce(DataFrame.unionByName, suspects)
    repeated = sus.groupBy("key").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first < last").select("key", "first")
    repeated = materialise(repeated, "repeated-lines")
    drops = materialise(sus.join(repeated, "key").where("_id > first").groupBy("_id").agg(F.collect_set("key").alias("_drop")), "dropped-lines")
    discard(*suspects, repeated)
    # documents without a line to drop stay where they are; a filter of the other ids tells them apart
    id_bits, ids = id_filter(drops, "_id")
    shared = spark.sparkContext.broadcast(ids)

    @F.pandas_udf("boolean")
    def listed(places: pd.Series) -> pd.Series:
        return pd.Series(in_filter(shared.value, pa.array(places)))

    # docs may have columns of any name, so its rows travel as one struct
    row, key = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id")
    marked = docs.select(row, key, F.size(lines_of(F.col(f"`{text}`"))).cast("long").alias("_n_lines"), listed(filter_places(F.col(f"`{doc_id}`"), id_bits)).alias("listed"))
    body = F.col(f"row.`{text}`")
    names = lambda new: [new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    plain = marked.where("NOT listed").select(*names(F.coalesce(body, F.lit(""))), "_n_lines", F.lit(0).cast("long").alias("_n_dropped"))
    cut = marked.where("listed").join(drops, F.col("id") == F.col("_id"), "left").withColumn("cut", F.pandas_udf(_without, "text string, dropped long")(body, F.col("_drop")))
    return plain.unionByName(cut.select(*names(F.col("cut.text")), "_n_lines", F.col("cut.dropped").alias("_n_dropped")))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op1_sql() -> str:
    return f"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
    f AS (SELECT k.*, (r.key IS NOT NULL AND k.doc_id <> r.first) AS dropped FROM k LEFT JOIN r USING (key))
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
    FROM f GROUP BY doc_id
    """
