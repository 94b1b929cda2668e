"""Fill-in-the-middle transformation: texts cut at two line ends and rearranged for infilling.

A text is a sequence of units, its lines with their ends. Where the units end, in code points, is kept as a
compressed set of integers: ends that share their upper 16 bits form a container, which is a sorted array, a
bitmap of 65,536 bits or a list of runs, whichever takes the fewest bytes, and the set knows the cumulative
cardinality of its containers. The end of the j-th unit is then a binary search for the container and a select
inside it; both cuts of a text are found so, and the text itself is cut and joined by built-in functions.

Where to cut is drawn from a hash of seed and doc_id, so reruns agree and no row needs another.

Defined results: a null text counts as empty, a null doc_id as an empty string in the hash; an empty text, a
text that holds a sentinel, and a share of texts given by `rate` stay plain, with null cut lengths. Rows that
share a doc_id are drawn alike. All columns of the input stay, but one named like a result gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sliced, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
_BITMAP_BYTES = 1 << 13


class _Array:
    """Sorted 16-bit values."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, j: int) -> int:
        return int(self.low[j])


class _Bitmap:
    """65,536 bits, and how many are set before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))])

    def select(self, j: int) -> int:
        at = int(np.searchsorted(self.before, j, side="right")) - 1
        word = int(self.words[at])
        for _ in range(j - int(self.before[at])):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1


class _Runs:
    """Runs of consecutive values: where each starts, and how many values lie before it."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
        self.start, self.before = low[first].astype(np.uint16), first

    def select(self, j: int) -> int:
        at = int(np.searchsorted(self.before, j, side="right")) - 1
        return int(self.start[at]) + j - int(self.before[at])


class BoundarySet:
    """A set of sorted, distinct, non-negative integers in containers by their upper bits."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, dtype=np.int64)
        upper = values >> 16
        first = np.flatnonzero(np.diff(upper, prepend=-1)) if len(values) else np.zeros(0, np.int64)
        self.keys, self.cumulative = upper[first], np.append(first, len(values))
        self.containers = [self._container(values[a:b] & 0xFFFF) for a, b in zip(self.cumulative[:-1], self.cumulative[1:], strict=True)]

    @staticmethod
    def _container(low: np.ndarray) -> _Array | _Bitmap | _Runs:
        runs = int(np.count_nonzero(np.diff(low) != 1)) + 1
        if 4 * runs < min(2 * len(low), _BITMAP_BYTES):
            return _Runs(low)
        return _Array(low) if 2 * len(low) <= _BITMAP_BYTES else _Bitmap(low)

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, j: int) -> int:
        """The j-th smallest value, from 0."""
        at = int(np.searchsorted(self.cumulative, j, side="right")) - 1
        return (int(self.keys[at]) << 16) + self.containers[at].select(j - int(self.cumulative[at]))


def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """For each text the number of its units, and the code points before the earlier and the later cut."""
    counts, lower, upper = [], [], []
    for b in sliced([pa.RecordBatch.from_arrays([texts, first, second], ["text", "a", "b"])], "text"):
        data, offsets = text_bytes(b["text"])
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        lines = np.flatnonzero(data == 10)
        ends, of = begins[lines + 1], np.searchsorted(lines, offsets)
        for i, (x, y) in enumerate(zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)):
            start, stop = int(offsets[i]), int(offsets[i + 1])
            own = ends[of[i] : of[i + 1]]
            if stop > start and data[stop - 1] != 10:
                own = np.append(own, begins[stop])
            units = BoundarySet(own - begins[start])
            n = len(units)
            cut = sorted((x % (n + 1), y % (n + 1)))
            counts.append(n)
            for out, j in ((lower, cut[0]), (upper, cut[1])):
                out.append(units.select(j - 1) if j else 0)
    kind = pa.int64()
    return pa.StructArray.from_arrays([pa.array(counts, kind), pa.array(lower, kind), pa.array(upper, kind)], ["n", "lower", "upper"])


def _draw(doc_id: Column, seed: int, group: int) -> Column:
    """The group-th eight hexadecimal digits of the hash of seed and doc_id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output. `rate` percent of the
    texts are transformed, `spm` percent of those with the suffix first."""

    def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        return _cuts(texts, first, second)

    whole = F.coalesce(F.col(text), F.lit(""))
    cuts = F.arrow_udf(cut, "struct<n: bigint, lower: bigint, upper: bigint>")(whole, _draw(F.col(doc_id), seed, 0), _draw(F.col(doc_id), seed, 1))
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held |= F.contains(whole, F.lit(mark))
    plain = (whole == "") | held | (_draw(F.col(doc_id), seed, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col(doc_id), seed, 3) % 100 < spm, "spm").otherwise("psm")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    cut_rows = docs.select(row.alias("row"), whole.alias("text"), form.alias("form"), cuts.alias("cut"))
    lower, upper = F.col("cut.lower").cast("int"), F.col("cut.upper").cast("int")
    prefix, middle, suffix = F.col("text").substr(F.lit(1), lower), F.col("text").substr(lower + 1, upper - lower), F.col("text").substr(upper + 1, F.char_length("text"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    results = {"n": F.col("cut.n"), "form": F.col("form"), "prefix_chars": cut_only(F.col("cut.lower")), "middle_chars": cut_only(F.col("cut.upper") - F.col("cut.lower")), "output": output}
    return cut_rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in results], *[c.alias(name) for name, c in results.items()])


def restore(output: Column, form: Column) -> Column:
    """The text that `fill_in_middle` rearranged. Transformed texts hold no sentinel of their own, and no two
    sentinels can overlap, so the first of each is the one that was put in."""
    between = lambda a, b: F.split_part(F.split_part(output, F.lit(a), F.lit(2)), F.lit(b), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op11_sql() -> str:
    return r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    n AS (SELECT *, len(u)::BIGINT AS n, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS x FROM d),
    c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS i, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS j,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 100 THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
    p AS (SELECT *, array_to_string(u[:i], '') AS prefix, array_to_string(u[i + 1:j], '') AS middle, array_to_string(u[j + 1:], '') AS suffix FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM p
    """
