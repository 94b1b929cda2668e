"""URL filters: fixed host and path rules, then the ratio of two character language models.

Both models are variable-order Markov models over the bytes of a URL (what follows `://`): for each context
of 0 to ORDER bytes, counts of the next byte, interpolated by Witten-Bell smoothing from the longest
context that was seen down to a uniform distribution. One model is counted over all URLs that the rules
accept, one over all that they reject. A URL that no rule decides gets the mean log-likelihood difference
of its bytes; the threshold is calibrated on a tenth of the ruled URLs that the counts leave out: the first of
FOLDS folds that holds both verdicts. Where no fold does, all ruled URLs are counted and calibrated on.

Counts are kept for every context and every byte that the ruled URLs hold, as a table with exact keys that grows
with the corpus; nothing of it goes to the driver. The log-likelihood of a byte depends only on its window (the
byte and up to ORDER bytes before it), so it is worked out once per different window, order by order: each join
meets a context or a shorter window at most 256 times. The bytes of each different body then look up their
windows; windows with more than 1/SPLIT of all bytes, fewer than SPLIT by definition, are broadcast, so no key
of the shuffled join is hot. Gains are added as whole numbers (2^-32), so the order of the rows does not matter.

Defined results: a null URL or one without `://` has empty host and path and no rule; a URL without bytes to
score is allowed (score 0); without ruled URLs of both verdicts everything undecided is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lower_ascii, materialise, text_bytes

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
ORDER, SPLIT = 5, 1000
#: Share of accepted URLs that may be lost, and the fold of ruled URLs kept for calibration.
MAX_LOST, FOLDS = 0.02, 10
_BINS, _STEP = 4000, 0.005  # of the histogram of scores that the threshold is read from
_BITS = 48  # of a window's bytes in its key: room for ORDER + 1 bytes, their number above them
_UNIT = float(1 << 32)


def with_rules(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, rule (the longest that fits, else null), ruled (its verdict) and body (after `://`)."""
    c = F.coalesce(F.col(url), F.lit(""))
    df = pages.withColumns(
        {
            "host": lower_ascii(F.regexp_extract(c, r"://([^/?#]*)", 1)),
            "path": F.regexp_extract(c, r"://[^/?#]*([^?#]*)", 1),
            "body": F.when(F.instr(c, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(""),
        }
    )
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):  # a longer rule comes later and wins
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{path}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return df.withColumns({"rule": rule, "ruled": verdict})


def windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the key of its window: itself and up to ORDER bytes before it in its own URL, the last byte
    lowest, with their number above them."""
    depth = np.minimum(np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets)), ORDER)
    packed = np.zeros(len(data), dtype=np.int64)
    for k in range(ORDER + 1):
        on = np.flatnonzero(depth >= k)
        packed[on] |= data[on - k].astype(np.int64) << (8 * k)
    return packed | (depth.astype(np.int64) + 1) << _BITS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: list = []
    for b in batches:
        accepted = np.asarray(b["accepted"].to_pylist(), dtype=bool)
        for cls in (0, 1):
            seen.append((cls, *np.unique(windows(*text_bytes(b["body"].filter(pa.array(accepted == bool(cls))))), return_counts=True)))
        if sum(len(keys) for _, keys, _ in seen) > 2_000_000:
            yield from _emit(seen)
            seen = []
    yield from _emit(seen)


def _emit(seen: list) -> Iterator[pa.RecordBatch]:
    for cls, keys, n in seen:
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(n.astype(np.int64) * (cls == c)) for c in (0, 1))], ["gram", "n0", "n1"])


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b["body"])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b["id"].to_numpy(), np.diff(offsets))), pa.array(windows(data, offsets))], ["id", "gram"])


def _last(n: int) -> Column:
    """The last n bytes of a window, as a window."""
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1)).bitwiseOR(F.lit(n << _BITS))


def _suffixes() -> Column:
    length = F.shiftright("gram", _BITS)
    return F.explode(F.array_compact(F.array(*[F.when(length >= n, _last(n)) for n in range(1, ORDER + 2)]))).alias("gram")


def _context() -> Column:
    """A window without its last byte, as a window (0 for the empty one)."""
    return F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << _BITS) - 1)), 8).bitwiseOR(F.shiftleft(F.shiftright("gram", _BITS) - 1, _BITS))


class Model:
    """Counts of both classes (0 rejected, 1 accepted) as tables: grams (gram, n0, n1), a row per context and byte,
    and contexts (ctx, t0, t1, k0, k1), with all bytes that follow the context and the number of different ones."""

    def __init__(self, grams: DataFrame, split: int = SPLIT):
        self.grams, self.split = grams, split
        sums = [F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)] + [F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"k{c}") for c in (0, 1)]
        self.contexts = materialise(grams.groupBy(_context().alias("ctx")).agg(*sums), "url-contexts")

    def knows_both(self) -> bool:
        return not self.contexts.where("ctx = 0 AND t0 > 0 AND t1 > 0").isEmpty()

    def gains(self, wanted: DataFrame) -> DataFrame:
        """gram, gain for all windows of wanted and their shorter ends: log P(accepted) - log P(rejected) of the
        last byte, in units of 2^-32."""
        wanted = materialise(wanted.select(_suffixes()).distinct(), "url-wanted")
        before, levels = None, []
        for n in range(1, ORDER + 2):
            df = wanted.where(F.shiftright("gram", _BITS) == n).join(self.grams, "gram", "left").withColumn("ctx", _context()).join(self.contexts, "ctx", "left")
            if before is None:
                df = df.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
            else:
                df = df.withColumn("end", _last(n - 1)).join(before.select(F.col("gram").alias("end"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), "end")
            p = lambda c: F.when(F.col(f"t{c}") > 0, (F.coalesce(f"n{c}", F.lit(0)) + F.col(f"k{c}") * F.col(f"q{c}")) / (F.col(f"t{c}") + F.col(f"k{c}"))).otherwise(F.col(f"q{c}")).alias(f"p{c}")
            before = materialise(df.select("gram", p(0), p(1)), "url-chances")
            levels.append(before.select("gram", F.round((F.log("p1") - F.log("p0")) * _UNIT).cast("long").alias("gain")))
        return reduce(DataFrame.unionByName, levels)

    def scores(self, bodies: DataFrame) -> DataFrame:
        """id (xxhash64 of a body), score for the different bodies that are not empty: the mean gain of their bytes."""
        some = materialise(bodies.where("body != ''").select("body").distinct().select(F.xxhash64("body").alias("id"), "body"), "url-bodies")
        positions = some.mapInArrow(_positions, "id long, gram long")
        seen = materialise(positions.groupBy("gram").agg(F.count("*").alias("c")), "url-windows")
        total = seen.agg(F.sum("c").alias("c")).first()["c"] or 0
        gains = materialise(self.gains(seen.select("gram")).join(seen, "gram"), "url-gains")
        hot = F.broadcast(gains.where(F.col("c") * self.split > total).select("gram", "gain"))
        rest = gains.where(F.col("c") * self.split <= total).select("gram", "gain")
        each = positions.join(hot, "gram").unionByName(positions.join(hot.select("gram"), "gram", "left_anti").join(rest, "gram"))
        return materialise(each.groupBy("id").agg((F.sum("gain") / F.count("*") / _UNIT).alias("score")), "url-scores")

    def score(self, bodies: pa.Array) -> np.ndarray:
        """Scores of a few URLs; 0 for an empty one."""
        df = self.grams.sparkSession.createDataFrame(list(enumerate(bodies.to_pylist())), "i long, body string")
        return np.array([r["score"] for r in with_scores(df, self.scores(df)).orderBy("i").collect()])


def train(ruled: DataFrame, split: int = SPLIT) -> Model:
    """Counts over all rows of ruled (accepted boolean, body string)."""
    sums = [F.sum(c).alias(c) for c in ("n0", "n1")]
    whole = ruled.select("accepted", "body").mapInArrow(_count, "gram long, n0 long, n1 long").groupBy("gram").agg(*sums)
    return Model(materialise(whole.select(_suffixes(), "n0", "n1").groupBy("gram").agg(*sums), "url-grams"), split)


def with_scores(df: DataFrame, scores: DataFrame, body: str = "body") -> DataFrame:
    """Adds score, 0 for a body without one."""
    joined = df.drop("score").withColumn("_id", F.xxhash64(body)).join(scores.withColumnRenamed("id", "_id"), "_id", "left")
    return joined.withColumn("score", F.coalesce("score", F.lit(0.0))).drop("_id")


def calibrate(scored: DataFrame, max_lost: float = MAX_LOST) -> float:
    """The score below which a URL is blocked: the one with the best balanced accuracy among those that block
    at most max_lost of the accepted; of a run of equally good ones the middle. Read from a histogram with a fixed
    number of bins."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(_BINS - 1), F.floor(F.col("score") / _STEP + _BINS // 2)))
    rows = scored.groupBy("accepted", bin_.cast("int").alias("bin")).count().collect()
    counts = np.zeros((2, _BINS + 1))
    for r in rows:
        counts[int(r["accepted"]), r["bin"] + 1] += r["count"]
    if not counts.sum(axis=1).all():
        return -np.inf
    below = counts.cumsum(axis=1) / counts.sum(axis=1, keepdims=True)  # share with a score under each edge
    gain = np.where(below[1] <= max_lost, below[0] - below[1], -1)
    first = int(gain.argmax())
    run = np.append(gain[first:] < gain[first], True).argmax()  # edges from the first best on that are as good
    return float((first + int(run - 1) // 2 - _BINS // 2) * _STEP)


def _held_out(ruled: DataFrame) -> int | None:
    """The first fold that holds URLs of both verdicts and leaves some of both to the counts."""
    counts = ruled.groupBy("fold").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).collect()  # FOLDS rows
    every = [sum(c[k] for c in counts) for k in ("a", "r")]
    return min((c["fold"] for c in counts if 0 < c["a"] < every[0] and 0 < c["r"] < every[1]), default=None)


def judge(pages: DataFrame, url: str = "url", rules=RULES, split: int = SPLIT) -> DataFrame:
    """pages with host, path, rule, score and verdict. Columns of pages that have one of these names are replaced."""
    df = with_rules(pages, url, rules)
    fold = F.pmod(F.xxhash64("body"), F.lit(FOLDS))
    ruled = df.where("rule IS NOT NULL").select((F.col("ruled") == "allow").alias("accepted"), "body", fold.alias("fold"))
    held = _held_out(ruled)
    model = train(ruled.where(F.col("fold") != held) if held is not None else ruled, split)
    if not model.knows_both():
        return df.withColumns({"score": F.lit(0.0), "verdict": F.coalesce("ruled", F.lit("allow"))}).drop("body", "ruled")
    scores = model.scores(df.select("body"))
    edge = calibrate(with_scores(ruled.where(F.col("fold") == held) if held is not None else ruled, scores))
    said = F.when((F.col("body") == "") | (F.col("score") >= edge), "allow").otherwise("block")
    return with_scores(df, scores).withColumn("verdict", F.coalesce("ruled", said)).drop("body", "ruled")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
