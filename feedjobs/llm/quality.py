"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

The base counts (words, symbols, repeated lines, repeated 8-word windows) and every ratio are expressions
over one row, so the whole operator is a scan with a projection: no shuffle, no user function.

Defined results: a null or empty text has zero words and fails the base; ratios with an empty denominator
are 0; rows are judged one by one, so ties and repeated rows do not matter; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, strip_spaces, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as was be by are this from or an at he a "
    "le la les de des du et en un une que qui dans pour par sur est pas au avec ce il "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch es "
    "el los las y del se con para no su al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails when `ratio` (a column of `with_ratios`) is below `low` or above `high`."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


#: The threshold table.
RULES = (
    Rule("mean word length", "chars_per_word", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("exclamation marks", "exclaims_per_word", None, 0.5),
    Rule("stop words", "stop_share", 0.02, None),
    Rule("repeated lines", "dup_line_share", None, 0.4),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "n_exclaims", "n_text_lines")


def with_repeated_windows(df: DataFrame, words: str, out: str, width: int = WINDOW) -> DataFrame:
    """Adds `out`: how many words of the array `words` lie in a window of `width` words (a power of two)
    that occurs twice or more in the array.

    Window hashes come from pairwise hashing (words, pairs, fours, eights), one pass over the array for
    each. Only where some hash repeats are the windows sorted to find which; each repeated window then
    adds the words up to the next one, at most `width`. Separate columns keep Spark from evaluating the
    intermediate arrays more than once.
    """
    df, step = df.withColumn("_h1", F.transform(words, lambda w: F.xxhash64(w))), 1
    while step < width:
        h = F.col(f"_h{step}")
        rest = F.greatest(F.size(h) - step, F.lit(0))
        df = df.withColumn(f"_h{2 * step}", F.zip_with(F.slice(h, 1, rest), F.slice(h, step + 1, rest), lambda a, b: F.xxhash64(a, b))).drop(f"_h{step}")
        step *= 2
    h = F.col(f"_h{width}")
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i"))))
    df = df.withColumn("_placed", F.when(F.size(F.array_distinct(h)) < F.size(h), placed)).drop(f"_h{width}")
    p = F.col("_placed")
    alike = F.zip_with(  # a window repeats if a neighbour in sorted order has its hash
        F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(alike, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return df.withColumn(out, F.when(p.isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("_placed")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns COUNTS (long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: (F.char_length(body) - F.char_length(F.translate(body, chars, ""))).cast("long")
    stops = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    docs = docs.withColumn("_w", words_of(F.col(text))).withColumn("_l", F.filter(F.split(body, "\n", -1), lambda x: strip_spaces(x) != ""))
    docs = docs.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.char_length(F.translate(body, SPACES, "")).cast("long"),
            "n_symbols": without(SYMBOLS),
            "n_exclaims": without("!"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_text_lines": F.size("_l").cast("long"),
            "n_stop": F.size(F.filter("_w", lambda w: w.isin(stops))).cast("long"),
        }
    ).drop("_l")
    return with_repeated_windows(docs, "_w", "n_repeat_words").drop("_w")


def with_ratios(df: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "chars_per_word": per("word_chars", "n_words"),
            "symbols_per_word": per("n_symbols", "n_words"),
            "exclaims_per_word": per("n_exclaims", "n_words"),
            "stop_share": per("n_stop", "n_words"),
            "dup_line_share": per("n_dup_lines", "n_text_lines"),
        }
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """True where every rule of the table holds."""
    tests = [F.lit(True)]
    for r in rules:
        tests += [F.col(r.ratio) >= r.low] if r.low is not None else []
        tests += [F.col(r.ratio) <= r.high] if r.high is not None else []
    return reduce(lambda a, b: a & b, tests)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with COUNTS, the ratios, base_failed and kept. Columns of docs that have one of these names are replaced."""
    df = with_ratios(with_counts(docs, text))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with their own columns only.

    The verdict goes through a one-element array: a filter on it stays where it is, while one on the computed
    column would be pushed below all projections, with every one of them written out anew for each use."""
    judged = judge(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), "_text", rules)
    return judged.select("_row", F.explode(F.array("kept")).alias("_good")).where("_good").select("_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))


def judged_sql(source: str) -> str:
    """DuckDB SQL: the rows of `source` (doc_id, text) with all counts, base_failed and kept."""
    tests = " AND ".join(
        f"{r.ratio} {op} {bound!r}" for r in RULES for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None
    )
    return f"""
    WITH body AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM {source}),
    split_up AS (SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM body),
    windows AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS h
        FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM split_up WHERE len(w) > 8)),
    found AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT rid, sum(least(8, i - coalesce(before, i - 8))) AS n
        FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM found) GROUP BY rid),
    counts AS (SELECT s.rid, doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(body) - length(translate(body, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        (length(body) - length(replace(body, '!', '')))::BIGINT AS n_exclaims,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_text_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: x IN ({_STOPS_SQL}))) AS n_stop
        FROM split_up s LEFT JOIN covered c USING (rid)),
    ratios AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS chars_per_word,
        CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
        CASE WHEN n_words > 0 THEN n_exclaims / n_words ELSE 0 END AS exclaims_per_word,
        CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_share,
        CASE WHEN n_text_lines > 0 THEN n_dup_lines / n_text_lines ELSE 0 END AS dup_line_share FROM counts),
    based AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM ratios)
    SELECT *, (NOT base_failed AND {tests}) AS kept FROM based
    """


def op5_sql() -> str:
    return f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({judged_sql('documents')})"
