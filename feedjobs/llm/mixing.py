"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of all words by its weight, at most `max_epochs` times its own words; what is cut
off goes to the others by weight (water filling). Of its target a source delivers complete epochs first; the
rest is a weighted sample without replacement: every document draws an exponential key divided by its
quality weight, and documents are taken in order of the keys until the budget is reached; the last one
gives just the words that are missing.

The order within a source is found without gathering it: rows are range-partitioned by (source, key), the
word sums of the pieces are added up per source, and a running sum inside each piece starts there. A source
with a third of all rows is spread over as many pieces as its rows need.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; an
empty table gives an empty result; repeated rows are documents of their own. Keys depend on doc_id, the quality weight
and the seed; rows of one key come in order of doc_id, size and text, and rows that agree in all of these are
interchangeable, so reruns agree however the input is partitioned. Other columns pass through `mix` where `keep` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import SYMBOLS
from .shared import materialise, n_words_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def quality_weight(text: Column) -> Column:
    """1 for plain text down to 0.1 for text in which a fifth of all characters are symbols."""
    body = F.coalesce(text, F.lit(""))
    symbols = F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))
    return F.greatest(F.lit(0.1), 1.0 - 5.0 * symbols / F.greatest(F.lit(1), F.char_length(body)))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u from 52 bits of a hash of the id."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (skey, size), one row per document -> skey, source_size, target: one row per source.

    The two windows run over the summed table with one row per source. Sources whose cap is lowest for
    their weight reach it first, so one pass over them in that order finds all that are capped.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    place = Window.partitionBy(F.lit(0)).orderBy("skey")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy(F.col("cap") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "all_words": F.sum("source_size").over(every).cast("double"),
            "all_w": F.sum("w").over(every),
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    capped = F.col("cap") * (F.col("all_w") - F.col("w_before")) <= F.col("w") * (F.col("all_words") - F.col("cap_before"))
    per = per.withColumn("capped", capped)
    sure = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(F.lit(0.0))).over(every)
    per = per.withColumns({"cap_sum": sure("cap"), "w_sum": sure("w")})
    share = F.col("w") * (F.col("all_words") - F.col("cap_sum")) / (F.col("all_w") - F.col("w_sum"))
    return per.select("skey", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(share).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, and the columns named in keep.
    Where rows share key, doc_id, size and text, those columns decide the order."""
    t = F.col(text)
    skey = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))  # keeps code-point order, null last
    key = sampling_key(F.col(doc_id), quality_weight(t), seed)
    sizes = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), skey.alias("skey"), n_words_of(t).alias("size"), key.alias("key"), F.unhex(F.md5(F.coalesce(t, F.lit("")))).alias("tie"), F.monotonically_increasing_id().alias("spread"), *keep), "mix-sizes")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "doc_id", "size", "tie", *keep, "spread"]  # the last one only parts equal rows
    pieces = materialise(sizes.repartitionByRange(n, "skey", *order).withColumn("piece", F.spark_partition_id()), "mix-pieces")
    plan = materialise(targets(sizes, weights, max_epochs), "mix-targets")
    # words in earlier pieces of the same source: one row per piece and source
    sums = pieces.groupBy("skey", "piece").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("skey").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(sums.select("skey", "piece", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")).join(plan, "skey"), "mix-starts")
    inside = Window.partitionBy("skey", "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["skey", "piece"])
    budget = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - F.col("full") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("start") - F.col("inside")))
    return placed.withColumn("full", full).withColumn("taken", (F.col("full") * F.col("size") + part).cast("long")).select("doc_id", "source", "size", "source_size", "target", "taken", *keep)


def repeat_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size and taken -> a row for each time a document is taken; the last may hold only its first words."""
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rest = F.when(F.col("size") > 0, F.pmod(F.col("taken"), F.col("size"))).otherwise(F.lit(0)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), times), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    pattern = F.concat(F.lit("^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){"), F.greatest(F.col("_first"), F.lit(1)).cast("string"), F.lit("}+"))
    first = F.coalesce(F.regexp_substr(F.col(text), pattern), F.col(text))
    return docs.withColumn("_first", F.explode(copies)).withColumn(text, F.when(F.col("_first") > 0, first).otherwise(F.col(text))).drop("_first")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_sql() -> str:
    symbols = f"(length(body) - length(translate(body, '{SYMBOLS}', '')))"
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body,
        coalesce(doc_id::VARCHAR, 'null') || ':{SEED}' AS k FROM documents),
    s AS (SELECT doc_id, body, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
        len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        -ln((('0x' || substr(md5(k), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / greatest(0.1::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * {symbols} / greatest(1, length(body))) AS key FROM d),
    per AS (SELECT skey, sum(size)::DOUBLE AS s, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(skey)) - 1) % 3] AS w
        FROM s GROUP BY skey),
    cum AS (SELECT *, 3 * s AS cap, sum(s) OVER () AS all_words, sum(w) OVER () AS all_w,
        coalesce(sum(3 * s) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before FROM per
        WINDOW b AS (ORDER BY 3 * s / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, cap * (all_w - w_before) <= w * (all_words - cap_before) AS capped FROM cum),
    f AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS cap_sum, sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS w_sum FROM c),
    plan AS (SELECT skey, s::BIGINT AS source_size, CASE WHEN capped THEN cap ELSE w * (all_words - cap_sum) / (all_w - w_sum) END AS target FROM f),
    r AS (SELECT s.*, p.source_size, p.target, floor(p.target)::BIGINT AS budget,
        CASE WHEN p.source_size > 0 THEN floor(p.target)::BIGINT // p.source_size ELSE 0 END AS complete,
        coalesce(sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id NULLS FIRST, size, md5(body) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM s JOIN plan p USING (skey))
    SELECT doc_id, size, source_size, target,
        (complete * size + greatest(0, least(size, budget - complete * source_size - before)))::BIGINT AS taken FROM r
    """
