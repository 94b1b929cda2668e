"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over everything that the stage before it kept.
All but the last return the columns of documents; their decisions take effect: rejected documents and
repeated lines are gone, one document of each near-duplicate group is left, documents that the mix takes
several times are there several times, and one that it takes in part holds only the words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedjobs.llm import linededup, mixing, nearjoin, packing, quality
from feedjobs.llm.shared import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines all go are left out, like those that had no text."""
    kept = linededup.dedup_lines(docs.select(*COLUMNS))
    # through an array, so that the filter is not pushed below the rewriting of texts and repeats it
    return _documents(kept.withColumn("_left", F.explode(F.array(F.col("text") != ""))).where("_left"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearjoin.keep_first(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by a number of their own, as doc_id may be null or repeated; equal rows are interchangeable."""
    docs = materialise(docs.select(*COLUMNS, F.xxhash64("text", "lang", "source").alias("_same"), F.monotonically_increasing_id().alias("_row")), "mix-rows")
    taken = mixing.mix(docs, keep=("_same", "_row")).where("taken > 0").select("_row", "size", "taken")
    return _documents(mixing.repeat_documents(docs.join(taken, "_row")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenise(docs.select("doc_id", "text"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokenising and packing can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
