"""Snapshot files in and out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import FeedStore


def read_items(spark: SparkSession, path: str, item_schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of the `items` array of snapshot files, with item_ord, the place in the file."""
    reader = spark.read.option("multiLine", True)
    if item_schema is not None:
        item = T.StructType.fromDDL(item_schema) if isinstance(item_schema, str) else item_schema
        reader = reader.schema(T.StructType([T.StructField("items", T.ArrayType(item))]))
    return reader.json(path).select(F.posexplode("items").alias("item_ord", "item")).select("item_ord", "item.*")


def read_keyed(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """Rows of files that hold one JSON object keyed by id or URL."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"map<string,struct<{value_schema}>>")
    return whole.select(F.explode(parsed).alias(key, "_v")).select(key, "_v.*")


def write_feed(feed: DataFrame, path: str, now: datetime, retain_days: int = 45, status: DataFrame | None = None, verdicts: DataFrame | None = None) -> int:
    """The feed as a new version of the store at path, with the source status and the advert verdicts beside it. `feed`
    may read the version before: that stays as it is until this one is whole."""
    store = FeedStore(feed.sparkSession, path)
    tables = {name: df for name, df in (("status", status), ("verdicts", verdicts)) if df is not None}
    version = 1 + (-1 if store.latest() is None else store.latest())
    store.commit(version, feed, now, tables=tables, retain_days=retain_days)
    return version


def read_feed(spark: SparkSession, path: str) -> dict[str, DataFrame | None]:
    """feed, run, status and verdicts of the newest version at path (None where it has none)."""
    store = FeedStore(spark, path)
    version = store.latest()
    feed = store.items(version, store.schema(version)) if version is not None else None
    return {"feed": feed, **{name: store.table(version, name) for name in ("run", "status", "verdicts")}}


def run_summary(items: DataFrame, site: str | None = None, deadline: str = "deadline") -> DataFrame:
    """Rows and rows with a deadline, in all or for each site."""
    df = items.groupBy(site) if site else items.groupBy()
    return df.agg(F.count("*").alias("n_items"), F.count(deadline).alias("n_with_deadline"))
