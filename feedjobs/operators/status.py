"""Health of sources: what each read found, failures, pauses."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "state": "string", "last_checked": "timestamp", "last_success": "timestamp", "items_found": "long", "items_matched": "long",
    "consecutive_failures": "int", "last_error": "string", "note": "string",
}


def source_stats(raw: DataFrame, kept: DataFrame, source: str = "source_id") -> DataFrame:
    """source_id, items_found, items_matched: one row per source that has raw items."""
    found = raw.groupBy(F.col(source).alias("source_id")).agg(F.count("*").alias("items_found"))
    kept_source = source if source in kept.columns else "source"
    matched = kept.groupBy(F.col(kept_source).alias("source_id")).agg(F.count("*").alias("items_matched"))
    return found.join(matched, "source_id", "left").withColumn("items_matched", F.coalesce("items_matched", F.lit(0)))


def update_status(previous: DataFrame, stats: DataFrame, errors: DataFrame, sources: DataFrame, now: datetime, max_failures: int = 5) -> DataFrame:
    """Status of all enabled sources after a run. stats: sources read (also those without items); errors
    (source_id, error): sources that failed. A source with max_failures failures is paused and not read."""
    at = F.lit(now).cast("timestamp")
    on = sources.where("enabled = true").select(F.col("id").alias("source_id")).distinct()
    have = [c for c in FIELDS if c in previous.columns]
    df = on.join(previous.select("source_id", *have), "source_id", "left")
    df = df.join(stats.select("source_id", F.col("items_found").alias("_found"), F.col("items_matched").alias("_matched")), "source_id", "left")
    df = df.join(errors.select("source_id", F.col("error").alias("_error")), "source_id", "left")
    old = lambda c: F.col(c) if c in have else F.lit(None).cast(FIELDS[c])
    failures = F.coalesce(old("consecutive_failures"), F.lit(0))
    paused, failed, ok = failures >= max_failures, F.col("_error").isNotNull(), F.col("_found").isNotNull()
    read_ok, read_failed = ~paused & ~failed & ok, ~paused & failed
    note = F.lit(f"paused after {max_failures} failures; set consecutive_failures to 0 to retry")
    out = {
        "state": F.when(paused, "paused").when(read_failed, "error").when(read_ok, "ok").otherwise(old("state")),
        "last_checked": F.when(read_ok | read_failed, at).otherwise(old("last_checked")),
        "last_success": F.when(read_ok, at).otherwise(old("last_success")),
        "items_found": F.when(read_ok, F.col("_found")).otherwise(old("items_found")).cast("long"),
        "items_matched": F.when(read_ok, F.col("_matched")).otherwise(old("items_matched")).cast("long"),
        "consecutive_failures": F.when(read_ok, 0).when(read_failed, failures + 1).otherwise(failures).cast("int"),
        "last_error": F.when(read_ok, F.lit(None).cast("string")).when(read_failed, F.left("_error", F.lit(200))).otherwise(old("last_error")),
        "note": F.when(paused, note).when(read_ok, F.lit(None).cast("string")).otherwise(old("note")),
    }
    done = df.select("source_id", *[c.alias(n) for n, c in out.items()])
    return done.where("state IS NOT NULL")
