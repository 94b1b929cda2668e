"""The source catalogue and its rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SOURCE_KINDS, SOURCE_TYPES
from ..functions.urls import expand_since


def source_violations(sources: DataFrame) -> DataFrame:
    """id, problem: one row for each broken rule of an enabled source; the first problem of each source only."""
    on = sources.where("enabled = true").withColumn("_id", F.trim(F.coalesce("id", F.lit(""))))
    counts = on.groupBy("_id").agg(F.count("*").alias("_n"))
    on = on.join(counts, "_id", "left")
    scheme = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^([a-zA-Z][a-zA-Z0-9+.-]*)://[^/\s]+", 1))
    problem = (
        F.when(F.col("_id") == "", "is missing its stable id")
        .when(F.col("_n") > 1, "Duplicate enabled source id")
        .when(F.trim(F.coalesce("name", F.lit(""))) == "", "is missing a name")
        .when(scheme == "", "has an invalid URL")
        .when(scheme != "https", "must use HTTPS")
        .when(~F.coalesce("type", F.lit("")).isin(*SOURCE_TYPES), "has unsupported type")
        .when(F.col("kind").isNotNull() & ~F.col("kind").isin(*SOURCE_KINDS), "has unsupported kind")
    )
    return on.select(F.col("_id").alias("id"), problem.alias("problem")).where("problem IS NOT NULL").distinct()


def validate_sources(sources: DataFrame) -> DataFrame:
    """The enabled sources; raises when there are none or a rule is broken. The catalogue is a small table."""
    enabled = sources.where("enabled = true")
    if enabled.isEmpty():
        raise ValueError("No enabled sources configured")
    broken = source_violations(sources).orderBy("id", "problem").limit(20).collect()
    if broken:
        raise ValueError("; ".join(f"Enabled source {r['id']}: {r['problem']}" for r in broken))
    return enabled


def with_since(sources: DataFrame, now, url: str = "url") -> DataFrame:
    """Placeholders `{since:N}` of the URLs filled for the run at `now`."""
    return sources.withColumn(url, expand_since(F.col(url), F.lit(now).cast("timestamp")))
