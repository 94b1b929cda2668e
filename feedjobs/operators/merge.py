"""The feed over time: merge, carry forward, retain, filter, deduplicate, view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_title
from .classify import ONE_DAY
from .keys import first_per_key

#: What a run learns about an item by looking at its page; kept while the check is recent.
LOOKUP_COLUMNS = ("deadline_checked", "deadline", "apply_closed", "call_closed")
DEDUPED_KINDS = ("job", "event", "course")


def _at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp")


def first_per_id(fresh: DataFrame) -> DataFrame:
    """Of items with one id the first by source, part and place."""
    return first_per_key(fresh, ["id"], ["source_ord", "part_ord", "item_ord"])


def merge_feed(fresh: DataFrame, previous: DataFrame, now: datetime, recheck_days: int = 3) -> DataFrame:
    """fresh (one row per id) with first_seen of the feed before, last_seen = now, and what look-ups found
    less than recheck_days ago."""
    known = [c for c in LOOKUP_COLUMNS if c in previous.columns]
    old = previous.select("id", F.col("first_seen").alias("_first_seen"), *[F.col(c).alias(f"_{c}") for c in known])
    df = fresh.join(old, "id", "left").withColumns({"first_seen": F.coalesce("_first_seen", _at(now)), "last_seen": _at(now)})
    recent = F.coalesce(_at(now) - F.col("_deadline_checked") <= F.expr(f"INTERVAL {recheck_days} DAYS"), F.lit(False)) if "deadline_checked" in known else F.lit(False)
    for c in known:
        kept = F.when(recent, F.col(f"_{c}"))
        df = df.withColumn(c, F.coalesce(c, kept) if c in fresh.columns else kept)
    return df.drop("_first_seen", *[f"_{c}" for c in known])


def carry_forward(merged: DataFrame, previous: DataFrame, status: DataFrame, sources: DataFrame, full_listing_types: Sequence[str]) -> DataFrame:
    """merged and, behind it, the items of the feed before that stay: not found anew, source still enabled, and
    source no full listing that was read in this run. The sets of sources are small; Spark broadcasts them by size."""
    enabled = sources.where("enabled = true").select(F.col("id").alias("source"), "type")
    read = status.where("state = 'ok'").select(F.col("source_id").alias("source"))
    gone = enabled.where(F.col("type").isin(*full_listing_types)).join(read, "source", "left_semi").select("source")
    stay = previous.join(enabled.select("source").distinct(), "source", "left_semi").join(gone, "source", "left_anti").join(merged.select("id"), "id", "left_anti")
    return merged.withColumn("carried", F.lit(False)).unionByName(stay.withColumn("carried", F.lit(True)), allowMissingColumns=True)


def retain(df: DataFrame, now: datetime, retain_days: Mapping[str, int], default: int = 45) -> DataFrame:
    """Items seen within the window of their kind."""
    days = F.create_map(*[F.lit(x) for kv in retain_days.items() for x in kv]) if retain_days else F.lit(None).cast("map<string,int>")
    window = F.coalesce(F.try_element_at(days, F.col("kind")), F.lit(default))
    return df.where(_at(now) - F.col("last_seen") <= F.make_dt_interval(window))


def feed_filters(df: DataFrame, now: datetime, min_impact: int = 25) -> DataFrame:
    """A call later than the start of its event is no deadline; low-impact papers, ended events and passed
    deadlines go (an event with an end stays until it is over)."""
    event = F.col("kind") == "event"
    late = event & F.coalesce(F.col("deadline") > F.col("starts"), F.lit(False))
    df = df.withColumn("deadline", F.when(~late, F.col("deadline")))
    impact = F.col("impact") if "impact" in df.columns else F.lit(None).cast("int")
    df = df.where((F.col("kind") != "paper") | (F.coalesce(impact, F.lit(0)) >= min_impact))
    df = df.where(~(event & F.coalesce(F.col("ends") + F.expr(ONE_DAY) < _at(now), F.lit(False))))
    return df.where(F.col("deadline").isNull() | (F.col("deadline") >= _at(now)) | (event & F.col("ends").isNotNull()))


def feed_order(df: DataFrame) -> list[Column]:
    """Newest first; ties in the order of sources and of items, carried items behind."""
    have = [c for c in ("carried", "source_ord", "part_ord", "item_ord") if c in df.columns]
    return [F.desc("first_seen"), *[F.asc_nulls_last(c) for c in have], F.asc("id")]


def sort_feed(df: DataFrame) -> DataFrame:
    return df.orderBy(*feed_order(df))


def dedupe_cross_source(df: DataFrame, kinds: Sequence[str] = DEDUPED_KINDS) -> DataFrame:
    """One job, event or course for each title: the first in feed order with a deadline, else the first.

    The choice is a minimum over (has no deadline, feed order), combined before the shuffle, so titles that
    thousands of items share do not gather in a task; the chosen ids then select the rows."""
    cols = df.columns
    order = [c for c in ("carried", "source_ord", "part_ord", "item_ord") if c in cols]
    never = 2**63 - 1
    place = [-F.unix_micros("first_seen"), *[F.coalesce(F.col(c).cast("long"), F.lit(never)) for c in order], F.col("id")]
    rank = F.struct(F.col("deadline").isNull().alias("none"), *[p.alias(f"o{i}") for i, p in enumerate(place)])
    keyed = df.where(F.col("kind").isin(*kinds)).select("kind", norm_title(F.col("title")).alias("_title"), rank.alias("_rank"))
    chosen = keyed.groupBy("kind", "_title").agg(F.min("_rank").alias("r")).select(F.col(f"r.o{len(place) - 1}").alias("id"))
    rest = df.where(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)))
    return df.where(F.col("kind").isin(*kinds)).join(chosen, "id", "left_semi").unionByName(rest).select(*cols)


def refresh_verdicts(old: DataFrame, new: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """Verdicts of the last days, those of this run in place of older ones of the same link."""
    live = old.where(_at(now) - F.col("at") < F.expr(f"INTERVAL {days} DAYS")).withColumn("_new", F.lit(0))
    both = live.unionByName(new.withColumn("_new", F.lit(1)))
    best = F.max_by(F.struct(*[c for c in old.columns if c != "link"]), F.struct("_new", "at"))
    return both.groupBy("link").agg(best.alias("v")).select("link", "v.*").select(*old.columns)


def feed_view(df: DataFrame, now: datetime, include_undated: bool = False, new_days: int = 7) -> DataFrame:
    """What a reader sees: is_new; jobs, courses and events without a deadline only on request; papers by impact."""
    df = df.withColumn("is_new", _at(now) - F.col("first_seen") <= F.expr(f"INTERVAL {new_days} DAYS"))
    if not include_undated:
        df = df.where(~F.col("kind").isin(*DEDUPED_KINDS) | F.col("deadline").isNotNull())
    impact = F.coalesce("impact", F.lit(0)) if "impact" in df.columns else F.lit(0)
    return df.orderBy(F.desc(F.when(F.col("kind") == "paper", impact).otherwise(0)), *feed_order(df))
