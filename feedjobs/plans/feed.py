"""Feed refresh: raw items of a run and the feed before -> the feed now, with status and verdicts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FeedConfig
from ..operators.classify import classify
from ..operators.enrich import apply_verdicts, lookup_deadlines, verify_adverts
from ..operators.keys import take_budget
from ..operators.merge import carry_forward, dedupe_cross_source, feed_filters, feed_order, first_per_id, merge_feed, refresh_verdicts, retain, sort_feed
from ..operators.status import source_stats, update_status
from ..storage import stored

SOURCE_COLUMNS = ("name", "type", "kind", "trusted", "on_topic", "tag")


@dataclass
class Refreshed:
    feed: DataFrame
    status: DataFrame
    verdicts: DataFrame | None = None


def with_sources(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Raw items (source_id, ...) with the columns of their enabled source. The catalogue is small; Spark broadcasts it by size."""
    have = [c for c in SOURCE_COLUMNS if c in sources.columns]
    named = {"name": "source_name", "type": "source_type", "kind": "source_kind"}
    cols = sources.where("enabled = true").select(F.col("id").alias("source_id"), *[F.col(c).alias(named.get(c, c)) for c in have])
    return raw.join(cols, "source_id")


def verified_boards(raw: DataFrame, verdicts: DataFrame, pages: DataFrame, now: datetime, cfg: FeedConfig) -> tuple[DataFrame, DataFrame]:
    """Adverts of loose boards: kept by title, verdict or page, and the verdicts of this run."""
    kept, todo = apply_verdicts(raw, verdicts, now, cfg)
    order = [c for c in ("source_ord", "item_ord", "link") if c in raw.columns]
    more, new = verify_adverts(take_budget(todo, cfg.verify_budget, order), pages, now, cfg)
    return kept.unionByName(more), refresh_verdicts(verdicts, new, now, cfg.verdict_days)


@dataclass
class Read:
    """What a run has read: feed items, the status of sources after it, the sources read, verdicts."""

    fresh: DataFrame
    status: DataFrame
    read: DataFrame
    verdicts: DataFrame | None


def read_items(raw: DataFrame, sources: DataFrame, status: DataFrame, now: datetime, cfg: FeedConfig, pages: DataFrame | None = None, errors: DataFrame | None = None, verdicts: DataFrame | None = None) -> Read:
    """Raw items of sources that are on and not paused, verified and classified. Feed items are written once, as
    several steps read them."""
    spark = raw.sparkSession
    paused = status.where(F.col("consecutive_failures") >= cfg.max_failures).select("source_id")
    raw = with_sources(raw.join(paused, "source_id", "left_anti"), sources)
    if verdicts is not None and pages is not None:
        loose = F.coalesce(F.col("source_type").isin(*cfg.verified_types), F.lit(False))
        kept, verdicts = verified_boards(raw.where(loose), verdicts, pages, now, cfg)
        raw = raw.where(~loose).unionByName(kept)
    fresh = stored(classify(raw, cfg, now), "fresh")
    errors = errors if errors is not None else spark.createDataFrame([], "source_id string, error string")
    new_status = update_status(status, source_stats(raw, fresh), errors, sources, now, cfg.max_failures)
    return Read(fresh, new_status, new_status.where(F.col("last_checked") == F.lit(now).cast("timestamp")), verdicts)


def refresh_feed(raw: DataFrame, sources: DataFrame, previous: DataFrame, status: DataFrame, now: datetime, cfg: FeedConfig | None = None, pages: DataFrame | None = None, errors: DataFrame | None = None, verdicts: DataFrame | None = None) -> Refreshed:
    """One run. raw: raw items with source_id, source_ord and item_ord; previous: the feed before; status: the
    status before; pages (url, html): bodies for deadline look-ups; with verdicts (link, v, ok, terms, at)
    adverts of loose boards are verified on their pages too, and those boards count what is left after that.
    Classified items and the feed before look-ups are written once, as several steps read them. Same inputs and
    `now`, same result."""
    cfg = cfg or FeedConfig()
    got = read_items(raw, sources, status, now, cfg, pages, errors, verdicts)
    merged = merge_feed(first_per_id(got.fresh), previous, now, cfg.recheck_days)
    feed = carry_forward(merged, previous, got.read, sources, cfg.full_listing_types)
    if pages is not None:
        feed = stored(feed, "merged")
        feed = lookup_deadlines(feed, pages, now, cfg, feed_order(feed))
    feed = feed_filters(retain(feed, now, cfg.retain_days, cfg.default_retain_days), now, cfg.min_impact)
    return Refreshed(sort_feed(dedupe_cross_source(feed)), got.status, got.verdicts)
