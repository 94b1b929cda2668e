"""The feed as a stream: each micro-batch of raw items is a run, and touches only the buckets of its own items.

State is the stored feed (`FeedStore`), with the status of sources and the verdicts beside it. A batch reads the
buckets of its ids for what is known of them. Of all other items it reads only the columns by which look-ups are
due and titles are compared; of these, items that are looked up or lose their title to an item of the batch are
written anew with it. Expiry needs no writing: an item that retention or a filter drops at one time stays dropped, so
rows that were over at the version before count as absent, and go when their bucket is next written.

Batch n is version n, made from the newest version before it, so a batch that is repeated after a failure writes the
same version again. `now` of a batch is the newest `seen_at` of its items. Sources of a stream are no full
listings: nothing is gone because a batch does not show it. Apart from that a batch equals a run of `refresh_feed`.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import FeedConfig
from ..functions.text import norm_title
from ..operators.enrich import lookup_candidates, lookup_deadlines
from ..operators.merge import DEDUPED_KINDS, dedupe_cross_source, feed_filters, feed_order, first_per_id, merge_feed, retain, sort_feed
from ..plans.feed import read_items
from ..sources.store import FeedStore
from ..storage import discard, stored

STATUS = "source_id string, state string, consecutive_failures int"


def _live(items: DataFrame, now: datetime, cfg: FeedConfig) -> DataFrame:
    return feed_filters(retain(items, now, cfg.retain_days, cfg.default_retain_days), now, cfg.min_impact)


def _known(store: FeedStore, version: int | None, cfg: FeedConfig, sources: DataFrame, like: DataFrame, buckets=None) -> DataFrame:
    """The items of a version that its run left in the feed, of sources that are on; with the columns of `like` before the first."""
    on = sources.where("enabled = true").select(F.col("id").alias("source")).distinct()
    if version is None:
        return like.limit(0)
    return _live(store.items(version, store.schema(version), buckets), store.now(version), cfg).join(on, "source", "left_semi")


def _places(store: FeedStore, *ids: DataFrame) -> set[int]:
    """The buckets of ids: at most one row for each bucket comes to the driver."""
    out: set[int] = set()
    for df in ids:
        out |= {r["b"] for r in df.select(store.bucket("id").alias("b")).distinct().collect()}
    return out


def merge_batch(raw: DataFrame, store: FeedStore, version: int, sources: DataFrame, now: datetime, cfg: FeedConfig, pages: DataFrame | None = None, verdicts: DataFrame | None = None) -> None:
    """Write the version that a batch of raw items makes of the newest version before it."""
    base = store.latest(before=version)
    status = store.table(base, "status")
    status = status if status is not None else raw.sparkSession.createDataFrame([], STATUS)
    before = store.table(base, "verdicts")
    got = read_items(raw, sources, status, now, cfg, pages, verdicts=before if before is not None else verdicts)
    at = F.lit(now).cast("timestamp")
    fresh = first_per_id(got.fresh)
    unseen = fresh.withColumns({"first_seen": at, "last_seen": at, "deadline_checked": F.lit(None).cast("timestamp"), "call_closed": F.lit(None).cast("boolean")})
    own = _known(store, base, cfg, sources, unseen, _places(store, fresh))
    merged = stored(merge_feed(fresh, own, now, cfg.recheck_days).withColumn("carried", F.lit(False)), "merged")
    scratch = [got.fresh, merged]
    columns = [c for c in merged.columns if c != "carried"]
    others = _known(store, base, cfg, sources, unseen).join(merged.select("id"), "id", "left_anti").withColumn("carried", F.lit(True))
    if pages is not None:
        order = ["id", "url", "kind", "deadline", "apply_closed", "open_posting", "deadline_checked", "first_seen", "carried", "source_ord", "part_ord", "item_ord"]
        every = merged.select(*order).unionByName(others.select(*order))
        due = stored(lookup_candidates(every, now, cfg, feed_order(every)).select("id"), "due")
        asked = merged.unionByName(others.join(F.broadcast(due), "id", "left_semi").select(*merged.columns))
        merged = stored(lookup_deadlines(asked, pages, now, cfg, feed_order(asked)), "looked-up")
        scratch += [due, merged]
    changed = _live(merged, now, cfg)
    key = ["kind", "_title"]
    titles = lambda df: df.where(F.col("kind").isin(*DEDUPED_KINDS)).withColumn("_title", norm_title(F.col("title")))
    rivals = titles(_live(others, now, cfg).join(merged.select("id"), "id", "left_anti")).join(titles(changed).select(*key).distinct(), key, "left_semi").select(*changed.columns)
    rivals = stored(rivals, "rivals")
    best = stored(dedupe_cross_source(changed.unionByName(rivals)), "best")
    touched = stored(merged.select("id").unionByName(rivals.join(best.select("id"), "id", "left_anti").select("id")), "touched")
    buckets = _places(store, touched)
    stay = _live(_known(store, base, cfg, sources, unseen, buckets), now, cfg).join(touched, "id", "left_anti")
    rows = best.join(touched, "id", "left_semi").select(*columns).unionByName(stay.select(*columns))
    tables = {"status": got.status, **({"verdicts": got.verdicts} if got.verdicts is not None else {})}
    store.commit(version, rows, now, buckets, base, tables)
    discard(*scratch, rivals, best, touched)


def stream_feed(raw: DataFrame, sources: DataFrame, path: str, checkpoint: str, cfg: FeedConfig | None = None, pages: DataFrame | None = None, verdicts: DataFrame | None = None, trigger: dict | None = None, buckets: int = 64) -> StreamingQuery:
    """Starts the stream. raw: raw items with source_id, source_ord, item_ord and seen_at; pages (url, html): bodies for
    look-ups; verdicts: those to begin with, for adverts of loose boards."""
    cfg = cfg or FeedConfig()
    store = FeedStore(raw.sparkSession, path, buckets)

    def one(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max("seen_at").alias("t")).first()["t"]
        if newest is not None:
            merge_batch(batch.drop("seen_at"), store, number, sources, newest.replace(tzinfo=UTC), cfg, pages, verdicts)

    return raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_feed(store: FeedStore, sources: DataFrame, cfg: FeedConfig | None = None, version: int | None = None) -> DataFrame:
    """The feed of a version (the newest one, if None), in order; `carried`: not in the batch that made it."""
    version = store.latest() if version is None else version
    if version is None:
        raise ValueError(f"no version of a feed under {store.path}")
    items = _known(store, version, cfg or FeedConfig(), sources, None)
    return sort_feed(items.withColumn("carried", F.col("last_seen") < F.lit(store.now(version)).cast("timestamp")))
