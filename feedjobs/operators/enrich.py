"""Look-ups on the pages of items: advert verdicts and deadlines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FeedConfig
from ..functions.dates import deadline_column
from ..functions.text import has_any, matched_terms, page_text
from ..storage import stored
from .keys import take_budget

LOOKED_UP_KINDS = ("job", "course", "event")


def _with_terms(df: DataFrame, terms) -> DataFrame:
    return df.withColumn("summary", F.concat_ws(" ", "summary", terms))


def apply_verdicts(items: DataFrame, verdicts: DataFrame, now: datetime, cfg: FeedConfig) -> tuple[DataFrame, DataFrame]:
    """(kept, to verify). A strong term in the title keeps an item; a cached verdict of the current version keeps
    it with the terms found then, or drops it; the rest is to be verified."""
    live = verdicts.where((F.lit(now).cast("timestamp") - F.col("at") < F.expr(f"INTERVAL {cfg.verdict_days} DAYS")) & (F.col("v") == cfg.verdict_version))
    live = live.select("link", F.col("ok").alias("_ok"), F.col("terms").alias("_terms"))
    df = items.join(live, "link", "left").withColumn("_strong", has_any(F.coalesce("title", F.lit("")), cfg.strong_terms))
    kept = df.where(F.col("_strong") | F.coalesce("_ok", F.lit(False)))
    kept = _with_terms(kept, F.when(~F.col("_strong"), F.col("_terms")))
    todo = df.where(~F.col("_strong") & F.col("_ok").isNull())
    return (x.select(*items.columns) for x in (kept, todo))


def verify_adverts(todo: DataFrame, pages: DataFrame, now: datetime, cfg: FeedConfig) -> tuple[DataFrame, DataFrame]:
    """(kept, new verdicts) of the items whose page (url, html) is there: strong terms in the text from the title on."""
    body = pages.select(F.col("url").alias("link"), F.col("html").alias("_html"))
    df = todo.join(body, "link").withColumn("_text", page_text(F.col("_html"))).drop("_html")  # only pages of these items are cleaned
    start = F.greatest(F.lit(1), F.expr("instr(_text, title)"))
    df = df.withColumn("_found", matched_terms(F.substring("_text", start, F.lit(cfg.verify_chars)), cfg.strong_terms)).drop("_text")
    df = stored(df, "verified")  # read for what is kept and for the verdicts
    terms = F.array_join("_found", ", ")
    verdicts = df.select("link", F.lit(cfg.verdict_version).alias("v"), (F.size("_found") > 0).alias("ok"), terms.alias("terms"), F.lit(now).cast("timestamp").alias("at")).dropDuplicates(["link"])
    return _with_terms(df.where(F.size("_found") > 0), terms).select(*todo.columns), verdicts


def lookup_candidates(feed: DataFrame, now: datetime, cfg: FeedConfig, order) -> DataFrame:
    """The items whose page is to be read for a deadline in this run."""
    unset = lambda c: ~F.coalesce(F.col(c), F.lit(False)) if c in feed.columns else F.lit(True)
    at = F.lit(now).cast("timestamp")
    due = F.col("deadline_checked").isNull() | (at - F.col("deadline_checked") > F.expr(f"INTERVAL {cfg.recheck_days} DAYS")) if "deadline_checked" in feed.columns else F.lit(True)
    df = feed.where(F.col("kind").isin(*LOOKED_UP_KINDS) & F.col("deadline").isNull() & unset("apply_closed") & unset("open_posting") & due)
    return take_budget(df, cfg.lookup_budget, order)


def lookup_deadlines(feed: DataFrame, pages: DataFrame, now: datetime, cfg: FeedConfig, order=("id",)) -> DataFrame:
    """feed with the deadlines that the pages (url, html) of its due items state. Of a passed deadline a
    programme keeps that its intake closed, an event ahead that its call closed; anything else takes it (and is
    dropped by the feed's filters). Only the pages of the bounded list are parsed."""
    at = F.lit(now).cast("timestamp")
    todo = lookup_candidates(feed, now, cfg, list(order)).select("id", "url")
    found = pages.join(F.broadcast(todo), "url").select("id", deadline_column(F.col("html"), now).alias("_found"))
    looked = todo.select("id").join(found.groupBy("id").agg(F.min("_found").alias("_found")), "id", "left").withColumn("_looked", F.lit(True))
    df = feed.join(F.broadcast(looked), "id", "left")
    event, starts = F.col("kind") == "event", F.col("starts")
    use = F.when(~(event & F.coalesce(F.col("_found") > starts, F.lit(False))), F.col("_found"))
    df = df.withColumn("_use", use)
    past = F.coalesce(F.col("_use") < at, F.lit(False))
    flag = lambda c, when: F.when(when, F.lit(True)).otherwise(F.col(c) if c in feed.columns else F.lit(None).cast("boolean"))
    closed_course, closed_call = past & (F.col("kind") == "course"), past & event & starts.isNotNull()
    checked = F.col("deadline_checked") if "deadline_checked" in feed.columns else F.lit(None).cast("timestamp")
    return df.withColumns(
        {
            "deadline": F.when(F.col("_use").isNotNull() & ~closed_course & ~closed_call, F.col("_use")).otherwise(F.col("deadline")),
            "apply_closed": flag("apply_closed", closed_course),
            "call_closed": flag("call_closed", closed_call),
            "deadline_checked": F.when(F.col("_looked"), at).otherwise(checked),
        }
    ).drop("_found", "_looked", "_use")
