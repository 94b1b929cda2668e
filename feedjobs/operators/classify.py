"""From raw items to feed items: match, gate, classify, score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FeedConfig
from ..functions.dates import parse_date
from ..functions.text import any_among, found_terms, has_any, item_id, matched_terms, terms_among

ONE_DAY = "INTERVAL 1 DAY"
#: Column of `scan_terms`.
FOUND = "_found_terms"


def _col(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or a null of its type where an input has none."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _filled(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def as_time(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes).get(name)
    return F.col(name) if kind == "timestamp" else F.col(name).cast("timestamp") if kind == "date" else parse_date(F.col(name)) if kind else F.lit(None).cast("timestamp")


def item_text(df: DataFrame) -> Column:
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce(_col(df, "summary", "string"), F.lit("")))


def scan_terms(df: DataFrame, *lists: Sequence[str]) -> DataFrame:
    """Adds what occurs of all the lists in title and summary, found in one scan; the steps below use it where it is
    there, and else scan for their own list. It goes through a generator, as filters on it would otherwise move
    below it and repeat the scan."""
    every = list(dict.fromkeys(t for terms in lists for t in terms))
    return df.select("*", F.explode(F.array(found_terms(item_text(df), every))).alias(FOUND))


def _any_of(df: DataFrame, terms: Sequence[str]) -> Column:
    return any_among(F.col(FOUND), terms) if FOUND in df.columns else has_any(item_text(df), terms)


def match_terms(df: DataFrame, terms: Sequence[str], text: Column | None = None) -> DataFrame:
    """Adds `matched`; keeps rows with a match or from a source that is on topic as a whole, and with a link."""
    if text is None and FOUND not in df.columns:
        df = scan_terms(df, terms)
    df = df.withColumn("matched", terms_among(F.col(FOUND), terms) if text is None else matched_terms(text, terms))
    on_topic = F.coalesce(_col(df, "on_topic", "boolean"), F.lit(False))
    label = F.coalesce(_filled(_col(df, "tag", "string")), _col(df, "source_name", "string"), F.lit(""))
    df = df.where(((F.size("matched") > 0) | on_topic) & (F.coalesce(_col(df, "link", "string"), F.lit("")) != ""))
    return df.withColumn("matched", F.when(F.size("matched") > 0, F.col("matched")).otherwise(F.array(label)))


def strong_terms(df: DataFrame, cfg: FeedConfig, text: Column) -> DataFrame:
    """Adds `strong`: the terms without the weak ones."""
    return df.withColumn("strong", matched_terms(text, cfg.strong_terms))


def strong_ads(df: DataFrame, cfg: FeedConfig, chars: int = 400) -> DataFrame:
    """Job ads with a strong term in the title or the opening of the summary."""
    return df.where(has_any(F.concat_ws(" ", "title", F.left("summary", F.lit(chars))), cfg.strong_terms))


def over_or_closed(df: DataFrame, now: datetime) -> DataFrame:
    """Drops what is over. A passed deadline is cleared from an event still ahead and from a programme, which
    is then marked as closed; anything else with a passed deadline goes. An unreadable deadline passes."""
    at = F.lit(now).cast("timestamp")
    df = df.withColumns({"_deadline": as_time(df, "deadline"), "_ends": as_time(df, "ends")})
    df = df.where(F.col("_ends").isNull() | (F.col("_ends") + F.expr(ONE_DAY) >= at))
    past = F.coalesce(F.col("_deadline") < at, F.lit(False))
    starts = as_time(df, "starts").isNotNull()
    course = F.coalesce(_col(df, "source_kind", "string") == "course", F.lit(False))
    df = df.where(~past | starts | course)
    df = df.withColumn("apply_closed", F.when(past & ~starts & course, F.lit(True)))
    return df.withColumn("deadline", F.when(~past, F.col("_deadline"))).drop("_deadline", "_ends")


def exclude_terms(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    return df.where(~_any_of(df, terms)) if terms else df


def listing_gate(df: DataFrame, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """Links of listing pages (untrusted html sources of jobs, courses, events) need a word of their kind and a
    title of enough words without an at sign."""
    kind = F.coalesce(_col(df, "source_kind", "string"), F.lit(""))
    gated = (F.coalesce(_col(df, "source_type", "string"), F.lit("")) == "html") & ~F.coalesce(_col(df, "trusted", "boolean"), F.lit(False)) & kind.isin("job", "event", "course")
    word = reduce(lambda acc, k: F.when(kind == k, _any_of(df, kinds[k])).otherwise(acc), [k for k in ("job", "event", "course") if k in kinds], F.lit(True))
    least = F.when(kind == "course", 2).when(F.coalesce(_col(df, "on_topic", "boolean"), F.lit(False)), 3).otherwise(4)
    words = F.size(F.split(F.trim("title"), r"(?U)\s+"))
    return df.where(~gated | (word & (words >= least) & ~F.contains("title", F.lit("@"))))


def open_posting_window(df: DataFrame, now: datetime, days: int = 45) -> DataFrame:
    """A posting without a closing date counts as open for some days after its date."""
    date = as_time(df, "date")
    late = date.isNull() | (F.lit(now).cast("timestamp") - date > F.expr(f"INTERVAL {days} DAYS"))
    return df.where(~(F.coalesce(_col(df, "open_posting", "boolean"), F.lit(False)) & late))


def assign_kind(df: DataFrame, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """The kind of the source; for `auto` or none the first kind whose words occur, else news."""
    own = F.nullif(_filled(_col(df, "source_kind", "string")), F.lit("auto"))
    return df.withColumn("kind", F.coalesce(own, *[F.when(_any_of(df, w), F.lit(k)) for k, w in kinds.items()], F.lit("news")))


def paper_impact(df: DataFrame, venues: Sequence[str], min_impact: int = 25) -> DataFrame:
    """Scores papers by venue, citations, field-weighted impact and top decile; drops those below the minimum."""
    cited = F.coalesce(_col(df, "cited", "int"), F.lit(0))
    fwci = _col(df, "fwci", "double")
    venue = F.coalesce(_col(df, "venue", "string"), F.lit(""))
    top = venue.rlike("(?i)" + "|".join(f"(?:{v})" for v in venues)) if venues else F.lit(False)
    parts = F.when(top, 40.0).otherwise(0.0) + F.least(cited * 4.0, F.lit(40.0)) + F.least(F.coalesce(fwci, F.lit(0.0)) * 8, F.lit(30.0)) + F.when(F.coalesce(_col(df, "top10", "boolean"), F.lit(False)), 20.0).otherwise(0.0)
    paper = F.col("kind") == "paper"
    df = df.withColumns(
        {
            "impact": F.when(paper, F.floor(parts + 0.5).cast("int")),
            "top_venue": F.when(paper, top),
            "cited_by": F.when(paper, cited),
            "fwci": F.when(paper, F.floor(fwci * 10 + 0.5) / 10),
            "venue": F.when(paper, _filled(venue)),
        }
    )
    return df.where(~paper | (F.col("impact") >= min_impact))


def to_feed_item(df: DataFrame, summary_chars: int = 300) -> DataFrame:
    """The columns of the feed."""
    starts = as_time(df, "starts")
    return df.select(
        item_id(F.col("link")).alias("id"),
        "title",
        F.col("link").alias("url"),
        "kind",
        _col(df, "source_id", "string").alias("source"),
        _col(df, "source_name", "string").alias("source_name"),
        as_time(df, "date").alias("published"),
        F.left(F.coalesce(_col(df, "summary", "string"), F.lit("")), F.lit(summary_chars)).alias("summary"),
        as_time(df, "deadline").alias("deadline"),
        starts.alias("starts"),
        F.when(starts.isNotNull(), F.coalesce(as_time(df, "ends"), starts)).alias("ends"),
        _filled(_col(df, "location", "string")).alias("location"),
        "matched",
        *[_col(df, c, t).alias(c) for c, t in (("impact", "int"), ("top_venue", "boolean"), ("cited_by", "int"), ("fwci", "double"), ("venue", "string"), ("apply_closed", "boolean"), ("open_posting", "boolean"))],
        *[_col(df, c, "int").alias(c) for c in ("source_ord", "part_ord", "item_ord")],
    )


def classify(raw: DataFrame, cfg: FeedConfig, now: datetime) -> DataFrame:
    """Raw items with the columns of their source -> feed items. The order of the steps matters: the deadline
    is judged before excluded words, and the gate uses the kind of the source, not of the item. All word lists are
    found in one scan of the text."""
    if "item_kind" in raw.columns:
        raw = raw.withColumn("source_kind", F.coalesce("item_kind", _col(raw, "source_kind", "string")))
    df = match_terms(scan_terms(raw, cfg.terms, cfg.exclude, *cfg.kinds.values()), cfg.terms)
    df = over_or_closed(df, now)
    df = exclude_terms(df, cfg.exclude)
    df = listing_gate(df, cfg.kinds)
    df = open_posting_window(df, now, cfg.open_posting_days)
    df = assign_kind(df, cfg.kinds)
    df = paper_impact(df, cfg.top_venues, cfg.min_impact)
    return to_feed_item(df, cfg.summary_chars)
