"""Every registered query of the feed against its SQL, on the smallest tables."""

from datetime import UTC, datetime

import pytest
from conftest import comparable

from feedjobs.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, oracle, name):
    got, want = comparable(Q.QUERIES[name](spark, SF).toPandas()), comparable(oracle(Q.SQL[name], SF))
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "a query without rows shows nothing"


def test_jobs_run(spark):
    feed = Q.refresh_feed(spark, SF).toPandas()
    assert len(feed) and feed["id"].is_unique
    events = Q.discover_events(spark, SF).toPandas()
    assert len(events) and events.groupby("host").size().max() <= 15
    programmes = Q.discover_programmes(spark, SF).toPandas()
    assert set(programmes["level"]) == {"master", "bachelor"} and programmes["deadline"].isna().any() and programmes["deadline"].notna().any()


def test_stream_equals_runs(spark):
    """Three batches with late and repeated items equal three runs of the job, each on the feed of the one before."""
    from datetime import timedelta

    from pyspark.sql import functions as F

    from feedjobs.plans.feed import refresh_feed
    from feedjobs.storage import stored

    got = Q.stream_feed_query(spark, SF)
    rounds = Q.stream_rounds(spark, SF).drop("seen_at")
    pages = Q.table(spark, SF, "documents").select(F.concat(F.lit("https://"), "source", F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("url"), F.col("text").alias("html"))
    at = F.lit(Q.NOW).cast("timestamp")
    empty = Q.M.first_per_id(Q.classified(spark, SF)).limit(0).withColumns({"first_seen": at, "last_seen": at, "deadline_checked": at, "call_closed": F.lit(None).cast("boolean")})
    feed, status = empty, spark.createDataFrame([], "source_id string, state string, consecutive_failures int")
    for i in range(3):
        done = refresh_feed(rounds.where(F.col("round") == i).drop("round"), Q.stream_sources(rounds), feed, status, Q.NOW + timedelta(days=10 * i), Q.CFG, pages)
        feed, status = stored(done.feed, "run"), stored(done.status, "run-status")
    want = feed.select("id", "title", "kind", "source", *[F.unix_seconds(c).alias(c) for c in ("first_seen", "last_seen", "deadline")], "carried")
    rows = [sorted(map(str, map(tuple, df.collect()))) for df in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) > 50
    assert len({r["first_seen"] for r in got.collect()}) > 1 and {r["carried"] for r in got.collect()} == {True, False}


def test_stream_rounds_stay_spread(spark, tmp_path):
    """A round is written by as many tasks as hold it, still makes one batch, and the feed is the same."""
    from pathlib import Path

    def raw_folders():
        return set(Path(spark.conf.get("spark.checkpoint.dir")).glob("stream-*/raw"))

    want = sorted(map(str, map(tuple, Q.stream_feed_query(spark, SF).collect())))
    spark.read.parquet(f"{SF}/documents.parquet").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    before = raw_folders()
    got = sorted(map(str, map(tuple, Q.stream_feed_query(spark, str(tmp_path)).collect())))
    (raw,) = raw_folders() - before
    assert len(list(raw.glob("part-*"))) >= 9, "three rounds in one file each are read by one task each"
    assert sorted(p.name for p in (raw.parent / "checkpoint" / "commits").glob("[0-9]*")) == ["0", "1", "2"]
    assert got == want
