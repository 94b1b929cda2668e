"""The stored feed: versions that are whole or not there, buckets, replays, what is removed."""

import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedjobs.config import FeedConfig
from feedjobs.sources.snapshots import read_feed, write_feed
from feedjobs.sources.store import FeedStore
from feedjobs.storage import shared_dir
from feedjobs.streaming.feed import current_feed, merge_batch

NOW = datetime(2026, 10, 29, tzinfo=UTC)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_run_that_breaks_off_leaves_the_feed_before(spark, tmp_path):
    path = f"{tmp_path}/feed"
    first = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("x"))
    status = spark.createDataFrame([("s", "ok")], "source_id string, state string")
    verdicts = spark.createDataFrame([("l", True)], "link string, ok boolean")
    assert write_feed(first, path, NOW, status=status, verdicts=verdicts) == 0
    got = read_feed(spark, path)
    assert ids(got["feed"]) == ids(first) and got["run"].first()["count"] == 100
    assert got["status"].collect() == status.collect() and got["verdicts"].collect() == verdicts.collect()
    broken = got["feed"].withColumn("x", F.when(F.col("id") == "50", F.raise_error(F.lit("killed")).cast("int")).otherwise(2))
    with pytest.raises(Exception, match="killed"):
        write_feed(broken, path, NOW)
    again = read_feed(spark, path)  # reads and writes one path
    assert {r["x"] for r in again["feed"].collect()} == {1}
    assert write_feed(again["feed"].withColumn("x", F.col("x") + 1).where("id < 50"), path, NOW + timedelta(days=1)) == 1
    done = read_feed(spark, path)
    assert {r["x"] for r in done["feed"].collect()} == {2} and done["run"].first()["count"] == done["feed"].count() and done["status"] is None
    assert write_feed(done["feed"].limit(0), path, NOW) == 2 and read_feed(spark, path)["feed"].count() == 0


def test_only_touched_buckets_are_written_and_old_versions_go(spark, tmp_path):
    store = FeedStore(spark, f"{tmp_path}/feed", buckets=8)
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("x"))
    store.commit(0, rows, NOW)
    b = rows.select(store.bucket().alias("b")).first()["b"]
    for v in range(1, 5):
        own = store.items(v - 1, rows.schema, [b]).withColumn("x", F.lit(v))
        store.commit(v, own, NOW, [b], v - 1)
        assert store.written(v) == {i: v if i == b else 0 for i in range(8)}
    assert store.versions() == [3, 4] and store.items(4, rows.schema).count() == 200
    assert store.items(4, rows.schema).where("x = 4").count() == store.items(3, rows.schema).where("x = 3").count() > 0
    left = {n for n in store._names(store.path)}
    assert left == {"version=0", "version=3", "version=4"} and f"bucket={b}" not in store._names(f"{store.path}/version=0/items")
    store.commit(5, rows.limit(0), NOW, [b], 4)  # a bucket that has no rows any more
    assert store.written(5) == {i: 0 for i in range(8) if i != b}


def batch(spark, rows):
    return spark.createDataFrame(rows, "source_id string, source_ord int, item_ord int, title string, link string, summary string").withColumns({"date": F.lit(""), "deadline": F.lit("")})


def test_a_repeated_batch_writes_the_same_version(spark, tmp_path):
    sources = spark.createDataFrame([("s", "S", "rss", "job", True, False, None, True)], "id string, name string, type string, kind string, trusted boolean, on_topic boolean, tag string, enabled boolean")
    store, cfg = FeedStore(spark, f"{tmp_path}/feed", buckets=4), FeedConfig()
    first = batch(spark, [("s", 0, 0, "GNSS engineer wanted in town", "https://s/1", ""), ("s", 0, 1, "InSAR engineer wanted in town", "https://s/2", ""), ("s", 0, 2, "GIS engineer", "https://s/3", "")])
    late = batch(spark, [("s", 0, 0, "GNSS engineer (wanted) in town", "https://s/9", ""), ("s", 0, 1, "GIS Engineer", "https://s/4", ""), ("s", 0, 2, "Cooking", "https://s/5", ""), ("s", 0, 3, "InSAR engineer wanted in town", "https://s/2", "anew")])
    pages = spark.createDataFrame([("https://s/1", "<p>Application deadline: 15 January 2027</p>"), ("https://s/4", "<p>Closing date: 1 February 2027</p>")], "url string, html string")
    verdicts = spark.createDataFrame([("https://b/5", 2, True, "GNSS", NOW)], "link string, v int, ok boolean, terms string, at timestamp")
    scratch = lambda: {n for n in os.listdir(shared_dir(spark).removeprefix("file:")) if n.startswith(("fresh-", "merged-", "due-", "looked-up-", "rivals-", "best-", "touched-"))}
    before = scratch()
    merge_batch(first, store, 0, sources, NOW, cfg, pages, verdicts)
    assert all(n.startswith(("due-", "rivals-", "touched-")) for n in scratch() - before)  # but for empty tables a batch leaves none
    later = NOW + timedelta(days=5)
    seen = []
    for _ in range(2):  # the second time as after a failure
        merge_batch(late, store, 1, sources, later, cfg, pages)
        feed = current_feed(store, sources, cfg)
        seen.append(sorted((r["url"], str(r["first_seen"]), str(r["deadline"]), r["carried"], r["summary"]) for r in feed.collect()))
    assert seen[0] == seen[1]
    got = {r[0]: r for r in seen[0]}
    # 9 has other words than 1; of 3 and 4, whose titles agree, 4 has a deadline, so 3 is gone though it is not in the batch
    assert set(got) == {"https://s/1", "https://s/2", "https://s/4", "https://s/9"}
    assert got["https://s/1"][3] and got["https://s/1"][2].startswith("2027-01-15") and not got["https://s/2"][3]
    assert got["https://s/2"][1] == str(NOW.replace(tzinfo=None)) and got["https://s/2"][4] == "anew" and got["https://s/4"][1] == str(later.replace(tzinfo=None))
    assert store.table(1, "status").first()["items_found"] == 4 and store.table(1, "verdicts").count() == 1
    # much later: what the run before has dropped as over is not known any more, and new when it comes again
    end = NOW + timedelta(days=200)
    merge_batch(late.where("link = 'https://s/9'"), store, 2, sources, end, cfg)
    merge_batch(first.limit(1), store, 3, sources, end, cfg)
    feed = current_feed(store, sources, cfg).collect()
    assert {(r["url"], r["first_seen"]) for r in feed} == {("https://s/1", end.replace(tzinfo=None)), ("https://s/9", later.replace(tzinfo=None))}
