"""What a job does once for each page or body must not grow with rows beside it; told from plans, as small tables don't show it."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

from feedjobs.operators import discover as D
from feedjobs.plans import queries as Q
from feedjobs.sources import bodies as B

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().treeString()


def test_sitemap_is_judged_before_its_urls_are_rows(spark, tmp_path):
    spark.createDataFrame([("https://a/1.xml", "<loc>https://a/geodesy/1</loc>")], "url string, body string").write.parquet(f"{tmp_path}/b")
    df = B.urls_from_sitemaps(spark.read.parquet(f"{tmp_path}/b"))
    above, below = plan(df).split("Generate", 1)
    assert "RLIKE" not in above and "RLIKE" in below


def test_deadlines_are_read_once_and_behind_the_join(spark):
    text = plan(Q.follow_apply_links(spark, SF))
    assert text.count("ArrowEvalPython [helper(") == 1
    assert "ArrowEvalPython" not in text.split("BroadcastHashJoin [href", 1)[-1]


def test_event_pages_read_each_text_once_in_all_tasks(spark):
    text = plan(Q.event_pages(spark, SF))
    assert text.count("helper(") == 2, "one range and one deadline"
    assert "RoundRobinPartitioning" in text


def test_links_are_tested_behind_the_frontier(spark, tmp_path):
    pages, links, seeds = Q._graph(spark, SF)
    links.write.parquet(f"{tmp_path}/links")
    frontier = seeds.select("site", "site_host", F.col("url").alias("from_url"))
    text = plan(D.follow(F.broadcast(frontier), spark.read.parquet(f"{tmp_path}/links"), D.Selection(Q.CrawlConfig(), D.programme_priority), 0))
    assert "RLIKE" in text and "RLIKE" not in text.split("Generate", 1)[-1]


def test_buckets_select_the_same_pages(spark, monkeypatch):
    few = sorted(map(tuple, Q.select_pages(spark, SF).collect()))
    monkeypatch.setattr(D, "SMALL_FRONTIER", 0)
    assert few and sorted(map(tuple, Q.select_pages(spark, SF).collect())) == few


def test_event_job_reads_no_page_for_a_deadline_twice(spark):
    now = datetime(2026, 12, 1, tzinfo=UTC)
    html = F.concat(F.lit("<p>Deadline: "), F.col("id"), F.lit(" March 2027</p>"))
    pages = spark.range(1, 9).select(F.col("id").cast("string").alias("url"), html.alias("html"))
    aux = pages.select(F.lit("s").alias("site"), "url", Q.deadline_column(F.col("html"), now).alias("deadline"), F.col("url").alias("ord"))
    text = plan(aux.join(spark.range(1, 9).select(F.col("id").cast("string").alias("url")), "url").where("deadline IS NOT NULL"))
    assert text.count("helper(") == 1
