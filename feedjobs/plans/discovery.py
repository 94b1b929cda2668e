"""Discovery of programmes and of events over stored pages and their links."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EVENT_CRAWL, PROGRAMME_CRAWL, CrawlConfig, FeedConfig
from ..functions.dates import deadline_column, event_range_column
from ..functions.text import clean_page
from ..functions.urls import host, without_fragment
from ..operators.discover import (
    EVENT_SKIP_PATH,
    SKIP_PATH,
    Selection,
    call_deadline,
    event_gate,
    event_links,
    event_pages,
    event_priority,
    first_events,
    follow_apply_links,
    inherit_deadline,
    programme_pages,
    programme_priority,
    select_pages,
)
from ..operators.keys import first_per_key, top_n_per_site
from ..sources.bodies import TOPIC_URL, anchors
from ..storage import stored


def page_links(pages: DataFrame) -> DataFrame:
    """from_url, href (without fragment), text, position: the edges of the link graph."""
    a = anchors(pages.select("url", "html"), body="html", base_url="url", max_text=120)
    return a.where("href IS NOT NULL").select(F.col("url").alias("from_url"), without_fragment(F.col("href")).alias("href"), "text", F.col("item_ord").alias("position"))


def site_seeds(sites: DataFrame, sitemap_urls: DataFrame | None = None, crawl: CrawlConfig = PROGRAMME_CRAWL) -> DataFrame:
    """Home pages (sites: site, home) at depth 0 with priority 1 and, at depth 2 with priority 0, the first sitemap
    URLs (site, loc, item_ord)."""
    homes = sites.select("site", host(F.col("home")).alias("site_host"), F.col("home").alias("url"), F.lit(0).alias("depth"), F.lit(1).alias("prio"))
    if sitemap_urls is None:
        return homes
    first = top_n_per_site(sitemap_urls, "site", crawl.max_sitemap_urls, ["item_ord", "loc"])
    more = first.join(homes.select("site", "site_host").distinct(), "site").select("site", "site_host", F.col("loc").alias("url"), F.lit(2).alias("depth"), F.lit(0).alias("prio"))
    return homes.unionByName(more)


def discover_programmes(pages: DataFrame, links: DataFrame, sites: DataFrame, now: datetime, cfg: FeedConfig | None = None, crawl: CrawlConfig = PROGRAMME_CRAWL, sitemap_urls: DataFrame | None = None) -> DataFrame:
    """sites (site, home, country) -> programmes of the field: site, country, url, title, summary, level, deadline."""
    cfg = cfg or FeedConfig()
    links = stored(links, "page-links")  # read from pages once, for the selection and for application pages
    chosen = select_pages(pages, links, site_seeds(sites, sitemap_urls, crawl), Selection(crawl, programme_priority, SKIP_PATH))
    read = chosen.join(pages.select("url", "html"), "url")
    aux = read.where(F.col("url").rlike(TOPIC_URL)).select("site", "url", deadline_column(F.col("html"), now).alias("deadline"), F.struct("prio", "depth", "url").alias("ord"))
    hosts = sites.select("site", host(F.col("home")).alias("site_host"), "country")
    found = programme_pages(read, cfg, keep_html=True).withColumn("deadline", deadline_column(F.col("html"), now)).drop("html")
    found = stored(found.join(hosts, "site"), "programmes")  # the steps below read it several times
    found = stored(follow_apply_links(found, links, pages, now), "applied")
    found = first_per_key(found.withColumn("_key", F.lower("title")), ["site", "_key"], ["prio", "depth", "url"]).drop("_key")
    found = inherit_deadline(found, aux)
    best = top_n_per_site(found, "site", crawl.max_items, [F.col("deadline").isNull(), "prio", "depth", "url"])
    return best.select("site", "country", "url", "title", "summary", "level", "deadline", F.lit(now).cast("timestamp").alias("discovered_at"))


def discover_events(pages: DataFrame, links: DataFrame, hosts: DataFrame, now: datetime, cfg: FeedConfig | None = None, crawl: CrawlConfig = EVENT_CRAWL) -> DataFrame:
    """hosts (host, url, on_topic) -> events ahead: host, title, url, starts, ends, deadline."""
    cfg = cfg or FeedConfig()
    links = stored(links, "page-links")  # read from pages once, for the selection and for events that pages name
    sites = hosts.select(F.col("host").alias("site"), F.col("url").alias("home"))
    chosen = select_pages(pages, links, site_seeds(sites), Selection(crawl, event_priority, EVENT_SKIP_PATH))
    read = chosen.join(pages.select("url", "html"), "url").withColumnRenamed("site", "host").join(hosts.select("host", "on_topic"), "host")
    place = ["page_ord", "link_ord"]
    keep = ["host", "on_topic", "title", "url", "starts", "ends", "deadline", "ctx", *place]
    own = event_pages(read, now, keep_html=True).withColumn("ctx", F.left("text", F.lit(600)))
    own = event_gate(own.withColumns({"page_ord": F.struct("depth", "url"), "link_ord": F.lit(-1)}), now, cfg.terms)
    own = own.withColumn("deadline", deadline_column(F.col("html"), now)).select(*keep)
    named = event_links(read.drop("html").withColumnRenamed("url", "from_url").join(links, "from_url"))
    asked = pages.withColumnRenamed("url", "href").join(named.select("href").distinct(), "href", "left_semi")
    target = asked.select("href", "html", event_range_column(F.left(clean_page(F.col("html")), F.lit(1500)), now).alias("r")).where("r IS NOT NULL")
    target = target.select("href", "r", deadline_column(F.col("html"), now).alias("deadline"))
    linked = named.join(target, "href")
    linked = linked.select("host", "on_topic", F.col("text").alias("title"), F.col("href").alias("url"), F.col("r.start").alias("starts"), F.col("r.end").alias("ends"), "deadline", F.col("text").alias("ctx"), F.struct("depth", F.col("from_url").alias("url")).alias("page_ord"), F.col("position").alias("link_ord"))
    both = own.unionByName(event_gate(linked, now, cfg.terms, linked=True).select(*keep))
    return call_deadline(first_events(both, crawl.max_items, place), now).select("host", "title", "url", "starts", "ends", "deadline", F.lit(now).cast("timestamp").alias("discovered_at"))


