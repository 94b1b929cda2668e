"""Items from fetched bodies: feeds, API payloads, pages, listings, sitemaps.

Each function takes a DataFrame with a column that holds the body and returns one row per item with the other
columns of the input, item_ord (place within the body) and the fields of a raw item.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import deadline_column, first_date_column, parse_date_range
from ..functions.text import clean_html, first_capture, squeeze, tag_text
from ..functions.urls import _resolve, resolve_url
from ..operators.keys import first_per_key

SUMMARY_CHARS = 400


def _exploded(df: DataFrame, body: str, blocks: Column, name: str = "_block") -> DataFrame:
    """A row per block; the wide body is dropped at once."""
    keep = [c for c in df.columns if c not in (body, "item_ord", name)]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(blocks).alias("item_ord", name))


def _first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def items_from_feed(df: DataFrame, body: str = "body") -> DataFrame:
    """RSS and Atom entries. Regular expressions, so that malformed XML still gives its whole entries."""
    rows = _exploded(df, body, F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?is)<(item|entry)\b.*?</\1>"), F.lit(0)))
    b = F.col("_block")
    date = _first_filled(*[tag_text(b, t) for t in ("pubDate", "published", "updated", "dc:date")])
    summary = F.left(_first_filled(*[tag_text(b, t) for t in ("description", "summary", "content")]), F.lit(SUMMARY_CHARS))
    link = _first_filled(first_capture(b, r"(?i)<link\b[^>]*href=[\"']([^\"']+)[\"'][^>]*/?>"), tag_text(b, "link"))
    return rows.withColumns({"title": tag_text(b, "title"), "link": link, "date": date, "summary": summary}).drop("_block")


_NAMED = "array<struct<display_name:string>>"
_WORKS = (
    "results array<struct<display_name:string,title:string,doi:string,id:string,publication_date:string,cited_by_count:int,fwci:double,"
    "citation_normalized_percentile:struct<is_in_top_10_percent:boolean>,primary_location:struct<source:struct<display_name:string>>,"
    f"keywords:{_NAMED},concepts:{_NAMED}>>"
)


def items_from_works(df: DataFrame, body: str = "body", concepts: int = 8) -> DataFrame:
    """Papers of a scholarly works payload; keywords and the first concepts become the summary."""
    rows = _exploded(df, body, F.from_json(body, _WORKS)["results"], "w")
    names = lambda c: F.transform(F.coalesce(c, F.array().cast(_NAMED)), lambda x: x["display_name"])
    about = F.array_join(F.concat(names(F.col("w.keywords")), F.slice(names(F.col("w.concepts")), 1, concepts)), ", ")
    return rows.withColumns(
        {
            "title": _first_filled(F.col("w.display_name"), F.col("w.title")),
            "link": _first_filled(F.col("w.doi"), F.col("w.id")),
            "date": F.coalesce("w.publication_date", F.lit("")),
            "cited": F.coalesce("w.cited_by_count", F.lit(0)),
            "fwci": F.col("w.fwci"),
            "top10": F.coalesce("w.citation_normalized_percentile.is_in_top_10_percent", F.lit(False)),
            "venue": F.coalesce("w.primary_location.source.display_name", F.lit("")),
            "summary": F.left(about, F.lit(SUMMARY_CHARS)),
        }
    ).drop("w")


_JOBS = "stellenangebote array<struct<titel:string,beruf:string,arbeitgeber:string,refnr:string,aktuelleVeroeffentlichungsdatum:string,modifikationsTimestamp:string,arbeitsort:struct<ort:string>>>"


def url_component(col: Column) -> Column:
    """Percent-encoding of a URL component as browsers do it."""
    out = F.replace(F.url_encode(col), F.lit("+"), F.lit("%20"))
    for code, plain in (("%7E", "~"), ("%28", "("), ("%29", ")"), ("%21", "!"), ("%27", "'")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def items_from_job_api(df: DataFrame, body: str = "body", link_base: str = "https://www.arbeitsagentur.de/jobsuche/jobdetail/") -> DataFrame:
    rows = _exploded(df, body, F.from_json(body, _JOBS)["stellenangebote"], "j")
    employer = F.when(F.coalesce("j.arbeitgeber", F.lit("")) != "", F.concat(F.lit(" – "), F.col("j.arbeitgeber"))).otherwise("")
    filled = F.filter(F.array("j.beruf", "j.titel"), lambda x: F.coalesce(x, F.lit("")) != "")
    return rows.withColumns(
        {
            "title": F.concat(_first_filled(F.col("j.titel"), F.col("j.beruf")), employer),
            "link": F.concat(F.lit(link_base), url_component(F.coalesce("j.refnr", F.lit("undefined")))),
            "date": _first_filled(F.col("j.aktuelleVeroeffentlichungsdatum"), F.col("j.modifikationsTimestamp")),
            "summary": F.array_join(filled, ", "),
            "location": F.coalesce("j.arbeitsort.ort", F.lit("")),
        }
    ).drop("j")


_ADS = "results array<struct<id:string,title:string,redirect_url:string,company:struct<display_name:string>,location:struct<display_name:string>,created:string,description:string>>"


def items_from_job_ads(df: DataFrame, body: str = "body", country: str = "country", phrase: str = "phrase", order: str = "call_ord") -> DataFrame:
    """Ads of search payloads: the first of each ad id over all calls, tags stripped."""
    rows = _exploded(df, body, F.from_json(body, _ADS)["results"], "a").where(F.coalesce("a.redirect_url", F.lit("")) != "")
    rows = first_per_key(rows.withColumn("ad_id", F.col("a.id")), ["ad_id"], [order, "item_ord"])
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")
    place = F.filter(F.array(F.col("a.location.display_name"), F.upper(country)), lambda x: F.coalesce(x, F.lit("")) != "")
    return rows.withColumns(
        {
            "title": bare(F.col("a.title")),
            "url": F.col("a.redirect_url"),
            "org": F.coalesce("a.company.display_name", F.lit("")),
            "location": F.array_join(place, ", "),
            "posted": F.coalesce("a.created", F.lit("")),
            "summary": F.left(bare(F.col("a.description")), F.lit(SUMMARY_CHARS)),
            "query": F.concat_ws(":", country, phrase),
        }
    ).drop("a")


# ------------------------------------------------------------------ structured data of pages

# The types of structured data that become items.
JSONLD_TYPES = ("JobPosting", "Event", "EducationEvent", "Course", "EducationalOccupationalProgram", "ScholarlyArticle", "NewsArticle")
_JSONLD_ROW = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "link", "date", "summary", "deadline", "location")]))
_SCRIPT = re.compile(r"<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.I | re.S)


def _pick(node: dict, *names: str) -> str:
    return next((str(node[n]) for n in names if node.get(n)), "")


def _listed(value: object) -> list:
    return value if isinstance(value, list) else [] if value in (None, "") else [value]


def _nodes(root: object) -> Iterator[dict]:
    """Objects of a block of structured data: containers are opened before the object itself."""
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += reversed(node)
        elif isinstance(node, dict):
            inner = [node.get("@graph"), [e.get("item") or e if isinstance(e, dict) else e for e in _listed(node.get("itemListElement"))]]
            bare = {k: v for k, v in node.items() if k not in ("@graph", "itemListElement")}
            if any(inner):
                todo += [bare, inner[1], inner[0]]
            else:
                yield bare


def _jsonld_items(page: str | None, base: str | None) -> list[dict]:
    out = []
    for block in _SCRIPT.findall(page or ""):
        try:
            nodes = list(_nodes(json.loads(block)))
        except (ValueError, RecursionError):
            continue
        for n in nodes:
            if not set(map(str, _listed(n.get("@type")))) & set(JSONLD_TYPES):
                continue
            place = next(iter(_listed(n.get("jobLocation") or n.get("location"))), {})
            place = place if isinstance(place, dict) else {}
            address = place.get("address") if isinstance(place.get("address"), dict) else {}
            link = _resolve(_pick(n, "url", "@id"), base)
            row = {
                "title": _pick(n, "title", "name", "headline"),
                "link": link,
                "date": _pick(n, "datePosted", "startDate", "datePublished"),
                "summary": _pick(n, "description"),
                "deadline": _pick(n, "validThrough", "applicationDeadline", "endDate"),
                "location": _pick(address, "addressLocality") or _pick(place, "name") or _pick(address, "addressCountry"),
            }
            if row["title"] and row["link"]:
                out.append(row)
    return out


@F.pandas_udf(_JSONLD_ROW)
def _jsonld_udf(pages: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([_jsonld_items(p, b) for p, b in zip(pages, bases, strict=True)])


def items_from_jsonld(df: DataFrame, body: str = "body", base_url: str = "url") -> DataFrame:
    """Items of the structured data of pages; only pages that hold such a block reach the helper."""
    found = _jsonld_udf(F.when(F.contains(F.lower(body), F.lit("ld+json")), F.col(body)), F.col(base_url))
    rows = _exploded(df.where(F.contains(F.lower(body), F.lit("ld+json"))), body, found, "x")
    cut = lambda c: F.left(clean_html(F.col(c)), F.lit(SUMMARY_CHARS))
    out = rows.withColumns({"title": clean_html(F.col("x.title")), "link": F.col("x.link"), "date": F.col("x.date"), "summary": cut("x.summary"), "deadline": F.col("x.deadline"), "location": clean_html(F.col("x.location"))})
    return out.drop("x").where("title != ''")


_ANCHOR = r"(?is)<a\b[^>]*?href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"


def anchors(df: DataFrame, body: str = "body", base_url: str = "url", max_text: int = 200) -> DataFrame:
    """All anchors of pages: item_ord, href (absolute, null if invalid) and text."""
    whole = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(_ANCHOR), F.lit(0))
    rows = _exploded(df, body, whole, "_a")
    rows = rows.withColumn("_href", F.regexp_extract("_a", _ANCHOR, 1)).withColumn("text", F.left(clean_html(F.regexp_extract("_a", _ANCHOR, 2)), F.lit(max_text)))
    return rows.withColumn("href", resolve_url(F.col("_href"), F.col(base_url))).drop("_a", "_href")


def items_from_links(df: DataFrame, body: str = "body", base_url: str = "url", include: str | None = None, min_len: int = 12, max_len: int = 300, page_key: str | None = None) -> DataFrame:
    """Anchors as items: text of min_len to max_len characters, an optional test of "URL text", the first of each URL on a page."""
    rows = anchors(df, body, base_url, 1_000_000).where(F.char_length("text").between(min_len, max_len) & F.col("href").isNotNull())
    if include:
        rows = rows.where(F.concat_ws(" ", "href", "text").rlike(f"(?i){include}"))
    rows = first_per_key(rows, [page_key or base_url, "href"], ["item_ord"])
    return rows.withColumnsRenamed({"text": "title", "href": "link"}).withColumns({"date": F.lit(""), "summary": F.lit("")})


def page_title(html: Column) -> Column:
    return clean_html(_first_filled(first_capture(html, r"(?i)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']+)"), first_capture(html, r"(?is)<h1[^>]*>(.*?)</h1>"), first_capture(html, r"(?is)<title[^>]*>(.*?)</title>")))


def item_from_page(df: DataFrame, now: datetime, body: str = "body", url: str = "url", title: str | None = None, tag: str | None = None, location: str | None = None) -> DataFrame:
    """The page as one item. title, tag and location name columns of the source, if given."""
    html = F.coalesce(body, F.lit(""))
    about = clean_html(_first_filled(first_capture(html, r"(?i)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']+)"), first_capture(html, r"(?i)<meta[^>]+property=[\"']og:description[\"'][^>]+content=[\"']([^\"']+)")))
    given = lambda c: F.coalesce(c, F.lit("")) if c else F.lit("")
    return df.withColumns(
        {
            "item_ord": F.lit(0),
            "title": _first_filled(given(title), page_title(html)),
            "link": F.col(url),
            "date": F.lit(""),
            "summary": F.trim(F.concat(about, F.lit(" "), given(tag))),
            "deadline": deadline_column(html, now),
            "location": given(location),
        }
    ).drop(body)


# ------------------------------------------------------------------ listings


@dataclass(frozen=True)
class ListingProfile:
    """How to cut listing pages into blocks and read the fields of a block. Patterns have one group."""

    split: str
    title: str
    link: str
    link_base: str = ""
    summary: str | None = None
    location: str | None = None
    posted: str | None = None
    deadline: str | None = None
    when: str | None = None
    min_title: int = 1
    first_by_link: bool = False
    max_block: int | None = None


# The patterns of the known listings.
EVENT_CALENDAR = ListingProfile(
    split=r"<tr class=['\"]", when=r"(?is)<td\b([^>]*>.*?)(?=<td\b)", title=r"(?is)<td\b.*?<td\b[^>]*>(?:\s|<img[^>]*>)*(.*?)(?:<br\s*/?>|<td\b|\z)",
    link=r"(?i)href=['\"]\s*(https?:[^'\"\s]+)", summary=r"(?is)<p>(.*?)</p>", location=r"(?is)<td\b.*?<td\b.*?<td\b([^>]*>.*?)(?:<td\b|\z)",
)
JOB_SEARCH = ListingProfile(
    split=r'<div class="j-search-result__result', link=r'<a href="(/job/[^"]+)">', link_base="https://www.jobs.ac.uk", title=r'<a href="/job/[^"]+">\s*([^<]+?)\s*</a>',
    summary=r'j-search-result__employer">\s*<b>([^<]+)<', location=r"<div>Location:\s*([^<]+)<", deadline=r'date--blue\s*">([^<]+)<',
)
RESEARCH_PORTAL = ListingProfile(
    split=r'(?=<a[^>]+href="(?:https://euraxess\.ec\.europa\.eu)?/jobs/\d+")', link=r'<a[^>]+href="(?:https://euraxess\.ec\.europa\.eu)?(/jobs/\d+)"', link_base="https://euraxess.ec.europa.eu",
    title=r"(?s)<a[^>]+>(.*?)</a>", summary=r"(?s)(.{0,300})", location=r"(?i)Work Locations?:?\s*(.{3,80}?)(?:Research Field|Researcher Profile|Funding|Application Deadline|$)",
    posted=r"(?i)Posted on:?\s*(\d{1,2} \w+ \d{4})", deadline=r"(?i)Application Deadline:?\s*([^()]{6,40})", min_title=13, first_by_link=True, max_block=6000,
)
#: Profiles whose labelled fields are read from the text of a block rather than from its markup.
_LABELLED = (RESEARCH_PORTAL,)


def items_from_listing(df: DataFrame, profile: ListingProfile, now: datetime, body: str = "body", tag: str | None = None, page_key: str = "url") -> DataFrame:
    """Items of listing pages by a profile. A block without title and link (and date, if the profile has one) is no item."""
    blocks = F.split(F.coalesce(body, F.lit("")), profile.split, -1)
    rows = _exploded(df, body, F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))))
    b = F.left("_block", F.lit(profile.max_block)) if profile.max_block else F.col("_block")
    labelled = squeeze(F.regexp_replace(b, "<[^>]+>", " ")) if profile in _LABELLED else b
    read = lambda p, c=b: clean_html(F.regexp_replace(first_capture(c, p), "^[^<]*>", " ") if p and p.startswith("(?is)<td") else first_capture(c, p)) if p else F.lit("")
    path = first_capture(b, profile.link)
    rows = rows.withColumns(
        {
            "title": read(profile.title),
            "link": F.when(path != "", F.concat(F.lit(profile.link_base), path)).otherwise(""),
            "summary": read(profile.summary, labelled),
            "location": read(profile.location, labelled),
            "date": first_capture(labelled, profile.posted) if profile.posted else F.lit(""),
        }
    ).where((F.char_length("title") >= profile.min_title) & (F.col("link") != ""))
    if profile.when:
        rows = rows.withColumn("_day", read(profile.when)).withColumn("_when", parse_date_range(F.col("_day"))).where("_when IS NOT NULL").drop("_day")
        rows = rows.withColumns({"starts": F.col("_when.start"), "ends": F.col("_when.end"), "date": F.date_format("_when.start", "yyyy-MM-dd'T'HH:mm:ss'Z'")}).drop("_when")
        longer = F.concat_ws(": ", "title", "summary")
        rows = rows.withColumn("title", F.when((F.col("summary") != "") & ~F.contains("title", F.col("summary")), F.left(longer, F.lit(160))).otherwise(F.col("title")))
    rows = rows.withColumn("deadline", first_date_column(first_capture(labelled, profile.deadline), now) if profile.deadline else F.lit(None).cast("timestamp"))
    if profile is JOB_SEARCH:
        rows = rows.withColumn("summary", F.concat(F.col("summary"), F.lit(". "), F.coalesce(tag, F.lit("")) if tag else F.lit("")))
    if profile is RESEARCH_PORTAL:
        rows = rows.withColumn("location", F.left(F.regexp_replace("location", r"(?i)^Number of offers:?\s*\d+,?\s*", ""), F.lit(80)))
    rows = rows.drop("_block")
    return first_per_key(rows, [page_key, "link"], ["item_ord"]) if profile.first_by_link else rows


# ------------------------------------------------------------------ sitemaps

# Fixed value: words by which pages of the topic are told from their URL.
TOPIC_URL = r"(?i)(geomatic|geodes|geoinform|geospatial|remote[-_ ]?sensing|photogramm|earth[-_ ]?observ|[-_/]gis[-_/.]|(?<![a-z])lidar|cartograph|geograph|geoscien|surveying|spatial[-_ ]?(data|analysis|science))"


def urls_from_sitemaps(df: DataFrame, body: str = "body", topic: str = TOPIC_URL, skip: str = r"\.(pdf|jpg|png|zip)$", max_children: int = 8) -> DataFrame:
    """loc, is_index: sitemaps named by an index (the first max_children that are not compressed), or page URLs
    with a topic word and no skipped path."""
    text = F.coalesce(body, F.lit(""))
    keep = [c for c in df.columns if c != body]
    locs = F.regexp_extract_all(text, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    index = text.rlike("(?i)<sitemapindex")
    chosen = F.when(index, F.slice(F.filter(locs, lambda x: ~F.endswith(x, F.lit(".gz"))), 1, max_children)).otherwise(F.filter(locs, lambda x: x.rlike(topic) & ~x.rlike(skip)))
    parsed = df.select(*keep, index.alias("is_index"), chosen.alias("_locs"))  # before the rows: a test beside them would scan the body for each
    return parsed.select(*keep, "is_index", F.posexplode("_locs").alias("item_ord", "loc"))


def sitemaps_from_robots(df: DataFrame, body: str = "body") -> DataFrame:
    """sitemap: the URLs that robots bodies announce."""
    keep = [c for c in df.columns if c != body]
    return df.select(*keep, F.posexplode(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))).alias("item_ord", "sitemap"))


# ------------------------------------------------------------------ rows of other jobs as raw items


def adapt_discovered(df: DataFrame, kind: str) -> DataFrame:
    """Programmes, events, job ads or curated rows as raw items."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    has = lambda c: c in df.columns
    if kind == "discovered":
        cols = {"title": F.col("title"), "link": F.col("url"), "date": F.lit(""), "summary": F.concat(text("summary"), F.lit(" "), text("university")), "deadline": F.col("deadline"), "location": F.concat_ws(", ", "university", "country")}
    elif kind == "adzuna":
        cols = {"title": F.col("title"), "link": F.col("url"), "date": F.col("posted"), "summary": F.concat(text("org"), F.lit(". "), text("summary")), "deadline": F.lit(None).cast("string"), "location": F.col("location")}
    elif kind == "discovered-events":
        cols = {"title": F.col("title"), "link": F.col("url"), "date": F.col("starts"), "starts": F.col("starts"), "ends": F.col("ends"), "summary": F.col("host"), "deadline": F.col("deadline"), "location": F.col("host")}
    elif kind == "curated":
        filled = F.filter(F.array(text("org"), text("summary")), lambda x: x != "")
        starts = F.col("starts") if has("starts") else F.lit(None).cast("string")
        ends = F.col("ends") if has("ends") else F.lit(None).cast("string")
        no_deadline = text("deadline") == ""
        cols = {
            "title": F.col("title"), "link": F.col("url"), "date": text("posted"), "summary": F.array_join(filled, ". "), "deadline": F.col("deadline"),
            "starts": starts, "ends": F.coalesce(ends, starts), "location": _first_filled(text("location"), text("org")), "item_kind": F.col("kind"), "open_posting": (F.col("kind") == "job") & no_deadline,
        }
    else:
        raise ValueError(f"unknown kind: {kind}")
    return df.select(*[F.col(c) for c in df.columns if c in ("source_id", "source_ord", "item_ord")], *[c.alias(n) for n, c in cols.items()])


def union_sources(*dfs: DataFrame) -> DataFrame:
    """All items in one table. Of one page, pass the items of structured data before those of links."""
    numbered = [df.withColumn("part_ord", F.lit(i)) for i, df in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
