"""Discovery: ranking of institutions, programme and event pages, selection of pages in a link graph."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EXTRA_TERMS, CrawlConfig, FeedConfig
from ..functions.dates import deadline_column, event_range_column
from ..functions.text import clean_page, event_key, first_capture, has_any, squeeze
from ..functions.urls import ancestors, base_domain, host, same_site, url_root
from ..sources.bodies import TOPIC_URL, urls_from_sitemaps
from ..storage import stored, stored_by
from .keys import first_per_key, take_budget, top_n_per_site
from .robots import robots_allows

# Words and paths by which programme and event pages are told from others.
NAV_WORDS = r"(?i)(graduate|master|msc|m\.s\.|programs?|programmes?|degrees?|admission|apply|academics|study|studies|department|school|college|faculty|fachbereich|studium|studiengang)"
DEGREE_WORDS = r"(?i)\b(M\.?\s?Sc\.?|M\.?\s?S\.?|M\.?\s?A\.?|B\.?\s?S\.?|B\.?\s?A\.?|MEng|Master|Masters|Master['’]s|graduate certificate|graduate program(me)?|PhD|Ph\.D\.|doctoral|degree|program(me)?|major|certificate|Studiengang|Bachelor|B\.?\s?Sc\.?|undergraduate)\b"
GENERIC_PROGRAMME = r"(?i)(abschluss|studienberatung|postgraduate study|undergraduate study|homeland security|online degree and certificate programs)|^(contact|faq|how to apply|apply|admission|admissions|application|applying|requirements|factsheet|timeline|courses?( and timeline)?|career|careers|research|overview|home|laptop|fees|tuition|scholarships?|news|stories|story|events?|people|staff|about|welcome|department of .*|school of .*|college of .*)\b"
NO_PROGRAMME = r"(?i)\b(minor|day|seminar|stories|story)\b"
SKIP_PATH = r"(?i)(/news|/agenda|/evenemang|/eventi|/actualit|/notizi|/noticia|/artikel|/articles?/|/stories|/story|/presse|/press|/activit|/conferences?/|/features?/|/research/|/a-z-research|/library|/libraries|/bu/|/minors?/|/events?/|/people|/person|/faculty/|/staff|/directory|/profile|/publications?|/blog|/seminar|/colloquium|/calendar|/jobs|/careers|/alumni|/research-?groups?|/labs?/|/projects?/|\.pdf$|\.(jpg|png|zip)$)"
LEVELS = (
    ("doctoral", r"(?i)\b(PhD|Ph\.D\.|doctoral)\b"),
    ("certificate", r"(?i)\b(certificate)\b"),
    ("master", r"\b(M\.?\s?Sc|MS|MA|MEng|Master|Masters|Master['’]s)\b"),
    ("bachelor", r"\b(Bachelor|B\.?\s?Sc|BS|BA|undergraduate)\b"),
)
EVENT_WORDS = r"(?i)(conference|workshop|symposi|congress|congres|kongres|summit|summer school|winter school|forum|assembly|annual meeting|colloquium|webinar|tagung|konferenz|jahrestagung|kolloquium|konferens|konferanse|konferencija|conferenza|conferencia|colloque|simpozij|simpoz|geomatikkdag|geodesi.*dag|dagene|geomatics day|geo ?week|working week)"
NEWS_WORDS = r"(?i)(published|publication|issue|newsletter|press|award|prize|nominee|genomineerd|bekend|hands over|signs|decision|odluka|nyhet|news|obituary|keynote|anchors|user conference|showcases?|held at|recap|report on|photos|gallery|highlights|about our|view our|fragenforum|appointed|elected|membership|job|vacanc|tender|call for (members|nominations)|brojevi|списание|публикуван)"
GENERIC_EVENT = r"(?i)^(events?|calendar|conferences?|workshops?|upcoming events|past events|all events|news|home|read more|more|details|register|registration|call for papers|submit|programme|program)$"
EVENT_NAV = r"(?i)(event|calendar|conference|symposium|congress|workshop|meeting|tagung|veranstaltung|agenda|termine|kalender|news|aktuelles)"
EVENT_SKIP_PATH = r"(?i)\.(pdf|jpe?g|png|zip|docx?|xlsx?)$|/(login|wp-admin|feed)\b"
EVENT_YEARS = r"\b(2026|2027|2028)\b"
APPLY_WORDS = r"(?i)(apply|application|admission|deadline|bewerb)"


# ------------------------------------------------------------------ institutions


def sum_counts(df: DataFrame, key: str = "key", count: str = "count") -> DataFrame:
    return df.groupBy(key).agg(F.sum(count).alias(count))


def top_institutions(df: DataFrame, n: int, count: str = "count", key: str = "key") -> DataFrame:
    return take_budget(df, n, [F.desc(count), F.col(key)])


def rank_institutions(counts: DataFrame, institutions: DataFrame, countries: Sequence[str], candidates: int = 500, top: int = 120) -> DataFrame:
    """name, home, country, score of the most active institutions of education with a home page in the countries.
    The list of candidates is bounded, so it is broadcast to the larger table."""
    best = top_institutions(sum_counts(counts), candidates)
    rows = institutions.where((F.col("type") == "education") & (F.coalesce("homepage_url", F.lit("")) != "") & F.col("country_code").isin(*countries))
    joined = rows.join(F.broadcast(best), F.col("id") == F.col("key"))
    df = joined.select(F.col("display_name").alias("name"), F.col("homepage_url").alias("home"), F.col("country_code").alias("country"), F.col("count").alias("score"))
    return take_budget(df, top, [F.desc("score"), F.col("name"), F.col("home")])


def add_missing(df: DataFrame, extra: DataFrame, url: str = "home") -> DataFrame:
    """df and the rows of extra whose host it does not have yet."""
    known = df.select(host(F.col(url)).alias("_host")).distinct()
    more = extra.withColumn("_host", host(F.col(url))).join(known, "_host", "left_anti").drop("_host")
    return df.unionByName(more, allowMissingColumns=True)


def skip_hosts(df: DataFrame, hosts: Sequence[str], mode: str, url: str = "url") -> DataFrame:
    """Without the rows of listed hosts: `suffix` compares the host and those below it, `substring` the whole URL."""
    if not hosts:
        return df
    if mode == "substring":
        hit = F.exists(F.array(*map(F.lit, hosts)), lambda h: F.contains(F.col(url), h))
    else:
        h = host(F.col(url))
        hit = F.exists(F.array(*map(F.lit, hosts)), lambda s: (h == s) | F.endswith(h, F.concat(F.lit("."), s)))
    return df.where(~F.coalesce(hit, F.lit(False)))


# ------------------------------------------------------------------ programmes


def programme_pages(pages: DataFrame, cfg: FeedConfig, url: str = "url", html: str = "html", keep_html: bool = False) -> DataFrame:
    """pages that describe a degree programme of the field, with title, summary and level in place of html (beside it
    with keep_html, for what is to be read from these pages only)."""
    h = F.coalesce(html, F.lit(""))
    h1 = clean_page(first_capture(h, r"(?is)<h1[^>]*>(.*?)</h1>"))
    og = clean_page(first_capture(h, r"(?i)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']+)"))
    ttl = clean_page(first_capture(h, r"(?is)<title[^>]*>(.*?)</title>"))
    df = pages.withColumns({"_h1": h1, "_og": og, "_ttl": ttl, "summary": F.left(clean_page(first_capture(h, r"(?i)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']+)")), F.lit(220))})
    df = df if keep_html else df.drop(html)
    chosen = F.when(F.char_length("_h1").between(8, 140), F.col("_h1")).otherwise(F.coalesce(F.nullif("_og", F.lit("")), "_ttl"))
    site = r"\s*[|–—-]\s*[^|–—-]{0,60}$"
    tail = F.regexp_extract(chosen, f"({site})", 1)
    title = F.when(tail.rlike("(?i)univers|college|school|institute|hochschule"), F.regexp_replace(chosen, site, "")).otherwise(chosen)
    df = df.withColumns({"_title": title, "_head": F.concat_ws(" ", "_h1", "_og", "_ttl")})
    u, t, head = F.col(url), F.col("_title"), F.col("_head")
    good = has_any(head, [*cfg.strong_terms, *EXTRA_TERMS]) & F.concat_ws(" ", head, u).rlike(DEGREE_WORDS) & (F.char_length(t) >= 8)
    bad = u.rlike(SKIP_PATH) | t.rlike(GENERIC_PROGRAMME) | t.rlike(NO_PROGRAMME) | F.concat_ws(" ", t, u).rlike(r"(?i)studeert|stories?/")
    level = F.lit("")
    for name, pattern in reversed(LEVELS):
        level = F.when(head.rlike(pattern), name).otherwise(level)
    df = df.where(good & ~bad).withColumns({"title": F.left(F.regexp_replace(t, r"\s*<\s.*$", ""), F.lit(140)), "level": level})
    return df.drop("_h1", "_og", "_ttl", "_title", "_head")


def follow_apply_links(programmes: DataFrame, links: DataFrame, pages: DataFrame, now: datetime, n: int = 3) -> DataFrame:
    """programmes (url, site_host, deadline) with the deadline of the first of their n application pages that states one."""
    open_ = programmes.where("deadline IS NULL").select("url", "site_host")
    near = links.where(F.col("text").rlike(APPLY_WORDS)).select(F.col("from_url").alias("url"), "href", "position")
    near = near.join(open_, "url").where(same_site(F.col("href"), F.col("site_host"), "domain"))
    near = top_n_per_site(near, "url", n, ["position"]).select("url", "href", "position")
    found = pages.select(F.col("url").alias("href"), "html").join(near, "href").select("url", "position", deadline_column(F.col("html"), now).alias("_d"))
    best = found.where("_d IS NOT NULL").groupBy("url").agg(F.min_by("_d", "position").alias("_d"))
    return programmes.join(best, "url", "left").withColumn("deadline", F.coalesce("deadline", "_d")).drop("_d")


def inherit_deadline(programmes: DataFrame, aux: DataFrame) -> DataFrame:
    """programmes (site, url, deadline) without a deadline take the first (by ord) of the site's pages (aux: site,
    url, deadline, ord) below them, or above them if longer than the origin and 12 characters.

    Paths meet by equality, not by comparing all of a site: pages below are found at each of their ancestors, where
    the first of them is chosen before the shuffle, and pages above at each ancestor of a programme."""
    open_ = programmes.where("deadline IS NULL").select("site", "url", url_root(F.col("url")).alias("_root")).distinct()
    page = F.struct("ord", F.col("url").alias("_u"), F.col("deadline").alias("_d"))
    a = aux.where("deadline IS NOT NULL AND url IS NOT NULL").select("site", F.col("url").alias("_u"), page.alias("_p"))
    first = lambda df, *keys: df.groupBy(*keys).agg(F.min_by("_p", F.struct("_p.ord", "_p._u")).alias("_p"))
    below = first(a.select("site", F.explode(ancestors(F.col("_u"))).alias("_root"), "_p"), "site", "_root")
    origin_len = F.char_length(F.regexp_extract("_u", r"^(https?://[^/?#]+)", 1))
    long = a.where(F.char_length("_u") > origin_len + 12).select("site", F.regexp_replace("_u", "/$", "").alias("_above"), "_p")
    above = open_.select("site", "url", F.explode(ancestors(F.col("_root"))).alias("_above")).join(first(long, "site", "_above"), ["site", "_above"])
    found = open_.join(below, ["site", "_root"]).select("site", "url", "_p").unionByName(above.select("site", "url", "_p"))
    best = first(found, "site", "url").select("site", "url", F.col("_p._d").alias("_d"))
    return programmes.join(best, ["site", "url"], "left").withColumn("deadline", F.coalesce("deadline", "_d")).drop("_d").select(*programmes.columns)


def keep_unreached(new: DataFrame, previous: DataFrame, stats: DataFrame, site: str, now: datetime | None = None) -> DataFrame:
    """new and the previous rows of sites of which no page was read (stats: site, pages_read, failed). With now,
    rows of sites that just gave no page stay only if they are not over."""
    unread = stats.where((F.col("pages_read") == 0) | F.col("failed")).select(site, "failed").distinct()
    stay = previous.join(unread, site)
    if now is not None:
        stay = stay.where(F.col("failed") | (F.col("ends") + F.expr("INTERVAL 1 DAY") >= F.lit(now).cast("timestamp")))
    return new.unionByName(stay.select(*previous.columns), allowMissingColumns=True)


# ------------------------------------------------------------------ events


def event_pages(pages: DataFrame, now: datetime, html: str = "html", chars: int = 6000, keep_html: bool = False) -> DataFrame:
    """Pages that are an event themselves: title (with a year and an event word), starts, ends, text in place of html
    (beside it with keep_html, for what is to be read from these pages only)."""
    h = F.coalesce(html, F.lit(""))
    title = clean_page(F.coalesce(F.nullif(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit("")), F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    df = pages.withColumn("title", title).where(F.col("title").rlike(EVENT_YEARS) & F.col("title").rlike(EVENT_WORDS))
    df = df.withColumn("text", F.left(clean_page(F.col(html)), F.lit(chars))).withColumn("_r", event_range_column(F.col("text"), now))
    df = df.where("_r IS NOT NULL").withColumns({"starts": F.col("_r.start"), "ends": F.col("_r.end")}).drop("_r")
    return df if keep_html else df.drop(html)


def event_links(links: DataFrame) -> DataFrame:
    """Links (href, text) whose text names an event."""
    t = F.col("text")
    return links.where(F.char_length(t).between(10, 140) & t.rlike(EVENT_WORDS) & ~t.rlike(NEWS_WORDS) & ~t.rlike(GENERIC_EVENT) & ~F.col("href").rlike(EVENT_SKIP_PATH))


def link_context(pages: DataFrame, links: DataFrame, before: int = 250, after: int = 450) -> DataFrame:
    """links (from_url, index, length: place of the anchor in the page's html) with ctx, the text around."""
    p = pages.select(F.col("url").alias("from_url"), "html")
    start = F.greatest(F.lit(1), F.col("index") + 1 - before)
    cut = F.substring("html", start, F.col("index") + 1 - start + F.col("length") + after)
    return links.join(p, "from_url").withColumn("ctx", clean_page(cut)).drop("html")


def event_gate(df: DataFrame, now: datetime, terms: Sequence[str], linked: bool = False) -> DataFrame:
    """Candidates (title, starts, ends, ctx, host, on_topic): three words at least, no generic title, no one-day
    event within three days, and on hubs and company hosts the topic in title or context."""
    at = F.lit(now).cast("timestamp")
    df = df.withColumn("title", F.left(squeeze(F.col("title")), F.lit(160)))
    t = F.col("title")
    one_day = F.to_date("starts") == F.to_date("ends")
    soon = one_day & (F.col("starts") < at + F.expr("INTERVAL 3 DAYS"))
    topic = (F.col("on_topic") & ~F.endswith("host", F.lit(".com"))) | has_any(F.concat_ws(" ", t, "ctx"), terms)
    df = df.where((t != "") & ~t.rlike(GENERIC_EVENT) & (F.size(F.split(t, r"\s+")) >= 3) & ~soon & topic)
    return df.where(F.col("starts") >= at - F.expr("INTERVAL 1 DAY")) if linked else df


def call_deadline(df: DataFrame, now: datetime) -> DataFrame:
    """An event's deadline stays only if it is ahead and not after the start."""
    ok = (F.col("deadline") <= F.col("starts")) & (F.col("deadline") >= F.lit(now).cast("timestamp"))
    return df.withColumn("deadline", F.when(ok, F.col("deadline")))


def first_events(df: DataFrame, n: int = 15, order: Sequence[str] = ("page_ord", "link_ord")) -> DataFrame:
    """The first of each (host, event key), at most n for each host."""
    df = first_per_key(df.withColumn("event_key", event_key(F.col("title"), F.col("starts"))), ["host", "event_key"], list(order))
    return top_n_per_site(df, "host", n, [*order, "event_key"])


def seed_hosts(links: DataFrame, extra: DataFrame, skip: Sequence[str], max_hosts: int = 160) -> DataFrame:
    """host, url, on_topic: the first URL of each host that directory pages link to (links: from_url, href, list_ord,
    seed_ord, link_ord, on_topic), then the configured extra hosts (url, ord)."""
    off = links.where(host(F.col("href")) != host(F.col("from_url"))).select(F.col("href").alias("url"), "on_topic", "list_ord", "seed_ord", "link_ord")
    own = extra.select("url", F.lit(True).alias("on_topic"), F.lit(1 << 20).alias("list_ord"), F.lit(0).alias("seed_ord"), F.col("ord").alias("link_ord"))
    df = off.unionByName(own).where(F.col("url").rlike("^https?:") & ~F.col("url").rlike(EVENT_SKIP_PATH)).withColumn("host", host(F.col("url")))
    df = skip_hosts(df.where("host != ''"), skip, "suffix")
    order = ["list_ord", "seed_ord", "link_ord"]
    return take_budget(first_per_key(df, ["host"], order), max_hosts, [*order, "host"]).select("host", "url", "on_topic")


# ------------------------------------------------------------------ sitemaps


def sitemap_urls(origins: DataFrame, announced: DataFrame, bodies: DataFrame, rules: DataFrame | None = None, agent: str = "*", start: int = 4, reads: int = 12, children: int = 8, topic: str = TOPIC_URL) -> DataFrame:
    """origin, loc, item_ord: the page URLs with a topic word in the sitemaps of each origin (origins: origin).

    Read are, in the order of a queue, the first `start` of the announced ones (announced: origin, sitemap, item_ord)
    and /sitemap.xml, then what sitemaps of sitemaps among them name, `children` each and no compressed ones, level by
    level; each once, `reads` of an origin in all, stored (bodies: url, body) or not, and with rules (see
    `robots_rules`) only those that the agent may read, which then don't count. Bodies are parsed once, into buckets of
    their URL, so a level deals out only its queue, which the limits bound. The upper half of item_ord is the place of
    the sitemap in the queue."""
    parsed = stored_by(urls_from_sitemaps(bodies.select("url", "body"), topic=topic, max_children=children), "url", "sitemaps")
    usual = origins.select("origin", F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.lit(1 << 31).cast("long").alias("pos"))
    named = announced.select("origin", F.col("sitemap").alias("url"), F.col("item_ord").cast("long").alias("pos")).join(origins.select("origin").distinct(), "origin", "left_semi")
    found = top_n_per_site(first_per_key(named.unionByName(usual.distinct()), ["origin", "url"], ["pos"]), "origin", start, ["pos", "url"]).withColumn("parent", F.lit(0))
    seen, level = None, 0
    while level < reads:  # a level reads one sitemap at least
        new = robots_allows(found, rules, agent).where("allowed").drop("allowed") if rules is not None else found
        if seen is not None:
            before = seen.groupBy("origin").agg(F.count("*").alias("before"))
            new = new.join(seen.select("origin", "url"), ["origin", "url"], "left_anti").join(before, "origin")
        else:
            new = new.withColumn("before", F.lit(0))
        place = F.col("before") + F.row_number().over(Window.partitionBy("origin").orderBy("parent", "pos", "url"))
        new = stored(new.withColumn("place", place.cast("int")).where(F.col("place") <= reads).select("origin", "url", "place", F.lit(level).alias("level")), "sitemap-level")
        if new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
        inside = new.join(parsed.rows.where("is_index"), "url").select("origin", F.col("loc").alias("url"), F.col("item_ord").cast("long").alias("pos"), F.col("place").alias("parent"))
        found = first_per_key(inside, ["origin", "url"], ["parent", "pos"])
        level += 1
    if seen is None:
        seen = new
    pages = seen.join(parsed.rows.where("NOT is_index"), "url").select("origin", "loc", (F.shiftleft(F.col("place").cast("long"), 32) + F.col("item_ord")).alias("item_ord"))
    pages = stored(first_per_key(pages, ["origin", "loc"], ["item_ord"]), "sitemap-pages")
    parsed.drop()
    return pages


# ------------------------------------------------------------------ the link graph


def programme_priority(depth: Column) -> Column:
    """Rank of a link (href, text) for the next round; null: not followed."""
    both = F.concat_ws(" ", "href", "text")
    topic, degree = both.rlike(TOPIC_URL), F.concat_ws(" ", "text", "href").rlike(DEGREE_WORDS)
    nav = F.col("text").rlike(NAV_WORDS) & (F.char_length("text") < 40)
    return F.when(topic & degree, 0).when(topic, 1).when(nav, 2 + depth)


def event_priority(depth: Column) -> Column:
    """All pages with a word of event navigation, in the order in which they are found."""
    return F.when(F.concat_ws(" ", "text", "href").rlike(EVENT_NAV), depth + 1)


@dataclass(frozen=True)
class Selection:
    """What `select_pages` needs to know besides the tables."""

    crawl: CrawlConfig
    priority: Callable[[Column], Column]
    skip_path: str = SKIP_PATH


def _same_site(mode: str) -> Column:
    h = host(F.col("href"))
    return (h == F.col("site_host")) | (base_domain(h) == base_domain(F.col("site_host")) if mode == "domain" else F.endswith(h, F.concat(F.lit("."), F.col("site_host"))))


#: Up to so many pages in all budgets together, what a round follows is copied to every task.
SMALL_FRONTIER = 100_000


def follow(frontier: DataFrame, links: DataFrame, how: Selection, depth: int) -> DataFrame:
    """site, site_host, url, depth, prio of what the links of the frontier lead to, each once."""
    out = frontier.join(links, "from_url").select("site", "site_host", F.inline(F.array(F.struct("href", "text"))))  # through an array, so that the tests below are not made of all links
    out = out.withColumn("prio", how.priority(F.lit(depth))).where(F.col("prio").isNotNull() & _same_site(how.crawl.site_mode))
    found = out.select("site", "site_host", F.col("href").alias("url"), F.lit(depth + 1).alias("depth"), "prio").where(~F.col("url").rlike(how.skip_path))
    return found.groupBy("site", "site_host", "url", "depth").agg(F.min("prio").alias("prio"))


def select_pages(pages: DataFrame, links: DataFrame, seeds: DataFrame, how: Selection) -> DataFrame:
    """site, url, depth, prio of the stored pages (url) that each site's budget allows.

    seeds: site, site_host, url, depth, prio. One round per depth: the links (from_url, href, text) of the pages
    reached so far give the next ones; a URL keeps its smallest depth, then its smallest priority. Within a site
    the budget takes pages by priority, depth and URL, and only those are followed. Links and the URLs of pages are
    written to the shared folder once; what each round finds and has chosen is written too. The budgets bound what a
    round follows. Where that is little, it is copied to every task and rounds only scan the links as they were
    written, none is dealt out. Where it is much, links and URLs are written in buckets of what rounds join them by, so a
    round deals out its frontier only. There are at most max_depth rounds."""
    keep = ["site", "site_host", "url", "depth", "prio"]
    little = seeds.select("site").distinct().count() * how.crawl.max_pages <= SMALL_FRONTIER
    edges = links.select("from_url", "href", "text")
    if little:
        urls, edges = stored(pages.select("url"), "page-urls"), stored(edges, "links")
        known = lambda df: stored(df, "found").join(urls, "url").dropDuplicates()  # noqa: E731 - by size, Spark copies what was found or deals out both
    else:
        url_buckets, link_buckets = stored_by(pages.select("url").distinct(), "url", "page_urls"), stored_by(edges, "from_url", "links")
        edges = link_buckets.rows
        known = lambda df: df.join(url_buckets.rows, "url", "left_semi")
    reached = first_per_key(seeds.select(*keep).where(~F.col("url").rlike(how.skip_path)), ["site", "url"], ["depth", "prio"])
    best = lambda df: stored(top_n_per_site(df, "site", how.crawl.max_pages, ["prio", "depth", "url"]).select(*keep), "chosen")
    chosen = best(known(reached))
    for depth in range(how.crawl.max_depth):
        frontier = chosen.where(F.col("depth") == depth).select("site", "site_host", F.col("url").alias("from_url"))
        found = follow(F.broadcast(frontier) if little else frontier, edges, how, depth)
        new = known(found.join(chosen.select("site", "url"), ["site", "url"], "left_anti").select(*keep))
        chosen = best(chosen.unionByName(new.select(*keep)))
    if not little:
        url_buckets.drop()
        link_buckets.drop()
    return chosen.select("site", "url", "depth", "prio")
