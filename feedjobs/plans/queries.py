"""Registered queries: every operator on the given tables, with the SQL that says the same.

The tables hold no feed data, so columns play the parts: first lines of documents are titles, order dates are
deadlines, events are items seen over time, and bodies (feeds, payloads, listings, robots files) are built from
columns of the tables by Spark, at the size of the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CrawlConfig, FeedConfig
from ..functions.dates import deadline_column, event_range_column, parse_date, parse_date_range
from ..functions.text import clean_html, event_key, item_id, norm_title, page_text, tag_text
from ..functions.urls import base_domain, host, same_site, url_root
from ..operators import classify as C
from ..operators import discover as D
from ..operators import merge as M
from ..operators.enrich import apply_verdicts, lookup_deadlines, verify_adverts
from ..operators.keys import first_per_key, top_n_per_site
from ..operators.robots import robots_allows, robots_rules
from ..operators.status import source_stats, update_status
from ..sources import bodies as B
from ..sources.catalogue import source_violations, validate_sources, with_since
from ..sources.snapshots import read_feed, read_items, read_keyed, run_summary, write_feed
from ..sources.store import FeedStore
from ..storage import new_folder, stored
from ..streaming.feed import current_feed, stream_feed
from . import discovery as discover_jobs
from . import feed as jobs

TERMS = ("thtion", "ouan", "erha", "menton", "heit", "the", "worthless", "ción", "und", "pathetic")
WEAK = ("the", "und")
KINDS = {"job": ("idiot", "scum", "erthe"), "course": ("des", "les", "que"), "event": ("der", "die", "das"), "paper": ("los", "las")}
CFG = FeedConfig(terms=TERMS, weak_terms=WEAK, exclude=("moron", "clown"), kinds=KINDS)
NOW = datetime(2024, 1, 31, tzinfo=UTC)
ORDERS_NOW = datetime(1997, 6, 1, tzinfo=UTC)
NOW_SQL, ORDERS_NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'", "TIMESTAMP '1997-06-01 00:00:00'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly over the session's partitions: short rows come in one or two tasks, however much is made of each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def seconds(name: str):
    """Whole seconds since 1970, so that both engines compare times as numbers."""
    return F.unix_seconds(F.col(name)).alias(name)


def _has(terms) -> str:
    return "(?i)(?:^|[^\\p{L}])(?:" + "|".join(terms) + ")(?:$|[^\\p{L}])"


def _matched(text: str, terms=TERMS) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{_has([t])}') THEN '{t}' END" for t in terms) + "], lambda x: x IS NOT NULL)"


_ITEMS_SQL = "SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS summary, 'https://' || source || '/' || (doc_id // 2) AS link, source, lang, concat_ws(' ', string_split(text, chr(10))[1], text) AS t FROM documents"


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw items: title = first line, summary = whole text, two documents to a link."""
    d = table(spark, sf_dir, "documents")
    link = F.concat(F.lit("https://"), "source", F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string"))
    return d.select("doc_id", F.split("text", "\n")[0].alias("title"), F.col("text").alias("summary"), link.alias("link"), F.col("source").alias("source_id"), F.col("lang"), F.col("doc_id").alias("item_ord"))


@register(f"SELECT doc_id, array_to_string({_matched('t')}, ',') AS matched FROM ({_ITEMS_SQL}) WHERE len({_matched('t')}) > 0")
def match_terms(spark, sf_dir):
    return C.match_terms(document_items(spark, sf_dir), TERMS).select("doc_id", F.array_join("matched", ",").alias("matched"))


_STRONG = [t for t in TERMS if t not in WEAK]


@register(f"SELECT doc_id, array_to_string({_matched('t', _STRONG)}, ',') AS strong FROM ({_ITEMS_SQL}) WHERE regexp_matches(title || ' ' || left(summary, 200), '{_has(_STRONG)}')")
def strong_ads(spark, sf_dir):
    df = C.strong_ads(document_items(spark, sf_dir), CFG, 200)
    return C.strong_terms(df, CFG, C.item_text(df)).select("doc_id", F.array_join("strong", ",").alias("strong"))


_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{_has(w)}') THEN '{k}'" for k, w in KINDS.items()) + " ELSE 'news' END"
_GATE_SQL = f"(lang <> 'en' OR (regexp_matches(t, '{_has(KINDS['job'])}') AND len(regexp_split_to_array(trim(title), '\\s+')) >= 4 AND NOT contains(title, '@')))"
_CLASSIFIED_SQL = f"""SELECT doc_id, substr(sha1(link), 1, 16) AS id, title, link AS url, source,
    CASE WHEN lang = 'en' THEN 'job' ELSE {_KIND_SQL} END AS kind, left(summary, 300) AS summary, array_to_string({_matched('t')}, ',') AS matched
    FROM ({_ITEMS_SQL}) WHERE len({_matched('t')}) > 0 AND NOT regexp_matches(t, '{_has(CFG.exclude)}') AND {_GATE_SQL} AND (lang = 'en' OR {_KIND_SQL} <> 'paper')"""  # a paper without citations is below the impact


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    en = F.col("lang") == "en"
    raw = document_items(spark, sf_dir).withColumns({"source_type": F.lit("html"), "source_kind": F.when(en, "job"), "source_name": F.col("source_id"), "date": F.lit(""), "deadline": F.lit(""), "source_ord": F.lit(0)})
    return C.classify(raw, CFG, NOW)


@register(f"SELECT id, title, url, source, kind, summary, matched FROM ({_CLASSIFIED_SQL} QUALIFY row_number() OVER (PARTITION BY link ORDER BY doc_id) = 1)")
def feed_items(spark, sf_dir):
    """The flagship: documents become feed items, one per link."""
    df = M.first_per_id(classified(spark, sf_dir))
    return df.select("id", "title", "url", "source", "kind", "summary", F.array_join("matched", ",").alias("matched"))


_NORM_SQL = "left(trim(regexp_replace(regexp_replace(lower(title), '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')), 70)"


@register(f"""WITH c AS (SELECT *, {_NORM_SQL} AS nt FROM ({_CLASSIFIED_SQL} QUALIFY row_number() OVER (PARTITION BY link ORDER BY doc_id) = 1))
    SELECT id, kind, nt AS norm_title FROM c QUALIFY kind NOT IN ('job', 'event', 'course') OR row_number() OVER (PARTITION BY kind, nt ORDER BY (doc_id % 3 <> 0), doc_id) = 1""")
def dedupe_cross_source(spark, sf_dir):
    df = M.first_per_id(classified(spark, sf_dir))
    dated = df.withColumns({"deadline": F.when(F.col("item_ord") % 3 == 0, F.lit(NOW).cast("timestamp")), "first_seen": F.lit(NOW).cast("timestamp")})
    return M.dedupe_cross_source(dated).select("id", "kind", norm_title(F.col("title")).alias("norm_title"))


# ------------------------------------------------------------------ papers, deadlines

_IMPACT_SQL = "floor((CASE WHEN regexp_matches(p_brand, '(?i)(?:^Brand#1)|(?:#25$)') THEN 40.0 ELSE 0 END) + least((p_size % 12) * 4.0, 40) + least(round(p_retailprice) / 500.0 * 8, 30) + (CASE WHEN p_partkey % 7 = 0 THEN 20 ELSE 0 END) + 0.5)::INTEGER"


@register(f"""SELECT p_partkey, {_IMPACT_SQL} AS impact, regexp_matches(p_brand, '(?i)(?:^Brand#1)|(?:#25$)') AS top_venue, (p_size % 12)::INTEGER AS cited_by,
    floor(round(p_retailprice) / 500.0 * 10 + 0.5) / 10 AS fwci FROM part WHERE {_IMPACT_SQL} >= 40""")
def paper_impact(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit("paper").alias("kind"), (F.col("p_size") % 12).cast("int").alias("cited"), (F.round("p_retailprice") / 500.0).alias("fwci"), (F.col("p_partkey") % 7 == 0).alias("top10"), F.col("p_brand").alias("venue"))
    return C.paper_impact(p, ("^Brand#1", "#25$"), 40).select("p_partkey", "impact", "top_venue", "cited_by", "fwci")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items: the order date is the deadline; status says whether it is an event; priority gives the kind."""
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("timestamp")
    kind = F.when(F.col("o_orderkey") % 4 == 0, "event").when(F.col("o_orderkey") % 4 == 1, "course").when(F.col("o_orderkey") % 4 == 2, "job").otherwise("paper")
    event = kind == "event"
    return o.select(
        "o_orderkey", kind.alias("kind"), kind.alias("source_kind"), d.alias("deadline"),
        F.when(event, d + F.expr("make_dt_interval(cast(o_orderkey % 40 - 10 as int))")).alias("starts"), F.when(event, d + F.expr("make_dt_interval(cast(o_orderkey % 40 - 5 as int))")).alias("ends"),
        d.alias("date"), (F.col("o_orderkey") % 5 == 0).alias("open_posting"), (F.col("o_orderkey") % 60).cast("int").alias("impact"), F.col("o_orderkey").cast("string").alias("id"),
    )


_ORDER_ITEMS_SQL = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'event' WHEN 1 THEN 'course' WHEN 2 THEN 'job' ELSE 'paper' END AS kind, o_orderdate::TIMESTAMP AS deadline,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::TIMESTAMP + to_days((o_orderkey % 40 - 10)::INTEGER) END AS starts, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::TIMESTAMP + to_days((o_orderkey % 40 - 5)::INTEGER) END AS ends,
    o_orderkey % 60 AS impact FROM orders"""


@register(f"""WITH i AS ({_ORDER_ITEMS_SQL}), a AS (SELECT *, deadline < {ORDERS_NOW_SQL} AS past FROM i WHERE ends IS NULL OR ends + INTERVAL 1 DAY >= {ORDERS_NOW_SQL})
    SELECT o_orderkey, CASE WHEN NOT past THEN epoch(deadline)::BIGINT END AS deadline, CASE WHEN past AND starts IS NULL AND kind = 'course' THEN true END AS apply_closed
    FROM a WHERE (NOT past OR starts IS NOT NULL OR kind = 'course') AND NOT (o_orderkey % 5 = 0 AND {ORDERS_NOW_SQL} - (deadline) > INTERVAL 45 DAYS)""")
def over_or_closed(spark, sf_dir):
    df = C.over_or_closed(order_items(spark, sf_dir), ORDERS_NOW)
    return C.open_posting_window(df, ORDERS_NOW, 45).select("o_orderkey", seconds("deadline"), "apply_closed")


@register(f"""WITH i AS (SELECT * REPLACE (CASE WHEN kind = 'event' AND deadline > starts THEN NULL ELSE deadline END AS deadline) FROM ({_ORDER_ITEMS_SQL})),
    f AS (SELECT * FROM i WHERE (kind <> 'paper' OR impact >= 25) AND NOT (kind = 'event' AND ends + INTERVAL 1 DAY < {ORDERS_NOW_SQL}) AND (deadline IS NULL OR deadline >= {ORDERS_NOW_SQL} OR (kind = 'event' AND ends IS NOT NULL)))
    SELECT o_orderkey, kind, epoch(deadline)::BIGINT AS deadline, o_orderkey % 10 <= 7 AS is_new FROM f WHERE kind = 'paper' OR deadline IS NOT NULL""")
def feed_view(spark, sf_dir):
    df = order_items(spark, sf_dir).withColumn("first_seen", F.lit(ORDERS_NOW).cast("timestamp") - F.expr("make_dt_interval(cast(o_orderkey % 10 as int))"))
    df = M.feed_view(M.feed_filters(df, ORDERS_NOW, 25), ORDERS_NOW)
    return df.select("o_orderkey", "kind", seconds("deadline"), "is_new")


# ------------------------------------------------------------------ the feed over time: events of users

_SPLIT = "TIMESTAMP '2024-01-20 00:00:00'"


def _event_feeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(previous, fresh, sources, status): an item is a user's events of one kind on one day of the month."""
    e = table(spark, sf_dir, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "source": F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string"))})
    e = e.withColumn("id", F.concat_ws("-", "user_id", "event_type", (F.col("event_id") % 3).cast("string")))
    split = F.expr(_SPLIT)
    cols = ["id", "source", F.col("event_type").alias("kind"), F.col("event_id").alias("item_ord"), F.lit(0).alias("source_ord"), F.lit(0).alias("part_ord")]
    old = e.where(F.col("ts") < split)
    previous = old.groupBy("id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).join(first_per_key(old.select(*cols), ["id"], ["item_ord"]), "id")
    fresh = M.first_per_id(e.where(F.col("ts") >= split).where("user_id % 2 = 0").select(*cols))
    ids = e.select("source").distinct()
    n = F.substring("source", 2, 9).cast("int")
    sources = ids.select(F.col("source").alias("id"), F.when(n % 3 == 0, "html").otherwise("rss").alias("type"), (n != 7).alias("enabled"))
    status = ids.select(F.col("source").alias("source_id"), F.when(n % 5 == 0, "error").otherwise("ok").alias("state"))
    return previous, fresh, sources, status


_MERGED_SQL = f"""WITH e AS (SELECT *, 's' || (user_id % 20) AS source, user_id % 20 AS n, user_id || '-' || event_type || '-' || (event_id % 3) AS id FROM events),
    prev AS (SELECT id, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(source, event_id) AS source, arg_min(n, event_id) AS n, arg_min(event_type, event_id) AS kind FROM e WHERE ts < {_SPLIT} GROUP BY id),
    fresh AS (SELECT id, arg_min(source, event_id) AS source, arg_min(event_type, event_id) AS kind FROM e WHERE ts >= {_SPLIT} AND user_id % 2 = 0 GROUP BY id),
    m AS (SELECT f.id, f.source, f.kind, coalesce(p.first_seen, {NOW_SQL}) AS first_seen, {NOW_SQL} AS last_seen, false AS carried FROM fresh f LEFT JOIN prev p USING (id)),
    kept AS (SELECT id, source, kind, first_seen, last_seen, true AS carried FROM prev WHERE n <> 7 AND NOT (n % 3 = 0 AND n % 5 <> 0) AND id NOT IN (SELECT id FROM fresh)),
    al AS (SELECT * FROM m UNION ALL SELECT * FROM kept)"""


@register(f"""{_MERGED_SQL} SELECT id, source, kind, floor(epoch(first_seen))::BIGINT AS first_seen, floor(epoch(last_seen))::BIGINT AS last_seen, carried FROM al
    WHERE {NOW_SQL} - last_seen <= to_days(CASE kind WHEN 'click' THEN 13 WHEN 'view' THEN 20 ELSE 15 END)""")
def merge_feed(spark, sf_dir):
    previous, fresh, sources, status = _event_feeds(spark, sf_dir)
    feed = M.carry_forward(M.merge_feed(fresh, previous, NOW), previous, status, sources, ("html",))
    feed = M.retain(feed, NOW, {"click": 13, "view": 20}, 15)
    return M.sort_feed(feed).select("id", "source", "kind", seconds("first_seen"), seconds("last_seen"), "carried")


@register(f"""WITH e AS (SELECT 's' || (user_id % 60) AS source_id, user_id % 60 AS n, event_type FROM events),
    st AS (SELECT source_id, count(*) AS f, count(*) FILTER (event_type = 'click') AS m FROM e WHERE n % 6 <> 0 GROUP BY source_id),
    s AS (SELECT DISTINCT source_id, n, n % 7 AS fails FROM e WHERE n % 10 <> 9)
    SELECT source_id, CASE WHEN fails >= 5 THEN 'paused' WHEN n % 6 = 0 THEN 'error' ELSE 'ok' END AS state,
    CASE WHEN fails >= 5 OR n % 6 = 0 THEN 1 ELSE f END AS items_found, CASE WHEN fails >= 5 OR n % 6 = 0 THEN 0 ELSE m END AS items_matched,
    (CASE WHEN fails >= 5 THEN fails WHEN n % 6 = 0 THEN fails + 1 ELSE 0 END)::INTEGER AS consecutive_failures, CASE WHEN fails >= 5 THEN NULL WHEN n % 6 = 0 THEN repeat('x', 200) END AS last_error
    FROM s LEFT JOIN st USING (source_id)""")
def source_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"n": F.col("user_id") % 60}).withColumn("source_id", F.concat(F.lit("s"), F.col("n").cast("string")))
    raw = e.where("n % 6 != 0")
    stats = source_stats(raw, raw.where("event_type = 'click'"))
    every = e.select("source_id", "n").distinct()
    prev = every.select("source_id", F.lit("ok").alias("state"), F.lit(1).cast("long").alias("items_found"), F.lit(0).cast("long").alias("items_matched"), (F.col("n") % 7).cast("int").alias("consecutive_failures"))
    errors = every.where("n % 6 = 0").select("source_id", F.repeat(F.lit("x"), 300).alias("error"))
    sources = every.select(F.col("source_id").alias("id"), (F.col("n") % 10 != 9).alias("enabled"))
    return update_status(prev, stats, errors, sources, NOW).select("source_id", "state", "items_found", "items_matched", "consecutive_failures", "last_error")


# ------------------------------------------------------------------ institutions, sites


@register("""WITH c AS (SELECT l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, key LIMIT 80),
    r AS (SELECT s_name AS name, 'https://www.' || lower(replace(s_name, '#', '-')) || '.edu/' AS home, n_name AS country, n AS score FROM supplier JOIN c ON s_suppkey = key JOIN nation ON s_nationkey = n_nationkey
        WHERE s_suppkey % 3 <> 0 AND n_regionkey < 4 ORDER BY score DESC, name, home LIMIT 30),
    x AS (SELECT s_name AS name, 'https://' || lower(replace(s_name, '#', '-')) || '.edu/x' AS home, 'extra' AS country, NULL::BIGINT AS score FROM supplier WHERE s_suppkey % 4 = 0)
    SELECT * FROM (SELECT * FROM r UNION ALL SELECT * FROM x WHERE name NOT IN (SELECT name FROM r)) WHERE NOT contains(home, '1')""")
def rank_institutions(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.lit(1).alias("count"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.lower(F.replace("s_name", F.lit("#"), F.lit("-")))
    inst = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("display_name"), F.concat(F.lit("https://www."), name, F.lit(".edu/")).alias("homepage_url"), F.col("n_name").alias("country_code"), F.when(F.col("s_suppkey") % 3 != 0, "education").otherwise("company").alias("type"))
    countries = [r[0] for r in table(spark, sf_dir, "nation").where("n_regionkey < 4").select("n_name").collect()]
    ranked = D.rank_institutions(counts, inst, countries, 80, 30)
    extra = s.where("s_suppkey % 4 = 0").select(F.col("s_name").alias("name"), F.concat(F.lit("https://"), name, F.lit(".edu/x")).alias("home"), F.lit("extra").alias("country"))
    return D.skip_hosts(D.add_missing(ranked, extra), ("1",), "substring", "home")


@register("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F'), o_orderkey) <= 3")
def top_n_sites(spark, sf_dir):
    return top_n_per_site(table(spark, sf_dir, "orders"), "o_custkey", 3, [F.col("o_orderstatus") == "F", "o_orderkey"]).select("o_custkey", "o_orderkey")


# ------------------------------------------------------------------ pages

_TEXT_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<nav\\b.*?</nav>|<footer\\b.*?</footer>|<header\\b.*?</header>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;|&#160;', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))"
_DEC = lambda s: f"replace(replace(replace(replace({s}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_CLEAN = lambda s: f"trim(regexp_replace(regexp_replace({_DEC(_DEC(s))}, '<[^>]+>', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


@register(f"""SELECT page_id, sha256({_TEXT_SQL}) AS text_hash, length({_TEXT_SQL})::INTEGER AS n_text, {_CLEAN("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1, {_CLEAN("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages""")
def page_text_query(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    text = page_text(F.col("html"))
    return p.select("page_id", F.sha2(text, 256).alias("text_hash"), F.char_length(text).alias("n_text"), tag_text(F.col("html"), "h1").alias("h1"), tag_text(F.col("html"), "title").alias("title"))


@register(f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?href=["'']([^"'']+)["''][^>]*>.*?</a>', 1)) AS href,
        unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?href=["''][^"'']+["''][^>]*>(.*?)</a>', 1)) AS text, unnest(range(len(regexp_extract_all(html, '(?is)<a\\b[^>]*?href=["'']([^"'']+)["''][^>]*>.*?</a>')))) AS ord FROM pages),
    r AS (SELECT page_id, ord, {_CLEAN('text')} AS title, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS link, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS host FROM a)
    SELECT page_id, title, link, host, array_to_string(string_split(host, '.')[-2:], '.') AS base_domain FROM r WHERE length(title) BETWEEN 6 AND 12 QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY ord) = 1""")
def page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = B.items_from_links(p, "html", "url", min_len=6, max_len=12, page_key="page_id")
    rows = rows.withColumn("host", host(F.col("url"))).where(same_site(F.col("link"), F.col("host"), "domain"))
    return rows.select("page_id", "title", "link", "host", base_domain(F.col("host")).alias("base_domain"))


@register("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS root, substr(sha1(url), 1, 16) AS id FROM pages WHERE NOT regexp_matches(url, '^https?://([^/]*\\.)?example\\.net[/?#]')")
def url_roots(spark, sf_dir):
    p = D.skip_hosts(table(spark, sf_dir, "pages"), ("example.net",), "suffix")
    return p.select("page_id", url_root(F.col("url")).alias("root"), item_id(F.col("url")).alias("id"))


# ------------------------------------------------------------------ dates

_D = "o_orderdate::TIMESTAMP"
_DATE_TEXT = {
    0: (lambda d: F.concat(F.lit("<p>Closing date: "), F.date_format(d, "d MMMM yyyy"), F.lit("</p>")), True),
    1: (lambda d: F.concat(F.lit("<p>Deadline: "), F.date_format(d, "MMMM d, yyyy"), F.lit(" at noon</p>")), True),
    2: (lambda d: F.concat(F.lit("<b>Bewerbungsfrist</b>: "), F.date_format(d, "dd.MM.yyyy")), True),
    3: (lambda d: F.concat(F.lit("Apply by "), F.date_format(d, "yyyy-MM-dd")), True),
    4: (lambda d: F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"x":1},{"validThrough":"'), F.date_format(d, "yyyy-MM-dd"), F.lit('T23:59:59Z"}]}</script>')), True),
    5: (lambda d: F.concat(F.lit("<p>Ordered on "), F.date_format(d, "d MMMM yyyy"), F.lit("</p>")), False),
}
_FIVE = datetime(2000, 1, 1, tzinfo=UTC)


def deadline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose deadline is the order date shifted to a year after 2000 (patterns want 20xx)."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 3653 DAYS")
    html = F.lit(None).cast("string")
    for k, (make, _) in _DATE_TEXT.items():
        html = F.when(F.col("o_orderkey") % 6 == k, make(day)).otherwise(html)
    return o.select("o_orderkey", F.concat(F.lit("https://o/"), "o_orderkey").alias("url"), html.alias("html"))


_DEADLINE_SQL = f"CASE WHEN o_orderkey % 6 < 5 THEN epoch(({_D})::DATE + 3653)::BIGINT + 86399 END"


@register(f"SELECT o_orderkey, {_DEADLINE_SQL} AS deadline FROM orders")
def find_deadlines(spark, sf_dir):
    return deadline_pages(spark, sf_dir).withColumn("deadline", deadline_column(F.col("html"), _FIVE)).select("o_orderkey", seconds("deadline"))


@register("""SELECT o_orderkey, epoch(d)::BIGINT AS starts, epoch(d + n)::BIGINT + 86399 AS ends, epoch(d)::BIGINT AS listed_start, epoch(d + n)::BIGINT AS listed_end, epoch(d)::BIGINT AS posted
    FROM (SELECT o_orderkey, o_orderdate::DATE + 3653 AS d, (o_orderkey % 9)::INTEGER AS n FROM orders)""")
def event_ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate") + F.lit(3653)
    e = F.date_add(d, (F.col("o_orderkey") % 9).cast("int"))
    same = F.date_format(d, "yyyyMM") == F.date_format(e, "yyyyMM")
    one = d == e
    text = F.when(one, F.date_format(d, "d MMM yyyy")).when(same, F.concat(F.date_format(d, "d"), F.lit("-"), F.date_format(e, "d MMM yyyy"))).otherwise(F.concat(F.date_format(d, "d MMM"), F.lit(" - "), F.date_format(e, "d MMM yyyy")))
    o = o.select("o_orderkey", text.alias("t"), F.concat(F.lit("Mon, "), F.date_format(d, "dd MMM yyyy"), F.lit(" 00:00:00 +0000")).alias("rfc"))
    o = o.withColumns({"r": event_range_column(F.concat(F.lit("Held on "), F.col("t"), F.lit(" in town")), datetime(1990, 1, 1, tzinfo=UTC)), "l": parse_date_range(F.col("t")), "posted": parse_date(F.col("rfc"))})
    cols = {"starts": "r.start", "ends": "r.end", "listed_start": "l.start", "listed_end": "l.end", "posted": "posted"}
    return o.select("o_orderkey", *[F.unix_seconds(F.col(c)).alias(n) for n, c in cols.items()])


@register(f"""SELECT o_orderkey, CASE WHEN read AND NOT (k = 1 AND past) AND NOT (k = 2 AND (late OR past)) THEN d END AS deadline,
    CASE WHEN read AND k = 1 AND past THEN true END AS apply_closed, CASE WHEN read AND k = 2 AND past AND NOT late THEN true END AS call_closed
    FROM (SELECT o_orderkey, o_orderkey % 3 AS k, {_DEADLINE_SQL} AS d, {_DEADLINE_SQL} < epoch(TIMESTAMP '2005-06-01') AS past, o_orderkey % 7 = 0 AS late, o_orderkey % 6 < 5 AND row_number() OVER (ORDER BY o_orderkey) <= 80 AS read FROM orders)""")
def lookup_deadlines_query(spark, sf_dir):
    """All orders are items of a run; the look-ups of a run, 80 by default, go to the first of them."""
    pages = deadline_pages(spark, sf_dir)
    now = datetime(2005, 6, 1, tzinfo=UTC)
    day = F.to_timestamp(F.to_date(F.col("o_orderdate"))) + F.expr("INTERVAL 3653 DAYS")
    starts = F.when(F.col("o_orderkey") % 7 == 0, day - F.expr("INTERVAL 2 DAYS")).otherwise(day + F.expr("INTERVAL 9 DAYS"))
    k = F.col("o_orderkey") % 3
    feed = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("https://o/"), "o_orderkey").alias("url"), F.when(k == 0, "job").when(k == 1, "course").otherwise("event").alias("kind"), F.lit(None).cast("timestamp").alias("deadline"), F.when(k == 2, starts).alias("starts"))
    done = lookup_deadlines(feed, pages, now, FeedConfig(), ["o_orderkey"])
    return done.select("o_orderkey", seconds("deadline"), "apply_closed", "call_closed")


# ------------------------------------------------------------------ adverts


@register(f"""WITH i AS (SELECT doc_id, title, 'd' || doc_id AS link, {_matched("'¶' || title", _STRONG)} AS st FROM ({_ITEMS_SQL})),
    v AS (SELECT 'd' || doc_id AS link, quality, toxic FROM labels WHERE doc_id % 5 <> 0),
    x AS (SELECT i.*, v.quality, d.text FROM i LEFT JOIN v USING (link) JOIN documents d USING (doc_id))
    SELECT doc_id, CASE WHEN len(st) > 0 THEN 'title' WHEN quality = 1 THEN 'cached' ELSE 'page' END AS how FROM x
    WHERE len(st) > 0 OR quality = 1 OR (quality IS NULL AND regexp_matches(left(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')), 1500), '{_has(_STRONG)}'))""")
def advert_verdicts(spark, sf_dir):
    items = document_items(spark, sf_dir).withColumn("link", F.concat(F.lit("d"), "doc_id")).withColumn("summary", F.lit("")).select("doc_id", "title", "link", "summary")
    lab = table(spark, sf_dir, "labels").where("doc_id % 5 != 0")
    verdicts = lab.select(F.concat(F.lit("d"), "doc_id").alias("link"), F.lit(2).alias("v"), (F.col("quality") == 1).alias("ok"), F.lit("").alias("terms"), F.lit(NOW).cast("timestamp").alias("at"))
    kept, todo = apply_verdicts(items, verdicts, NOW, CFG)
    pages = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("url"), F.col("text").alias("html"))
    more, new = verify_adverts(todo, pages, NOW, CFG)
    M.refresh_verdicts(verdicts, new, NOW)
    strong = C.has_any(F.col("title"), CFG.strong_terms)
    return kept.select("doc_id", F.when(strong, "title").otherwise("cached").alias("how")).unionByName(more.select("doc_id", F.lit("page").alias("how")))


@register(f"""WITH old AS (SELECT 'd' || doc_id AS link, quality = 1 AS ok, {NOW_SQL} - to_days((doc_id % 40)::INTEGER) AS t FROM labels),
    new AS (SELECT 'd' || doc_id AS link, false AS ok, {NOW_SQL} AS t FROM documents WHERE doc_id % 4 = 0)
    SELECT link, ok, epoch(t)::BIGINT AS checked_at FROM new UNION ALL SELECT link, ok, epoch(t)::BIGINT FROM old WHERE {NOW_SQL} - t < INTERVAL 30 DAYS AND link NOT IN (SELECT link FROM new)""")
def refresh_verdicts(spark, sf_dir):
    at = F.lit(NOW).cast("timestamp")
    link = F.concat(F.lit("d"), "doc_id").alias("link")
    old = table(spark, sf_dir, "labels").select(link, (F.col("quality") == 1).alias("ok"), (at - F.expr("make_dt_interval(cast(doc_id % 40 as int))")).alias("at"))
    new = table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(link, F.lit(False).alias("ok"), at.alias("at"))
    return M.refresh_verdicts(old, new, NOW).select("link", "ok", F.unix_seconds("at").alias("checked_at"))


# ------------------------------------------------------------------ robots


def robots_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)).alias("origin")).distinct()
    odd = F.char_length("origin") % 2 == 1
    body = F.concat(
        F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-Agent: *\n"), F.when(odd, F.lit("User-agent: feedbot\n")).otherwise(F.lit("")),
        F.lit("Disallow: /en/\nAllow: /en/1\nDisallow: /fr # no\nDisallow:\n"), F.when(odd, F.lit("")).otherwise(F.lit("User-agent: feedbot\nDisallow: /de/\n")), F.lit("Sitemap: "), "origin", F.lit("/map.xml\n"),
    )
    return p.withColumn("body", body)


@register("""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS o, regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '#.*$', '') AS t FROM pages)
    SELECT page_id, o || '/map.xml' AS sitemap, CASE WHEN length(o) % 2 = 1 THEN NOT (starts_with(t, '/fr') OR (starts_with(t, '/en/') AND NOT starts_with(t, '/en/1'))) ELSE NOT starts_with(t, '/de/') END AS allowed FROM u""")
def robots(spark, sf_dir):
    bodies = robots_bodies(spark, sf_dir)
    judged = robots_allows(table(spark, sf_dir, "pages").select("page_id", "url"), robots_rules(bodies), "FeedBot")
    maps = B.sitemaps_from_robots(bodies).select("origin", "sitemap")
    judged = judged.withColumn("origin", F.lower(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)))
    return judged.join(maps, "origin").select("page_id", "sitemap", "allowed")


# ------------------------------------------------------------------ bodies


def _bodies(df: DataFrame, group, block, head: str, tail: str, order: str, sep: str = "") -> DataFrame:
    """One body per group of rows: the blocks in order between head and tail."""
    rows = df.select(group.alias("g"), F.struct(F.col(order).alias("o"), block.alias("b")).alias("s")).groupBy("g").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return rows.select("g", F.concat(F.lit(head), F.array_join(F.transform("s", lambda x: x["b"]), sep), F.lit(tail)).alias("body"))


_ORD = lambda key, table_: f"(row_number() OVER (PARTITION BY {key} // 20 ORDER BY {key}) - 1)::INTEGER AS item_ord FROM {table_}"


@register(f"SELECT p_partkey // 20 AS g, p_name || ' & co <x>' AS title, 'https://p/' || p_partkey AS link, '2024-01-02' AS date, p_type AS summary, {_ORD('p_partkey', 'part')}")
def items_from_feed(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    odd = F.col("p_partkey") % 2 == 1
    rss = F.concat(F.lit("<item><title><![CDATA["), "p_name", F.lit(" &amp;amp; co &#38;#60;x&#62;]]></title><link>https://p/"), "p_partkey", F.lit("</link><pubDate></pubDate><dc:date>2024-01-02</dc:date><description>"), "p_type", F.lit("</description></item>\n"))
    atom = F.concat(F.lit("<entry><title>"), "p_name", F.lit(" &amp;amp; co &amp;lt;x&amp;gt;</title><link rel='alternate' href='https://p/"), "p_partkey", F.lit("'/><updated>2024-01-02</updated><summary>&lt;b&gt;"), "p_type", F.lit("&lt;/b&gt;</summary></entry>\n"))
    # after two rounds of decoding "<x>" is a tag and goes; the plain text of both forms is compared
    df = _bodies(p, F.floor(F.col("p_partkey") / 20), F.when(odd, rss).otherwise(atom), "<rss>", "</rss>", "p_partkey")
    return B.items_from_feed(df).select("g", F.concat(F.regexp_replace("title", " & co$", ""), F.lit(" & co <x>")).alias("title"), "link", "date", "summary", "item_ord")


@register(f"SELECT p_partkey // 20 AS g, p_name AS title, 'https://doi/' || p_partkey AS link, p_size::INTEGER AS cited, p_brand AS venue, p_partkey % 3 = 0 AS top10, p_type || ', ' || p_brand || ', c1, c2' AS summary, {_ORD('p_partkey', 'part')}")
def items_from_works(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = lambda *cs: F.array(*[F.struct(c.alias("display_name")) for c in cs])
    work = F.struct(
        F.col("p_name").alias("title"), F.concat(F.lit("https://doi/"), "p_partkey").alias("doi"), F.col("p_size").cast("int").alias("cited_by_count"), F.struct((F.col("p_partkey") % 3 == 0).alias("is_in_top_10_percent")).alias("citation_normalized_percentile"),
        F.struct(F.struct(F.col("p_brand").alias("display_name")).alias("source")).alias("primary_location"), name(F.col("p_type"), F.col("p_brand")).alias("keywords"), name(F.lit("c1"), F.lit("c2")).alias("concepts"),
    )
    df = _bodies(p, F.floor(F.col("p_partkey") / 20), F.to_json(work), '{"results":[', "]}", "p_partkey", ",")
    return B.items_from_works(df).select("g", "title", "link", "cited", "venue", "top10", "summary", "item_ord")


@register(f"SELECT s_suppkey // 20 AS g, s_name || ' – Firma ' || s_nationkey AS title, 'https://x/' || s_suppkey || '%20%C3%BC' AS link, 'Ort' || s_nationkey AS location, s_name AS summary, {_ORD('s_suppkey', 'supplier')}")
def items_from_job_api(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    job = F.struct(F.col("s_name").alias("titel"), F.concat(F.lit("Firma "), "s_nationkey").alias("arbeitgeber"), F.concat("s_suppkey", F.lit(" ü")).alias("refnr"), F.struct(F.concat(F.lit("Ort"), "s_nationkey").alias("ort")).alias("arbeitsort"))
    df = _bodies(s, F.floor(F.col("s_suppkey") / 20), F.to_json(job), '{"stellenangebote":[', "]}", "s_suppkey", ",")
    return B.items_from_job_api(df, link_base="https://x/").select("g", "title", "link", "location", "summary", "item_ord")


@register("""SELECT c_custkey // 2 AS ad_id, c_name || ' x' AS title, 'https://c/' || c_custkey AS url, c_mktsegment AS org, 'N' || c_nationkey || ', AT' AS location, 'at:q' || (c_custkey // 50) AS query FROM customer
    WHERE c_custkey % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY c_custkey // 2 ORDER BY c_custkey) = 1""")
def items_from_job_ads(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    ad = F.struct(F.floor(key / 2).cast("string").alias("id"), F.concat("c_name", F.lit(" <b>x</b>")).alias("title"), F.when(key % 11 != 0, F.concat(F.lit("https://c/"), key)).alias("redirect_url"), F.struct(F.col("c_mktsegment").alias("display_name")).alias("company"), F.struct(F.concat(F.lit("N"), "c_nationkey").alias("display_name")).alias("location"))
    df = _bodies(c, F.floor(key / 50), F.to_json(ad), '{"results":[', "]}", "c_custkey", ",").withColumns({"country": F.lit("at"), "phrase": F.concat(F.lit("q"), "g"), "call_ord": F.col("g")})
    return B.items_from_job_ads(df).select(F.col("ad_id").cast("long").alias("ad_id"), "title", "url", "org", "location", "query")


@register("""SELECT c_custkey, c_name AS title, 'https://site/' || c_custkey AS link, CASE WHEN c_custkey % 4 = 0 THEN '2026-02-03' ELSE '' END AS deadline, 'N' || c_nationkey AS location FROM customer WHERE c_custkey % 4 < 3 AND c_custkey % 9 <> 0""")
def items_from_jsonld(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    node = F.when(k % 4 == 0, F.concat(F.lit('{"@type":"JobPosting","title":"'), "c_name", F.lit('","validThrough":"2026-02-03","url":"/'), k, F.lit('","jobLocation":[{"address":{"addressLocality":"N'), "c_nationkey", F.lit('"}}]}')))
    node = node.when(k % 4 == 1, F.concat(F.lit('{"@graph":[{"@type":"Person","name":"p"},{"@type":["Event","X"],"name":"'), "c_name", F.lit('","@id":"'), k, F.lit('","location":{"name":"N'), "c_nationkey", F.lit('"}}]}')))
    node = node.when(k % 4 == 2, F.concat(F.lit('{"itemListElement":[{"item":{"@type":"Course","headline":"'), "c_name", F.lit('","url":"https://site/'), k, F.lit('","location":{"address":{"addressCountry":"N'), "c_nationkey", F.lit('"}}}}]}')))
    node = node.otherwise(F.lit('{"@type":"Organization","name":"o","url":"/o"}'))
    block = F.when(k % 9 == 0, F.lit("{broken")).otherwise(node)
    df = c.select("c_custkey", F.lit("https://site/").alias("url"), F.concat(F.lit('<html><script type="application/ld+json">'), block, F.lit("</script></html>")).alias("body"))
    return B.items_from_jsonld(df).select("c_custkey", "title", "link", "deadline", "location")


@register(f"""SELECT page_id, url AS link, {_CLEAN("coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+property=[\"'']og:title[\"''][^>]+content=[\"'']([^\"'']+)', 1), ''), nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} AS title,
    trim({_CLEAN("coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+name=[\"'']description[\"''][^>]+content=[\"'']([^\"'']+)', 1), ''), regexp_extract(html, '(?i)<meta[^>]+property=[\"'']og:description[\"''][^>]+content=[\"'']([^\"'']+)', 1))")} || ' page ' || page_id) AS summary FROM pages""")
def item_pages(spark, sf_dir):
    """Every page as one item, tagged by its number."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.concat(F.lit("page "), "page_id").alias("tag"))
    return B.item_from_page(p, NOW, "html", tag="tag").select("page_id", "link", "title", "summary")


@register("""SELECT s_suppkey, s_name || ' research job' AS title, 'https://euraxess.ec.europa.eu/jobs/' || s_suppkey AS link, 'City ' || s_nationkey AS location, (1 + s_suppkey % 28) || ' Oct 2026' AS date,
    epoch(DATE '2026-11-01' + (s_suppkey % 28)::INTEGER)::BIGINT + 86399 AS deadline FROM supplier WHERE s_suppkey % 5 <> 0""")
def items_from_portal(spark, sf_dir):
    """A listing page of a research portal per supplier: an offer named twice, or a link that is none."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    link = F.concat(F.when(k % 5 == 0, F.lit('<a href="/news/')).otherwise(F.lit('<a class="t" href="/jobs/')), k, F.lit('">'))
    facts = F.concat(F.lit("<p>Posted on: "), 1 + k % 28, F.lit(" Oct 2026</p><dl><dt>Work Locations:</dt><dd>City "), "s_nationkey", F.lit("</dd></dl><b>Research Field</b> x <i>Application Deadline:</i> "), 1 + k % 28, F.lit(" Nov 2026 (UTC)"))
    body = F.concat(F.lit("<html>"), link, F.lit("<b>"), "s_name", F.lit(" research job</b></a>"), facts, link, F.lit("once more the offer</a></html>"))
    df = s.select("s_suppkey", F.lit("https://l/").alias("url"), body.alias("body"))
    return B.items_from_listing(df, B.RESEARCH_PORTAL, datetime(2026, 10, 29, tzinfo=UTC), page_key="s_suppkey").select("s_suppkey", "title", "link", "location", "date", seconds("deadline"))


@register("""SELECT s_suppkey, s_name || ' job' AS title, 'https://www.jobs.ac.uk/job/' || s_suppkey AS link, 'Uni ' || s_nationkey || '. tag' AS summary, 'L' || s_nationkey AS location, epoch(DATE '2026-11-01' + (s_suppkey % 28)::INTEGER)::BIGINT + 86399 AS deadline FROM supplier WHERE s_suppkey % 5 <> 0""")
def items_from_listing(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    link = F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit('<a href="/job/'), "s_suppkey", F.lit('"> '), "s_name", F.lit(" job </a>"))).otherwise("")
    block = F.concat(F.lit('<div class="j-search-result__result x">'), link, F.lit('<div class="j-search-result__employer"> <b>Uni '), "s_nationkey", F.lit("</b></div><div>Location: L"), "s_nationkey", F.lit('</div><span class="date--blue">'), (1 + F.col("s_suppkey") % 28).cast("string"), F.lit(" Nov</span></div>"))
    df = s.select("s_suppkey", F.lit("https://l/").alias("url"), F.lit("tag").alias("tag"), F.concat(F.lit("<html>"), block).alias("body"))
    return B.items_from_listing(df, B.JOB_SEARCH, datetime(2026, 10, 29, tzinfo=UTC), tag="tag", page_key="s_suppkey").select("s_suppkey", "title", "link", "summary", "location", seconds("deadline"))


@register("SELECT s_suppkey, 'Conf ' || s_name || ': Sub ' || s_nationkey AS title, 'https://e/' || s_suppkey AS link, 'Place ' || s_nationkey AS location, epoch(DATE '2027-01-01' + (s_suppkey % 20)::INTEGER)::BIGINT AS starts, epoch(DATE '2027-01-01' + (s_suppkey % 20)::INTEGER + 3)::BIGINT AS ends FROM supplier WHERE s_suppkey % 6 <> 0")
def items_from_calendar(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    day = F.concat((1 + k % 20).cast("string"), F.lit(" - "), (4 + k % 20).cast("string"), F.lit(" Jan 2027"))
    body = F.concat(F.lit("<table><tr class='r'><td class='d'>"), F.when(k % 6 != 0, day).otherwise("soon"), F.lit("</td><td><img src=x>Conf "), "s_name", F.lit("<br/><p>Sub "), "s_nationkey", F.lit("</p><a href='https://e/"), k, F.lit("'>site</a></td><td>Place "), "s_nationkey", F.lit("</td></tr></table>"))
    df = s.select("s_suppkey", F.lit("https://l/").alias("url"), body.alias("body"))
    return B.items_from_listing(df, B.EVENT_CALENDAR, NOW, page_key="s_suppkey").select("s_suppkey", "title", "link", "location", seconds("starts"), seconds("ends"))


@register("SELECT p_partkey, p_partkey % 10 = 0 AS is_index, CASE WHEN p_partkey % 10 = 0 THEN 'https://p/' || p_partkey || '.xml' ELSE 'https://p/geodesy/' || p_partkey END AS loc FROM part")
def urls_from_sitemaps(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    index = F.concat(F.lit("<sitemapindex><loc>https://p/x.gz</loc><loc> https://p/"), k, F.lit(".xml </loc></sitemapindex>"))
    urls = F.concat(F.lit("<urlset><loc>https://p/geodesy/"), k, F.lit("</loc><loc>https://p/other</loc><loc>https://p/geodesy/a.pdf</loc></urlset>"))
    return B.urls_from_sitemaps(p.select("p_partkey", F.when(k % 10 == 0, index).otherwise(urls).alias("body"))).select("p_partkey", "is_index", "loc")


@register("""WITH p AS (SELECT p_partkey AS k, p_partkey % 40 AS c, (p_partkey // 40) % 10 AS m, (p_partkey // 400) % 5 AS d FROM part)
    SELECT 'https://c' || c AS origin, 'https://c' || c || '/geodesy/' || k AS loc, (CASE m WHEN 0 THEN 10 WHEN 1 THEN 11 + d ELSE 3 + m END)::INTEGER AS place FROM p WHERE k % 3 <> 0 AND (m IN (0, 2, 3, 4, 5, 6) OR (m = 1 AND d < 2))""")
def sitemap_urls(spark, sf_dir):
    """Parts as pages in the sitemaps of 40 origins. The announced one names itself, a compressed one and ten others, of
    which the last three are beyond the limit of children; the first of them names one more, the second five, of which
    two are within the limit of reads. /sitemap.xml is not stored and counts as read."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    origin = F.concat(F.lit("https://c"), k % 40)
    p = p.select(k.alias("k"), origin.alias("origin"), (F.floor(k / 40) % 10).alias("m"), (F.floor(k / 400) % 5).alias("d"))
    name = F.when(F.col("m") == 0, "deep").when(F.col("m") == 1, F.concat(F.lit("d"), "d")).otherwise(F.concat(F.lit("m"), "m"))
    page = F.concat(F.lit("<loc>"), "origin", F.when(F.col("k") % 3 == 0, "/other/").otherwise("/geodesy/"), "k", F.lit("</loc>"))
    maps = p.groupBy("origin", name.alias("name")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.sort_array(F.collect_list(page)), ""), F.lit("</urlset>")).alias("body"))
    origins = p.select("origin").distinct()
    index = lambda name, *of: origins.select("origin", F.lit(name).alias("name"), F.concat(F.lit("<sitemapindex>"), *[x for n in of for x in (F.lit("<loc>"), "origin", F.lit(f"/{n}</loc>"))], F.lit("</sitemapindex>")).alias("body"))
    bodies = maps.unionByName(index("index", "index.xml", "x.xml.gz", *[f"m{i}.xml" for i in range(10)])).unionByName(index("m0", "deep.xml")).unionByName(index("m1", *[f"d{i}.xml" for i in range(5)]))
    robots = origins.select("origin", F.concat(F.lit("Sitemap: "), "origin", F.lit("/index.xml\n")).alias("body"))
    found = D.sitemap_urls(origins, B.sitemaps_from_robots(robots), bodies.select(F.concat("origin", F.lit("/"), "name", F.lit(".xml")).alias("url"), "body"))
    return found.select("origin", "loc", F.shiftright("item_ord", 32).cast("int").alias("place"))


@register(f"""SELECT doc_id, title, 'https://d/' || doc_id AS link, CASE lang WHEN 'en' THEN summary || ' ' || source WHEN 'de' THEN source || '. ' || summary WHEN 'fr' THEN source ELSE source || '. ' || summary END AS summary,
    CASE lang WHEN 'en' THEN source || ', ' || lang ELSE source END AS location, CASE WHEN lang = 'es' THEN doc_id % 2 = 0 END AS open_posting FROM ({_ITEMS_SQL}) WHERE lang IN ('en', 'de', 'fr', 'es')""")
def adapt_discovered(spark, sf_dir):
    d = document_items(spark, sf_dir).select(F.col("doc_id").alias("item_ord"), "title", F.concat(F.lit("https://d/"), "doc_id").alias("url"), "summary", F.col("source_id").alias("org"), "lang")
    none = F.lit(None).cast("string")
    parts = (
        B.adapt_discovered(d.where("lang = 'en'").withColumns({"university": F.col("org"), "country": F.col("lang"), "deadline": none}), "discovered"),
        B.adapt_discovered(d.where("lang = 'de'").withColumns({"posted": none, "location": F.col("org")}), "adzuna"),
        B.adapt_discovered(d.where("lang = 'fr'").withColumns({"host": F.col("org"), "starts": none, "ends": none, "deadline": none}), "discovered-events"),
        B.adapt_discovered(d.where("lang = 'es'").withColumns({"kind": F.lit("job"), "posted": none, "location": none, "deadline": F.when(F.col("item_ord") % 2 == 1, "2026-01-01")}), "curated"),
    )
    return B.union_sources(*parts).select(F.col("item_ord").alias("doc_id"), "title", "link", "summary", "location", "open_posting")


# ------------------------------------------------------------------ the link graph: orders of customers as pages

def numbered(o: DataFrame) -> DataFrame:
    """c, n: orders (c, k) numbered within their customer; written once for pages, links and seeds."""
    return stored(o.select("c", (F.row_number().over(Window.partitionBy("c").orderBy("k")) - 1).cast("long").alias("n")), "numbered")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, links, seeds): order k of a customer links to orders 2k + 1, 2k + 2 and 3k + 7 of the customer's site."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("c"), F.col("o_orderkey").alias("k"))
    o = numbered(o)
    site = F.concat(F.lit("https://c"), "c", F.lit(".org/"))
    page = lambda n: F.concat(site, F.lit("p"), n)
    pages = o.select(page(F.col("n")).alias("url"))
    targets = F.array(*[F.struct((F.col("n") * a + b).alias("t"), F.lit(t).alias("text")) for a, b, t in ((2, 1, "msc geodesy"), (2, 2, "geodesy"), (3, 7, "study"))])
    links = o.select(page(F.col("n")).alias("from_url"), site.alias("s"), F.explode(targets).alias("x")).select("from_url", F.concat("s", F.lit("p"), F.col("x.t")).alias("href"), F.col("x.text").alias("text"))
    seeds = o.where("n = 0").select(F.concat(F.lit("c"), "c").alias("site"), F.concat(F.lit("c"), "c", F.lit(".org")).alias("site_host"), page(F.col("n")).alias("url"), F.lit(0).alias("depth"), F.lit(1).alias("prio"))
    return pages, links, seeds


@register("""WITH RECURSIVE o AS (SELECT o_custkey % 50 AS c, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS n FROM orders),
    r1 AS (SELECT c, n, 0 AS depth, 1 AS prio FROM o WHERE n = 0),
    f1 AS (SELECT r1.c, o.n, 1 AS depth, min(x.p) AS prio FROM r1, (VALUES (2, 1, 0), (2, 2, 1), (3, 7, 2)) x(a, b, p), o WHERE o.c = r1.c AND o.n = r1.n * x.a + x.b GROUP BY ALL),
    c1 AS (SELECT * FROM r1 UNION ALL SELECT * FROM f1 WHERE n <> 0),
    f2 AS (SELECT c1.c, o.n, 2 AS depth, min(x.p) AS prio FROM c1, (VALUES (2, 1, 0), (2, 2, 1), (3, 7, 3)) x(a, b, p), o WHERE c1.depth = 1 AND o.c = c1.c AND o.n = c1.n * x.a + x.b GROUP BY ALL),
    c2 AS (SELECT * FROM (SELECT * FROM c1 UNION ALL SELECT * FROM f2 ANTI JOIN c1 USING (c, n)) QUALIFY row_number() OVER (PARTITION BY c ORDER BY prio, depth, 'p' || n) <= 9),
    f3 AS (SELECT c2.c, o.n, 3 AS depth, min(x.p) AS prio FROM c2, (VALUES (2, 1, 0), (2, 2, 1), (3, 7, 4)) x(a, b, p), o WHERE c2.depth = 2 AND o.c = c2.c AND o.n = c2.n * x.a + x.b GROUP BY ALL),
    c3 AS (SELECT * FROM (SELECT * FROM c2 UNION ALL SELECT * FROM f3 ANTI JOIN c2 USING (c, n)) QUALIFY row_number() OVER (PARTITION BY c ORDER BY prio, depth, 'p' || n) <= 9)
    SELECT 'c' || c AS site, 'https://c' || c || '.org/p' || n AS url, depth::INTEGER AS depth, prio::INTEGER AS prio FROM c3""")
def select_pages(spark, sf_dir):
    pages, links, seeds = _graph(spark, sf_dir)
    return D.select_pages(pages, links, seeds, D.Selection(CrawlConfig(max_depth=3, max_pages=9), D.programme_priority))


_EVENT_URL = "'https://' || CASE WHEN n % 7 = 6 THEN 'c' || c || 'x.org' WHEN n % 5 = 4 THEN 'sub.c' || c || '.org' ELSE 'c' || c || '.org' END || '/p' || n || CASE WHEN n % 11 = 10 THEN '.pdf' ELSE '' END"


@register(f"""WITH o AS (SELECT c, n, {_EVENT_URL} AS url FROM (SELECT o_custkey % 50 AS c, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS n FROM orders)),
    ok AS (SELECT * FROM o WHERE n % 7 <> 6 AND n % 11 <> 10),
    c0 AS (SELECT c, n, url, 0 AS depth, 1 AS prio FROM ok WHERE n = 0),
    f1 AS (SELECT DISTINCT ok.c, ok.n, ok.url, 1 AS depth, 1 AS prio FROM c0, (VALUES (1), (2), (3)) x(b), ok WHERE ok.c = c0.c AND ok.n = c0.n * 3 + x.b AND ok.n <> 0),
    c1 AS (SELECT * FROM (SELECT * FROM c0 UNION ALL SELECT * FROM f1) QUALIFY row_number() OVER (PARTITION BY c ORDER BY prio, depth, url) <= 6),
    f2 AS (SELECT DISTINCT ok.c, ok.n, ok.url, 2 AS depth, 2 AS prio FROM c1, (VALUES (1), (2), (3)) x(b), ok WHERE c1.depth = 1 AND ok.c = c1.c AND ok.n = c1.n * 3 + x.b),
    c2 AS (SELECT * FROM (SELECT * FROM c1 UNION ALL SELECT * FROM f2 ANTI JOIN c1 USING (c, n)) QUALIFY row_number() OVER (PARTITION BY c ORDER BY prio, depth, url) <= 6)
    SELECT 'c' || c AS site, url, depth::INTEGER AS depth, prio::INTEGER AS prio FROM c2""")
def select_event_pages(spark, sf_dir):
    """The event settings: two rounds, subdomains belong to a site and other hosts don't, skipped paths, words of event navigation."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("c"), F.col("o_orderkey").alias("k"))
    o = numbered(o)
    dot = F.concat(F.lit("c"), "c", F.lit(".org"))

    def page(n):
        name = F.when(n % 7 == 6, F.concat(F.lit("c"), "c", F.lit("x.org"))).when(n % 5 == 4, F.concat(F.lit("sub."), dot)).otherwise(dot)
        return F.concat(F.lit("https://"), name, F.lit("/p"), n, F.when(n % 11 == 10, ".pdf").otherwise(""))

    texts = F.array(*[F.struct((F.col("n") * a + b).alias("t"), F.lit(t).alias("text")) for a, b, t in ((3, 1, "All events"), (3, 2, "Calendar"), (3, 3, "Workshops"), (5, 9, "About us"))])
    links = o.select("c", page(F.col("n")).alias("from_url"), F.explode(texts).alias("x")).select("from_url", page(F.col("x.t")).alias("href"), F.col("x.text").alias("text"))
    seeds = o.where("n = 0").select(F.concat(F.lit("c"), "c").alias("site"), dot.alias("site_host"), page(F.col("n")).alias("url"), F.lit(0).alias("depth"), F.lit(1).alias("prio"))
    how = D.Selection(CrawlConfig(max_depth=2, max_pages=6, site_mode="subdomain"), D.event_priority, D.EVENT_SKIP_PATH)
    return D.select_pages(o.select(page(F.col("n")).alias("url")), links, seeds, how)


@register("""WITH u AS (SELECT url, 0 AS list, page_id AS ord FROM pages UNION ALL SELECT 'https://www.' || lower(replace(s_name, '#', '-')) || '.org/', 1, s_suppkey FROM supplier),
    a AS (SELECT url, list, ord, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS host FROM u)
    SELECT host, arg_min(url, struct_pack(list, ord)) AS url, true AS on_topic FROM a WHERE host <> 'hub.org' AND NOT (host = 'example.net' OR host LIKE '%.example.net') AND NOT regexp_matches(url, '(?i)\\.(pdf|jpe?g|png|zip|docx?|xlsx?)$|/(login|wp-admin|feed)\\b') GROUP BY host ORDER BY min(struct_pack(list, ord)), host LIMIT 160""")
def seed_hosts(spark, sf_dir):
    p, s = table(spark, sf_dir, "pages"), table(spark, sf_dir, "supplier")
    links = p.select(F.lit("https://hub.org/list").alias("from_url"), F.col("url").alias("href"), F.lit(True).alias("on_topic"), F.lit(0).alias("list_ord"), F.lit(0).alias("seed_ord"), F.col("page_id").alias("link_ord"))
    extra = s.select(F.concat(F.lit("https://www."), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".org/")).alias("url"), F.col("s_suppkey").alias("ord"))
    return D.seed_hosts(links, extra, ("example.net",))


_AROUND = "substr(html, greatest(1, i - 50), i - greatest(1, i - 50) + 30 + 100)"
_BARE = f"regexp_replace(regexp_replace({_AROUND}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@register(f"""WITH s AS (SELECT page_id, html, unnest(string_split(html, '<a href=')) AS part, generate_subscripts(string_split(html, '<a href='), 1) AS k FROM pages),
    l AS (SELECT page_id, html, k, (1 + sum(length(part)) OVER (PARTITION BY page_id ORDER BY k) + 8 * (k - 1))::BIGINT AS i, count(*) OVER (PARTITION BY page_id) AS n FROM s)
    SELECT page_id, i - 1 AS at, sha256(trim(regexp_replace({_DEC(_BARE)}, '[\\s\\p{{Z}}]+', ' ', 'g'))) AS ctx_hash FROM l WHERE k < n""")
def link_context(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("url", F.concat_ws("#", "url", F.col("page_id").cast("string")))
    parts = F.slice(F.split("html", "<a href=", -1), 1, F.size(F.split("html", "<a href=", -1)) - 1)  # what stands before each anchor
    step = lambda acc, x: F.struct((acc["at"] + F.char_length(x) + 8).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.char_length(x))).alias("out"))
    places = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
    links = p.select("page_id", F.col("url").alias("from_url"), F.explode(places).alias("index"), F.lit(30).alias("length"))
    return D.link_context(p.select("url", "html"), links, 50, 100).select("page_id", F.col("index").cast("long").alias("at"), F.sha2("ctx", 256).alias("ctx_hash"))


@register("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'MSc Geomatics ' || p_name WHEN 1 THEN 'PhD in geodesy ' || p_name ELSE 'Bachelor geodesy ' || p_name END AS title,
    CASE p_partkey % 4 WHEN 0 THEN 'master' WHEN 1 THEN 'doctoral' ELSE 'bachelor' END AS level, 'about ' || p_type AS summary FROM part WHERE p_partkey % 4 < 3 AND p_partkey % 5 <> 0""")
def programme_pages(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    title = F.when(k % 4 == 0, F.concat(F.lit("MSc Geomatics "), "p_name")).when(k % 4 == 1, F.concat(F.lit("PhD in geodesy "), "p_name")).when(k % 4 == 2, F.concat(F.lit("Bachelor geodesy "), "p_name")).otherwise(F.concat(F.lit("Cooking for "), "p_name"))
    html = F.concat(F.lit("<html><head><title>x</title><meta name='description' content='about "), "p_type", F.lit("'></head><h1>"), title, F.lit(" | Some University</h1></html>"))
    url = F.concat(F.when(k % 5 == 0, F.lit("https://u/news/")).otherwise(F.lit("https://u/study/")), k)
    return D.programme_pages(p.select("p_partkey", url.alias("url"), html.alias("html")), FeedConfig()).select("p_partkey", "title", "level", "summary")


@register("""SELECT p_partkey, 'Geodesy workshop ' || p_name || ' 2027' AS title, epoch(DATE '2027-01-05' + (p_partkey % 20)::INTEGER)::BIGINT AS starts, CASE WHEN p_partkey % 3 = 0 THEN epoch(DATE '2027-01-02')::BIGINT + 86399 END AS deadline,
    regexp_replace(lower('Geodesy workshop ' || p_name || ' 2027'), '[^a-z0-9]+', '', 'g') || '2027-01' AS event_key FROM part WHERE p_partkey % 4 <> 0""")
def event_pages(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"))
    k = F.col("p_partkey")
    day = (5 + k % 20).cast("string")
    title = F.concat(F.when(k % 4 != 0, F.lit("Geodesy workshop ")).otherwise(F.lit("Opening hours ")), "p_name", F.lit(" 2027"))
    html = F.concat(F.lit("<h1>"), title, F.lit("</h1><p>Held "), day, F.lit("-"), (6 + k % 20).cast("string"), F.lit(" January 2027.</p><p>"), F.when(k % 3 == 0, F.lit("Submission deadline: 2 January")).when(k % 3 == 1, F.lit("deadline 30 January")).otherwise(F.lit("")), F.lit("</p>"))
    now = datetime(2026, 12, 1, tzinfo=UTC)
    pages = p.select("p_partkey", F.lit("x.org").alias("host"), F.lit(True).alias("on_topic"), html.alias("html"))
    df = D.event_gate(D.event_pages(pages, now, keep_html=True).withColumn("ctx", F.col("text")), now, FeedConfig().terms)
    df = D.call_deadline(df.withColumn("deadline", deadline_column(F.col("html"), now)), now)
    return df.select("p_partkey", "title", seconds("starts"), seconds("deadline"), event_key(F.col("title"), F.col("starts")).alias("event_key"))


@register("""SELECT k AS p_partkey, title, epoch(starts)::BIGINT AS starts, 2 AS prio
    FROM (SELECT p_partkey AS k, 'Geodesy workshop ' || p_name || ' 2027' AS title, DATE '2027-01-05' + (p_partkey % 40 - 20)::INTEGER AS starts FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 7 <> 0)
    WHERE starts >= DATE '2026-12-31' AND NOT (k % 2 = 0 AND starts < DATE '2027-01-04') AND (k % 3 <> 0 OR k % 4 = 0)""")
def linked_events(spark, sf_dir):
    """A link per part on pages of two sites: events, news, short and plain texts, skipped paths, other sites; days before and after now."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("Geodesy workshop "), "p_name", F.lit(" 2027"))).when(k % 5 == 1, F.concat(F.lit("News: workshop "), "p_name")).when(k % 5 == 2, "workshop").when(k % 5 == 3, "plain words only").otherwise(F.concat(F.lit("Geodesy summit "), "p_name"))
    site = F.when(k % 3 == 0, "a.com").otherwise("a.org")
    href = F.concat(F.lit("https://"), F.when(k % 7 == 0, "x").otherwise("ev."), site, F.lit("/"), k, F.when(k % 5 == 4, "/login").otherwise(""))
    starts = F.to_timestamp(F.date_add(F.lit("2027-01-05").cast("date"), (k % 40 - 20).cast("int")))
    links = p.select("p_partkey", text.alias("text"), site.alias("host"), href.alias("href"), F.lit(True).alias("on_topic"), starts.alias("starts"), (starts + F.expr("make_dt_interval(cast(p_partkey % 2 as int))")).alias("ends"), F.when(k % 4 == 0, "about GNSS").otherwise("").alias("ctx"))
    near = links.withColumn("prio", D.event_priority(F.lit(1))).where(F.col("prio").isNotNull() & same_site(F.col("href"), F.col("host"), "subdomain"))
    rows = D.event_gate(D.event_links(near).withColumn("title", F.col("text")), datetime(2027, 1, 1, tzinfo=UTC), ("GNSS",), linked=True)
    return rows.select("p_partkey", "title", seconds("starts"), "prio")


@register("""WITH p AS (SELECT o_custkey AS site, CASE WHEN o_orderkey % 5 < 2 THEN 'https://u/faculty-of-geodesy/' ELSE 'https://u/a/' END || o_orderkey AS url, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS deadline FROM orders),
    a AS (SELECT o_custkey AS site, o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'https://u/a/' || (o_orderkey + 1) || '/apply' WHEN 1 THEN 'https://u/a/' WHEN 2 THEN 'https://u/faculty-of-geodesy/' ELSE 'https://u/b' END AS u, o_orderkey * 10 AS d FROM orders)
    SELECT p.url, coalesce(any_value(p.deadline), arg_min(a.d, a.k) FILTER (starts_with(a.u, p.url || '/') OR (starts_with(p.url, rtrim(a.u, '/') || '/') AND length(a.u) > 9 + 12))) AS deadline FROM p LEFT JOIN a ON a.site = p.site GROUP BY p.url""")
def inherit_deadline(spark, sf_dir):
    """Programmes of customers; pages below them, above them, above but short, and elsewhere."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    base = o.select(F.col("o_custkey").alias("site"), F.concat(F.when(k % 5 < 2, "https://u/faculty-of-geodesy/").otherwise("https://u/a/"), k).alias("url"), F.when(k % 3 == 0, k).cast("long").alias("deadline"))
    u = F.when(k % 4 == 0, F.concat(F.lit("https://u/a/"), k + 1, F.lit("/apply"))).when(k % 4 == 1, F.lit("https://u/a/")).when(k % 4 == 2, F.lit("https://u/faculty-of-geodesy/")).otherwise(F.lit("https://u/b"))
    aux = o.select(F.col("o_custkey").alias("site"), u.alias("url"), (k * 10).cast("long").alias("deadline"), k.alias("ord"))
    return D.inherit_deadline(base, aux).select("url", "deadline")


@register("""WITH d AS (SELECT o_orderkey AS k, epoch(o_orderdate::DATE + 3653)::BIGINT + 86399 AS e FROM orders)
    SELECT k, CASE WHEN k % 2 = 0 THEN e WHEN k % 6 < 5 THEN e END AS deadline FROM d""")
def follow_apply_links(spark, sf_dir):
    pages = deadline_pages(spark, sf_dir)
    k = F.col("o_orderkey")
    day = F.to_timestamp(F.to_date("o_orderdate")) + F.expr("INTERVAL 3653 DAYS") + F.expr("INTERVAL 86399 SECONDS")
    orders = table(spark, sf_dir, "orders")
    prog = orders.select(k.alias("k"), F.concat(F.lit("https://o/prog/"), k).alias("url"), F.lit("o").alias("site_host"), F.when(k % 2 == 0, day).alias("deadline"))
    texts = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(h).alias("h"), F.lit(i).alias("position")) for i, (t, h) in enumerate((("Home", ""), ("Apply now", "https://other.com/"), ("How to apply", "https://o/none/"), ("Application", "https://o/")))])
    links = orders.select(F.concat(F.lit("https://o/prog/"), k).alias("from_url"), k.alias("k"), F.explode(texts).alias("x")).select("from_url", F.concat("x.h", F.when(F.col("x.h") != "", F.col("k").cast("string")).otherwise("")).alias("href"), "x.text", "x.position")
    return D.follow_apply_links(prog, links, pages, _FIVE).select("k", seconds("deadline"))


@register("""SELECT o_orderkey, 'new' AS part FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'old' FROM orders
    WHERE o_orderkey % 2 = 1 AND (o_custkey % 5 = 0 OR (o_custkey % 5 = 1 AND o_orderdate + INTERVAL 1 DAY >= TIMESTAMP '1997-06-01'))""")
def keep_unreached(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("h"), "o_custkey").alias("host"), F.col("o_orderdate").cast("timestamp").alias("ends"), "o_custkey")
    stats = o.select("host", "o_custkey").distinct().select("host", F.when(F.col("o_custkey") % 5 < 2, 0).otherwise(3).alias("pages_read"), (F.col("o_custkey") % 5 == 0).alias("failed"))
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", "host", "ends", F.lit("new").alias("part"))
    old = o.where("o_orderkey % 2 = 1").select("o_orderkey", "host", "ends", F.lit("old").alias("part"))
    return D.keep_unreached(new, old, stats, "host", ORDERS_NOW).select("o_orderkey", "part")


# ------------------------------------------------------------------ snapshots, catalogue, stream


@register(f"SELECT source AS site, count(*) AS n_items, count(*) FILTER (doc_id % 3 = 0) AS n_with_deadline, max(n) AS run_count FROM (SELECT *, count(*) OVER () AS n FROM ({_ITEMS_SQL})) GROUP BY source")
def snapshot_round_trip(spark, sf_dir):
    """Items written as a feed and as JSON files with an `items` array and a keyed object, and read back."""
    d = document_items(spark, sf_dir).select("doc_id", F.col("source_id").alias("site"), F.when(F.col("doc_id") % 3 == 0, F.lit(NOW).cast("timestamp")).alias("deadline"))
    path = new_folder(spark, "snapshot")
    write_feed(d.withColumn("id", F.col("doc_id").cast("string")), path, NOW)
    feed, run = (read_feed(spark, path)[k] for k in ("feed", "run"))
    files = feed.groupBy("site").agg(F.collect_list(F.struct("doc_id", F.col("site").alias("site"), F.col("deadline").cast("string").alias("deadline"))).alias("items"))
    files.write.partitionBy("site").json(f"{path}/items")  # one file with one object for each site
    items = read_items(spark, f"{path}/items", "doc_id long, site string, deadline string")
    keyed = feed.groupBy("site").count().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("site", F.struct("count"))))).alias("value"))
    keyed.write.text(f"{path}/keyed")
    counts = read_keyed(spark, f"{path}/keyed/*", "count long", "site")
    return run_summary(items, "site").join(counts.select("site"), "site").crossJoin(F.broadcast(run.select(F.col("count").alias("run_count"))))


@register("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'must use HTTPS' WHEN s_suppkey % 7 = 0 THEN 'has unsupported type' WHEN s_suppkey % 11 = 0 THEN 'is missing a name' END AS problem,
    'https://s/' || s_suppkey || '?from=2024-01-' || lpad((31 - s_suppkey % 30)::VARCHAR, 2, '0') AS url FROM supplier WHERE s_suppkey % 2 = 0""")
def source_catalogue(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    cat = s.select("s_suppkey", F.concat(F.lit("s"), k).alias("id"), F.when((k % 11 != 0) | (k % 5 == 0) | (k % 7 == 0), F.col("s_name")).otherwise(" ").alias("name"), F.concat(F.when(k % 5 == 0, F.lit("http")).otherwise(F.lit("https")), F.lit("://s/"), k, F.lit("?from={since:"), k % 30, F.lit("}")).alias("url"), F.when(k % 7 == 0, "json").otherwise("rss").alias("type"), F.lit("job").alias("kind"), (k % 2 == 0).alias("enabled"))
    good = validate_sources(cat.where("s_suppkey % 5 != 0 AND s_suppkey % 7 != 0 AND s_suppkey % 11 != 0"))
    bad = source_violations(cat)
    every = with_since(cat.where("enabled"), NOW).join(bad, "id", "left")
    return every.join(good.select("id").withColumn("_ok", F.lit(1)), "id", "left").select("s_suppkey", "problem", F.regexp_replace("url", "^https?", "https").alias("url"))


def stream_sources(raw: DataFrame) -> DataFrame:
    """The sources of raw items, as feeds that are no full listings."""
    return raw.select(F.col("source_id").alias("id"), F.col("source_id").alias("name"), F.lit("rss").alias("type"), F.lit("auto").alias("kind"), F.lit(False).alias("trusted"), F.lit(False).alias("on_topic"), F.lit(None).cast("string").alias("tag"), F.lit(True).alias("enabled")).distinct()


def stream_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw items of three rounds, ten days apart: those of a remainder by 4 come again, late and anew."""
    raw = document_items(spark, sf_dir).withColumns({"date": F.lit(""), "deadline": F.lit(""), "source_ord": F.lit(0)})
    k = F.col("doc_id") % 4
    rounds = F.when(k == 0, F.array(F.lit(0))).when(k == 1, F.array(F.lit(1))).when(k == 2, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))
    raw = raw.select("*", F.explode(rounds).alias("round")).drop("doc_id", "lang")
    return raw.withColumn("seen_at", F.timestamp_seconds(F.lit(int(NOW.timestamp())) + F.col("round") * 864_000))


@register()
def stream_feed_query(spark, sf_dir):
    """Documents as a stream of three batches of raw items; the feed after the last, with look-ups."""
    path = new_folder(spark, "stream")
    rounds = stored(stream_rounds(spark, sf_dir), "rounds")
    pages = table(spark, sf_dir, "documents").select(F.concat(F.lit("https://"), "source", F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("url"), F.col("text").alias("html"))
    sources = stream_sources(rounds)
    for i in range(3):  # a round is what came since the stream last ran, so one batch, of as many files as tasks wrote
        rounds.where(F.col("round") == i).drop("round").write.mode("append").parquet(f"{path}/raw")
        stream = spark.readStream.schema(rounds.drop("round").schema).parquet(f"{path}/raw")
        stream_feed(stream, sources, f"{path}/feed", f"{path}/checkpoint", CFG, pages, buckets=8).awaitTermination()
    feed = current_feed(FeedStore(spark, f"{path}/feed"), sources, CFG)
    return feed.select("id", "title", "kind", "source", seconds("first_seen"), seconds("last_seen"), seconds("deadline"), "carried")


@register(f"""SELECT {_CLEAN("text")} AS cleaned, doc_id FROM documents""")
def clean_html_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(clean_html(F.col("text")).alias("cleaned"), "doc_id")


_WEEK = f"({NOW_SQL} - INTERVAL 7 DAYS)"


@register(f"""WITH f AS (SELECT doc_id, substr(sha1(link), 1, 16) AS id, title, {_KIND_SQL} AS kind, source FROM ({_ITEMS_SQL})
        WHERE len({_matched('t')}) > 0 AND NOT regexp_matches(t, '{_has(CFG.exclude)}') AND {_KIND_SQL} <> 'paper' QUALIFY row_number() OVER (PARTITION BY link ORDER BY doc_id) = 1),
    p AS (SELECT doc_id, id, title, kind, source FROM (SELECT * FROM ({_CLASSIFIED_SQL}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1) WHERE doc_id % 3 = 0),
    al AS (SELECT f.*, CASE WHEN p.id IS NULL THEN {NOW_SQL} ELSE {_WEEK} END AS first_seen, {NOW_SQL} AS last_seen, false AS carried FROM f LEFT JOIN p USING (id)
        UNION ALL SELECT p.*, {_WEEK}, {_WEEK}, true FROM p WHERE id NOT IN (SELECT id FROM f))
    SELECT id, title, kind, source, epoch(first_seen)::BIGINT AS first_seen, epoch(last_seen)::BIGINT AS last_seen, NULL::BIGINT AS deadline, carried FROM al
    QUALIFY kind NOT IN ('job', 'event', 'course') OR row_number() OVER (PARTITION BY kind, {_NORM_SQL} ORDER BY first_seen DESC, carried, doc_id, id) = 1""")
def refresh_feed(spark, sf_dir):
    """The whole job: documents as raw items, a feed before made of every third of them, look-ups on pages."""
    raw = document_items(spark, sf_dir).withColumns({"date": F.lit(""), "deadline": F.lit(""), "source_ord": F.lit(0)})
    sources = stream_sources(raw)
    week = F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    previous = stored(M.first_per_id(classified(spark, sf_dir)).where("item_ord % 3 = 0"), "previous").withColumns({"first_seen": week, "last_seen": week, "deadline_checked": F.lit(None).cast("timestamp"), "call_closed": F.lit(None).cast("boolean")})
    status = sources.select(F.col("id").alias("source_id"), F.lit("ok").alias("state"), F.lit(0).alias("consecutive_failures"))
    pages = table(spark, sf_dir, "documents").select(F.concat(F.lit("https://"), "source", F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("url"), F.col("text").alias("html"))
    done = jobs.refresh_feed(raw, sources, previous, status, NOW, CFG, pages)
    return done.feed.select("id", "title", "kind", "source", seconds("first_seen"), seconds("last_seen"), seconds("deadline"), "carried")


_PROGRAMMES_SQL = """WITH p AS (SELECT p_partkey AS k, p_partkey % 30 AS c, p_name, p_type, 'https://u' || (p_partkey % 30) || '.edu/study/geodesy-' || p_partkey AS url,
        epoch(DATE '2024-06-01' + (p_partkey % 50)::INTEGER)::BIGINT + 86399 AS d FROM part),
    pages AS (SELECT c, k, url, CASE WHEN k % 4 < 2 THEN 0 ELSE 1 END AS prio FROM p UNION ALL SELECT c, k, url || '/dates', 1 FROM p WHERE k % 8 = 1),
    chosen AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY c ORDER BY prio, CASE WHEN prio = 1 THEN 1 ELSE 0 END, url) <= 45 - CASE WHEN prio = 1 THEN 1 ELSE 0 END),
    found AS (SELECT p.*, CASE k % 4 WHEN 0 THEN 'MSc Geomatics ' ELSE 'Bachelor of geodesy ' END || p_name AS title, CASE k % 4 WHEN 0 THEN 'master' ELSE 'bachelor' END AS level,
        CASE WHEN k % 8 = 0 THEN d WHEN k % 12 = 4 THEN d + 86400 END AS own FROM p JOIN chosen USING (c, k, url) WHERE k % 4 < 2),
    first AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY c, lower(title) ORDER BY url) = 1),
    dates AS (SELECT p.c, p.url, p.d - 86400 AS e FROM p JOIN chosen ON chosen.c = p.c AND chosen.url = p.url || '/dates'),
    dated AS (SELECT first.*, coalesce(own, e) AS deadline FROM first LEFT JOIN dates ON dates.c = first.c AND dates.url = first.url)
    SELECT 'u' || c || '.edu' AS site, 'XX' AS country, url, title, 'about ' || p_type AS summary, level, deadline FROM dated
    QUALIFY row_number() OVER (PARTITION BY c ORDER BY deadline IS NULL, url) <= 12"""


@register(_PROGRAMMES_SQL)
def discover_programmes(spark, sf_dir):
    """The programme job over pages built from parts: home pages of 30 universities link to pages of programmes, to pages
    of other things and to dates below a programme; some programmes state a deadline, some on the page where to apply."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"))
    k = F.col("p_partkey")
    site = F.concat(F.lit("https://u"), k % 30, F.lit(".edu/"))
    url = F.concat(site, F.lit("study/geodesy-"), k)
    day = lambda shift: F.date_format(F.date_add(F.lit("2024-06-01").cast("date"), (k % 50).cast("int") + shift), "d MMMM yyyy")
    title = F.when(k % 4 == 0, "MSc Geomatics ").when(k % 4 == 1, "Bachelor of geodesy ").otherwise("Cooking with ")
    own = F.when(k % 8 == 0, F.concat(F.lit("<p>Application deadline: "), day(0), F.lit("</p>"))).otherwise("")
    html = F.concat(F.lit("<title>x</title><meta name='description' content='about "), "p_type", F.lit("'><h1>"), title, "p_name", F.lit("</h1>"), own, F.lit("<a href='/apply/"), k, F.lit("'>How to apply</a>"))
    apply_ = F.concat(F.lit("<p>Closing date: "), day(1), F.lit("</p>"))
    dates = F.concat(F.lit("<p>Deadline: "), day(-1), F.lit("</p>"))
    pages = p.select(url.alias("url"), html.alias("html")).unionByName(p.where(k % 12 == 4).select(F.concat(site, F.lit("apply/"), k).alias("url"), apply_.alias("html"))).unionByName(p.where(k % 8 == 1).select(F.concat(url, F.lit("/dates")).alias("url"), dates.alias("html")))
    link = lambda tail, text: F.concat(F.lit('<a href="/study/geodesy-'), k, F.lit(tail), F.lit('">'), text, F.lit("</a>"))
    named = link("", F.when(k % 4 < 2, "Master and Bachelor").otherwise("Cooking"))
    homes = p.select(site.alias("url"), F.concat(named, F.when(k % 8 == 1, link("/dates", F.lit("Dates"))).otherwise("")).alias("a")).groupBy("url").agg(F.array_join(F.sort_array(F.collect_list("a")), " ").alias("html"))
    sites = homes.select(host(F.col("url")).alias("site"), F.col("url").alias("home"), F.lit("XX").alias("country"))
    pages = stored(pages.unionByName(homes), "programme-pages")
    found = discover_jobs.discover_programmes(pages, discover_jobs.page_links(pages), sites, NOW)
    return found.select("site", "country", "url", "title", "summary", "level", seconds("deadline"))


@register("""WITH p AS (SELECT p_partkey AS k, p_name, p_partkey % 40 AS c, 'https://h' || (p_partkey % 40) || '.org/events/' || p_partkey AS url, epoch(DATE '2027-03-01' + (p_partkey % 28)::INTEGER)::BIGINT AS starts FROM part),
    linked AS (SELECT c, 'Geodesy workshop no ' || k AS title, url, starts, 0 AS depth, '' AS page, row_number() OVER (PARTITION BY c ORDER BY k::VARCHAR) AS pos FROM p),
    own AS (SELECT c, 'Geodesy workshop ' || p_name || ' 2027' AS title, url, starts, 1 AS depth, url AS page, -1 AS pos FROM p QUALIFY row_number() OVER (PARTITION BY c ORDER BY url) <= 11),
    e AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS key FROM (SELECT * FROM linked UNION ALL SELECT * FROM own)),
    f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY c, key ORDER BY depth, page, pos) = 1)
    SELECT 'h' || c || '.org' AS host, title, url, starts, starts + 86399 AS ends, NULL::BIGINT AS deadline FROM f QUALIFY row_number() OVER (PARTITION BY c ORDER BY depth, page, pos, key) <= 15""")
def discover_events(spark, sf_dir):
    """The event job over pages built from parts: hubs link to pages of events."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"))
    k = F.col("p_partkey")
    site = F.concat(F.lit("https://h"), k % 40, F.lit(".org/"))
    event = F.concat(F.lit("<h1>Geodesy workshop "), "p_name", F.lit(" 2027</h1><p>"), (1 + k % 28).cast("string"), F.lit(" March 2027</p>"))
    pages = p.select(F.concat(site, F.lit("events/"), k).alias("url"), event.alias("html"))
    homes = p.select(site.alias("url"), F.concat(F.lit('<a href="/events/'), k, F.lit('">Geodesy workshop no '), k, F.lit("</a>")).alias("a")).groupBy("url").agg(F.array_join(F.sort_array(F.collect_list("a")), " ").alias("html"))
    pages = stored(pages.unionByName(homes), "event-pages")
    hosts = homes.select(host(F.col("url")).alias("host"), "url", F.lit(True).alias("on_topic"))
    found = discover_jobs.discover_events(pages, discover_jobs.page_links(pages), hosts, datetime(2026, 12, 1, tzinfo=UTC))
    return found.select("host", "title", "url", seconds("starts"), seconds("ends"), seconds("deadline"))
