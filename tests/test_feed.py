"""Rules of the feed on hand-made rows."""

import re
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from feedjobs.config import FeedConfig
from feedjobs.functions.text import clean_html, clean_page, matched_terms, norm_title
from feedjobs.functions.urls import base_domain, expand_since, host, resolve_url, same_site
from feedjobs.operators import classify as C
from feedjobs.operators import discover as D
from feedjobs.operators import merge as M
from feedjobs.operators.keys import first_per_key, top_n_per_site
from feedjobs.operators.robots import robots_allows, robots_rules
from feedjobs.operators.status import update_status
from feedjobs.sources.bodies import items_from_jsonld, items_from_links
from feedjobs.sources.catalogue import validate_sources

NOW = datetime(2026, 10, 29, tzinfo=UTC)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, clean_html(F.lit("<![CDATA[a &amp;amp; b]]> &lt;b&gt;c&lt;/b&gt;&#8211;d"))) == "a & b c –d"
    assert one(spark, clean_html(F.lit(None).cast("string"))) == ""
    assert one(spark, clean_page(F.lit("<script>x</script>a &lt;b&gt;&nbsp;c"))) == "a <b> c"
    assert one(spark, norm_title(F.lit("PhD (m/f) Position [x]: A-B"))) == "phd position a b"
    assert one(spark, matched_terms(F.lit("InSAR and GIS2, ÜGIS"), ["SAR", "GIS", "InSAR"])) == ["GIS", "InSAR"]


def test_one_scan_equals_a_pattern_for_each_term(spark):
    """Terms that overlap, begin each other, hold or end in signs and digits, in any case, with letters around."""
    import random

    from feedjobs.config import FeedConfig
    from feedjobs.functions.text import any_among, found_terms, terms_among, word_pattern

    cfg, r = FeedConfig(), random.Random(3)
    lists = [["geo", "geo-AI", "Geo-AI maps", "AI", "maps of", "of", "3D", "3D map", "Ph.D.", "2026", "é", "straße", "GIS", "gis", "I", "sign in", "in", "C++", "a b a", "b a b"], list(cfg.terms), [*cfg.exclude, *(w for words in cfg.kinds.values() for w in words)]]
    for terms in lists:
        bits = [*terms, *terms, " ", "-", ".", "x", "3", "É", "STRASSE", "ſ", "\u0130", "\u0131", "\u212a", "\n", "+"]
        texts = [" ".join(r.choice(bits) for _ in range(6)) if k % 2 else "".join(r.choice(bits) for _ in range(6)) for k in range(400)]
        texts = [r.choice((str.upper, str.lower, str))(t) for t in texts] + ["", "geo-AI maps of 3D maps", None]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        found = found_terms(F.col("t"), terms)
        want = F.filter(F.array(*[F.when(F.col("t").rlike(word_pattern([t])), F.lit(t)) for t in terms]), lambda t: t.isNotNull())
        rows = df.select("t", terms_among(found, terms).alias("got"), want.alias("want"), any_among(found, terms[:5]).alias("some"), F.coalesce(F.col("t").rlike(word_pattern(terms[:5])), F.lit(False)).alias("some_want")).collect()
        assert [r for r in rows if r["got"] != r["want"]] == [] and all(r["some"] == r["some_want"] for r in rows)
        assert sum(len(r["got"]) > 1 for r in rows) > 100


def test_urls(spark):
    r = lambda h, b: one(spark, resolve_url(F.lit(h), F.lit(b)))
    assert r("/a", "https://X.org/b/c") == "https://x.org/a" or r("/a", "https://X.org/b/c") == "https://X.org/a"
    assert r("../z?q=1", "https://x.org/b/c/d") == "https://x.org/b/z?q=1"
    assert r("https://y.org/p", None) == "https://y.org/p"
    assert r("http://[bad", "https://x.org/") is None
    assert one(spark, base_domain(F.lit("www.geo.ox.ac.uk"))) == "ox.ac.uk"
    assert one(spark, host(F.lit("https://www.A.org:8/x"))) == "a.org"
    assert one(spark, same_site(F.lit("https://b.a.org/"), F.lit("a.org"), "subdomain"))
    assert one(spark, expand_since(F.lit("u?f={since:7}&g={since:0}"), F.lit(NOW).cast("timestamp"))) == "u?f=2026-10-22&g=2026-10-29"


def test_classify_order(spark):
    rows = [
        ("GIS PhD position open now", "https://a/1", "2026-10-01", "job", None, None),  # passed deadline of a job
        ("MSc GIS programme", "https://a/2", "2026-10-01", "course", None, None),  # stays, closed
        ("GIS workshop 2027", "https://a/3", "2026-10-01", "event", "2027-01-01", "2027-01-02"),  # deadline cleared
        ("GIS workshop 2025", "https://a/4", "", "event", "2025-01-01", "2025-01-02"),  # over
        ("GIS Newsletter", "https://a/5", "", "auto", None, None),  # excluded
        ("Cooking", "https://a/6", "", "auto", None, None),  # no term
        ("GIS news", "", "", "auto", None, None),  # no link
        ("GIS study", "https://a/8", "soon", "auto", None, None),  # unreadable deadline passes; below the impact
        ("GIS today", "https://a/9", "soon", "auto", None, None),
    ]
    raw = spark.createDataFrame(rows, "title string, link string, deadline string, source_kind string, starts string, ends string")
    raw = raw.withColumns({"summary": F.lit(""), "source_id": F.lit("s"), "date": F.lit("")})
    got = {r["url"][-1]: r for r in C.classify(raw, FeedConfig(), NOW).collect()}
    assert sorted(got) == ["2", "3", "9"]
    assert got["2"]["apply_closed"] and got["2"]["deadline"] is None
    assert got["3"]["deadline"] is None and str(got["3"]["ends"])[:10] == "2027-01-02"
    assert got["9"]["kind"] == "news" and got["9"]["deadline"] is None and got["9"]["matched"] == ["GIS"]


def test_merge_is_idempotent_and_keeps_lookups(spark):
    fresh = spark.createDataFrame([("a", "s1", "job", 0, 0, 0)], "id string, source string, kind string, source_ord int, part_ord int, item_ord int").withColumn("deadline", F.lit(None).cast("timestamp"))
    prev = spark.createDataFrame([("a", "s1", datetime(2026, 10, 1), datetime(2026, 10, 20), datetime(2026, 12, 1), datetime(2026, 10, 28)), ("b", "s1", datetime(2026, 10, 1), datetime(2026, 10, 20), None, None), ("c", "s2", datetime(2026, 10, 1), datetime(2026, 10, 20), None, None)], "id string, source string, first_seen timestamp, last_seen timestamp, deadline timestamp, deadline_checked timestamp").withColumn("kind", F.lit("job"))
    sources = spark.createDataFrame([("s1", "html", True), ("s2", "rss", True)], "id string, type string, enabled boolean")
    status = spark.createDataFrame([("s1", "ok"), ("s2", "ok")], "source_id string, state string")
    run = lambda p: M.carry_forward(M.merge_feed(fresh, p, NOW), p, status, sources, ("html",))
    first = run(prev)
    got = {r["id"]: r for r in first.collect()}
    assert sorted(got) == ["a", "c"] and str(got["a"]["deadline"])[:10] == "2026-12-01" and str(got["a"]["first_seen"])[:10] == "2026-10-01"
    again = run(first.select(*prev.columns))
    key = lambda df: sorted((r["id"], str(r["first_seen"]), str(r["deadline"])) for r in df.collect())
    assert key(again) == key(first)


def test_dedupe_prefers_deadline(spark):
    t = datetime(2026, 10, 1)
    rows = [("1", "job", "PhD (A)", None, t), ("2", "job", "PhD [B]", t, t), ("3", "job", "PhD", t, t), ("4", "news", "PhD", None, t), ("5", "news", "PhD", None, t)]
    df = spark.createDataFrame(rows, "id string, kind string, title string, deadline timestamp, first_seen timestamp")
    assert sorted(r["id"] for r in M.dedupe_cross_source(df).collect()) == ["2", "4", "5"]


def test_status(spark):
    prev = spark.createDataFrame([("a", "ok", 4), ("b", "ok", 5), ("c", "ok", 1)], "source_id string, state string, consecutive_failures int")
    stats = spark.createDataFrame([("c", 3, 1), ("d", 0, 0)], "source_id string, items_found long, items_matched long")
    errors = spark.createDataFrame([("a", "x" * 300)], "source_id string, error string")
    sources = spark.createDataFrame([(x, True) for x in "abcd"] + [("e", False)], "id string, enabled boolean")
    got = {r["source_id"]: r for r in update_status(prev, stats, errors, sources, NOW).collect()}
    assert got["a"]["state"] == "error" and got["a"]["consecutive_failures"] == 5 and len(got["a"]["last_error"]) == 200
    assert got["b"]["state"] == "paused" and got["c"]["consecutive_failures"] == 0 and got["d"]["state"] == "ok" and "e" not in got


@pytest.mark.parametrize(
    ("rows", "error"),
    [
        ([("a", "A", "http://x.org", "rss", True)], "must use HTTPS"),
        ([("a", "A", "not a url", "rss", True)], "invalid URL"),
        ([("a", "A", "https://x.org", "rss", True), (" a", "B", "https://x.org", "rss", True)], "Duplicate enabled source id"),
        ([("a", "A", "https://x.org", "json", True)], "unsupported type"),
        ([("a", "A", "https://x.org", "rss", False)], "No enabled sources configured"),
        ([("a", "A", "https://x.org", "rss", True), ("b", "", "", "", False)], None),
    ],
)
def test_catalogue(spark, rows, error):
    df = spark.createDataFrame(rows, "id string, name string, url string, type string, enabled boolean").withColumn("kind", F.lit(None).cast("string"))
    if error:
        with pytest.raises(ValueError, match=error):
            validate_sources(df)
    else:
        assert [r["id"] for r in validate_sources(df).collect()] == ["a"]


def test_robots(spark):
    body = "User-agent: a\nUser-agent: B\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nDisallow: /\n"
    rules = robots_rules(spark.createDataFrame([("https://s", body)], "origin string, body string"))
    urls = spark.createDataFrame([("https://s/x",), ("https://s/x/y",), ("https://s/z",), ("https://t/x",)], "url string")
    allowed = lambda agent: [r["allowed"] for r in robots_allows(urls, rules, agent).orderBy("url").collect()]
    assert allowed("b") == [False, True, True, True]
    assert allowed("other") == [False, False, False, True]


def test_robots_of_many_rules(spark):
    """Against all rules of an origin, one by one; the plan compares no path with all rules of its origin."""
    import random

    r = random.Random(7)
    part = lambda: "".join(r.choice("ab/") for _ in range(r.randint(1, 6)))
    rules = [(f"https://{o}", r.choice(("allow", "disallow")), f"/{part()}") for o in "xy" for _ in range(150)]
    paths = sorted({(f"https://{o}", f"/{part()}{part()}") for o in "xyz" for _ in range(300)})
    body = [(o, "User-agent: *\n" + "\n".join(f"{t}: {p}" for q, t, p in rules if q == o)) for o in ("https://x", "https://y")]
    urls = spark.createDataFrame([(o + p + "#f",) for o, p in paths], "url string")
    judged = robots_allows(urls, robots_rules(spark.createDataFrame(body, "origin string, body string")), "bot")
    best = lambda o, p, kind: max((len(x) for q, t, x in rules if q == o and t == kind and p.startswith(x)), default=-1)
    want = {o + p + "#f": best(o, p, "disallow") < 0 or best(o, p, "allow") >= best(o, p, "disallow") for o, p in paths}
    assert {x["url"]: x["allowed"] for x in judged.collect()} == want and len(set(want.values())) == 2
    plan = judged._jdf.queryExecution().toString()
    assert not re.search(r"Join[^\n]*StartsWith", plan) and "NestedLoop" not in plan


def test_deadlines_from_pages_above_and_below(spark):
    """Against all pairs of a site: pages below, above, next to a programme, with and without slashes, queries, ties."""
    import random

    r = random.Random(5)
    url = lambda: "https://u.org/" + "/".join(r.choice(("faculty-of-geodesy", "a", "b")) for _ in range(r.randint(0, 4))) + r.choice(("", "/", "?q=/a"))
    programmes = [(s, u, d) for s in ("s", "t") for u, d in {(url(), None) for _ in range(60)}] + [("s", "https://u.org/has", 5)]
    aux = [(r.choice("st"), r.choice((url(), "https://u.org")), r.choice((None, i)), i // 2) for i in range(120)]
    root = lambda u: re.sub("/$", "", re.sub(r"[?#].*$", "", u))
    want = {}
    for s, u, d in programmes:
        near = [(o, a, x) for t, a, x, o in aux if t == s and x is not None and (a.startswith(root(u) + "/") or root(u).startswith(re.sub("/$", "", a) + "/") and len(a) > len("https://u.org") + 12)]
        want[s, u] = d if d is not None or not near else min(near)[2]
    got = D.inherit_deadline(spark.createDataFrame(programmes, "site string, url string, deadline long"), spark.createDataFrame(aux, "site string, url string, deadline long, ord int"))
    seen = {(x["site"], x["url"]): x["deadline"] for x in got.collect()}
    assert seen == want and len({v for v in want.values()}) > 5
    assert "StartsWith" not in got._jdf.queryExecution().toString()


def test_a_round_deals_out_only_its_frontier(spark):
    from feedjobs.config import EVENT_CRAWL
    from feedjobs.storage import stored_by

    links = spark.range(500).select(F.concat(F.lit("https://a.org/"), F.col("id") % 50).alias("from_url"), F.concat(F.lit("https://x.a.org/"), "id").alias("href"), F.lit("events").alias("text"))
    frontier = spark.range(3).select(F.lit("a").alias("site"), F.lit("a.org").alias("site_host"), F.concat(F.lit("https://a.org/"), "id").alias("url"))
    edges = stored_by(links, "from_url", "test_links", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = D.follow(frontier, edges.rows, D.Selection(EVENT_CRAWL, D.event_priority, D.EVENT_SKIP_PATH), 0)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin") :]
    assert join.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in join
    edges.drop()
    assert not spark.catalog.tableExists(edges.name)


def test_sitemaps_that_may_not_be_read(spark):
    origins = spark.createDataFrame([("https://a",), ("https://b",), ("https://c",)], "origin string")
    announced = spark.createDataFrame([("https://a", "https://a/no/1.xml", 0), ("https://a", "https://a/1.xml", 1), ("https://a", "https://a/1.xml", 2), ("https://z", "https://a/1.xml", 0)], "origin string, sitemap string, item_ord int")
    rules = robots_rules(spark.createDataFrame([("https://a", "User-agent: *\nDisallow: /no/")], "origin string, body string"))
    page = lambda n: f"<urlset><loc>https://a/geodesy/{n}</loc><loc>https://a/x</loc></urlset>"
    bodies = spark.createDataFrame([("https://a/no/1.xml", page(0)), ("https://a/1.xml", page(1)), ("https://a/sitemap.xml", "<sitemapindex><loc>https://a/1.xml</loc><loc>https://a/2.xml</loc><loc>https://a/no/2.xml</loc></sitemapindex>"), ("https://a/2.xml", page(2)), ("https://a/no/2.xml", page(3)), ("https://b/sitemap.xml", None)], "url string, body string")
    got = D.sitemap_urls(origins, announced, bodies, rules, reads=3).collect()
    assert {(r["origin"], r["loc"], r["item_ord"] >> 32) for r in got} == {("https://a", "https://a/geodesy/1", 1), ("https://a", "https://a/geodesy/2", 3)}
    assert D.sitemap_urls(origins.limit(0), announced, bodies).count() == 0


def test_links_and_structured_data(spark):
    html = '<a href="/a">A link of words</a><a href="/a">A second link text</a><a href="x y">short</a><a href="b?c=1#d">Another good link</a>'
    ld = '<script type="application/ld+json">[{"@graph":[{"@type":"Course","name":"C &amp; D","url":"c"}]},{"@type":"Event","name":"no link"}]</script><script type="application/ld+json">{bad</script>'
    df = spark.createDataFrame([("https://s.org/p/", html, ld)], "url string, body string, ld string")
    assert [r["link"] for r in items_from_links(df.drop("ld")).orderBy("item_ord").collect()] == ["https://s.org/a", "https://s.org/p/b?c=1#d"]
    rows = items_from_jsonld(df.select("url", F.col("ld").alias("body"))).collect()
    assert {r["link"] for r in rows} >= {"https://s.org/p/c"} and rows[0]["title"] == "C & D"


def test_gate_of_one_day_events(spark):
    rows = [("Big GIS workshop", "2026-10-31", "2026-10-31"), ("Big GIS meeting", "2026-10-31", "2026-11-02"), ("Events", "2027-01-01", "2027-01-01")]
    df = spark.createDataFrame(rows, "title string, s string, e string").select("title", F.to_timestamp("s").alias("starts"), (F.to_timestamp("e") + F.expr("INTERVAL 86399 SECONDS")).alias("ends"), F.lit("").alias("ctx"), F.lit("x.org").alias("host"), F.lit(True).alias("on_topic"))
    assert [r["title"] for r in D.event_gate(df, NOW, ["GIS"]).collect()] == ["Big GIS meeting"]


def test_first_and_top_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), F.xxhash64("id").alias("o"), F.col("id").alias("v"))
    for n in (1, 8):
        d = df.repartition(n)
        assert sorted(map(tuple, first_per_key(d, ["k"], ["o"]).collect())) == sorted(map(tuple, first_per_key(df.coalesce(1), ["k"], ["o"]).collect()))
        assert top_n_per_site(d, "k", 3, ["o"]).count() == 21


def test_empty_inputs(spark):
    raw = spark.createDataFrame([], "title string, link string, summary string, deadline string, source_id string, date string")
    feed = C.classify(raw, FeedConfig(), NOW)
    assert feed.count() == 0 and M.dedupe_cross_source(feed.withColumn("first_seen", F.lit(NOW).cast("timestamp"))).count() == 0


def test_refresh_verifies_adverts_of_loose_boards(spark):
    from feedjobs.plans.feed import refresh_feed

    raw = spark.createDataFrame(
        [("b", 0, 0, "GNSS engineer position open", "https://b/1", ""), ("b", 0, 1, "Engineer position open now", "https://b/2", ""), ("b", 0, 2, "Engineer position open here", "https://b/3", ""), ("b", 0, 3, "Engineer position not read", "https://b/4", "GNSS"), ("b", 0, 4, "Engineer position seen before", "https://b/5", "")],
        "source_id string, source_ord int, item_ord int, title string, link string, summary string",
    ).withColumns({"date": F.lit(""), "deadline": F.lit("")})
    sources = spark.createDataFrame([("b", "Board", "jobsacuk", "job", True, False, None, True)], "id string, name string, type string, kind string, trusted boolean, on_topic boolean, tag string, enabled boolean")
    pages = spark.createDataFrame([("https://b/2", "<p>Engineer position open now with GNSS</p>"), ("https://b/3", "<p>nothing</p>")], "url string, html string")
    verdicts = spark.createDataFrame([("https://b/5", 2, True, "GNSS", NOW)], "link string, v int, ok boolean, terms string, at timestamp")
    none = "id string, source string, kind string, first_seen timestamp, last_seen timestamp"
    status = spark.createDataFrame([], "source_id string, state string, consecutive_failures int")
    done = refresh_feed(raw, sources, spark.createDataFrame([], none), status, NOW, FeedConfig(), pages, verdicts=verdicts)
    assert {r["url"] for r in done.feed.collect()} == {"https://b/1", "https://b/2", "https://b/5"}
    assert {(r["link"], r["ok"]) for r in done.verdicts.collect()} == {("https://b/2", True), ("https://b/3", False), ("https://b/5", True)}
    assert done.status.first()["items_found"] == 3
