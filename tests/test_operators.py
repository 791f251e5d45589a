import ipaddress
import json
import math

import pytest
from pyspark.sql import functions as F

from webloom import model, tools
from webloom.functions import columns as C
from webloom.functions import hints
from webloom.operators import audits, comparison, extraction, link_graph, search, summaries
from webloom.operators.walk import WalkConfig, duplicate_bodies, stop_reason, walk
from webloom.sources import api_pages, fetches, manifests, sitemaps
from webloom.streaming import ingest


def seo(title="", description="", h1="", words=0, article=0):
    return (title, description, h1, words, article, "")


def pages(spark, rows, *records):
    """rows: (ord, url, status, depth, duplicate, *records)"""
    ddl = model.SNAPSHOT + "".join(f", {r} {model.RECORDS[r]}" for r in records)
    return spark.createDataFrame(rows, ddl)


def test_flags(spark):
    rows = [
        (0, "a", 503, 0, True, None), (1, "b", 404, 0, False, seo()), (2, "c", 200, 0, False, seo("t" * 60, "d" * 160, "h", 0, 150)),
        (3, "d", 200, 0, False, seo("t" * 61, "d" * 161, "h", 0, 149)), (4, "e", 200, 0, False, seo("t" * 29, "d" * 49, "h", 0, 150)), (5, "f", 200, 0, False, seo("😀" * 30 + "x", "", "h", 0, 150)),
    ]
    got = {r["url"]: r["flags"] for r in search.project_pages(pages(spark, rows, "seo")).collect()}
    assert got["a"] == ["ERR_5XX", "WARN_DUPLICATE"] and got["c"] == []
    assert got["b"] == ["ERR_4XX", "ERR_MISSING_H1", "ERR_MISSING_DESC", "WARN_THIN_CONTENT"]
    assert got["d"] == ["WARN_THIN_CONTENT", "WARN_TITLE_TOO_LONG", "WARN_DESC_TOO_LONG"] and got["e"] == ["WARN_TITLE_TOO_SHORT", "WARN_DESC_TOO_SHORT"]
    assert got["f"] == ["ERR_MISSING_DESC", "WARN_TITLE_TOO_LONG"]


def test_search(spark):
    rows = [(k, f"https://e.com/{k}", 200, 0, False, seo("Red", "apple pie", "Green", k * 10, 200)) for k in range(12)] + [(12, "https://e.com/x", 404, 0, False, None)]
    snap = pages(spark, rows, "seo")
    found, total = search.search_pages(snap, limit=3, offset=2, keyword="GREEN APPLE", words=(20, None))
    assert [r["url"] for r in found.collect()] == ["https://e.com/4", "https://e.com/5", "https://e.com/6"] and total.first()[0] == 10
    assert search.search_pages(snap, words=(None, 0))[1].first()[0] == 2  # a page without the record counts as 0 words
    assert search.search_pages(snap, status_code=404)[1].first()[0] == 1 and search.search_pages(snap, has_flag="ERR_4XX")[1].first()[0] == 1
    text = search.pipe_table(search.search_pages(snap, limit=1, fields=("url", "flags"))[0])
    assert text.splitlines() == ["url | flags", "https://e.com/0 | WARN_TITLE_TOO_SHORT,WARN_DESC_TOO_SHORT"]
    assert search.pipe_table(snap.where("false")) == "(no results)"
    with pytest.raises(ValueError):
        search.page_of(snap, limit=101)


def test_sitemap_dates(spark):
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "2024-05-01"), ("d", "2024-05-02T10:00:00+02:00"), ("e", "soon")], "url string, lastmod string")
    keep = lambda bound: [r["url"] for r in search.filter_sitemap(rows, modified_after=bound).collect()]
    assert keep("2024-05-02") == ["a", "b", "d"] and keep("junk") == ["a", "b", "c", "d"]


def test_summary_statistics(spark):
    counts = [100, 150, 499, 500, 5000, 1999]
    snap = pages(spark, [(k, str(k), 200, k % 2, False, seo(article=c)) for k, c in enumerate(counts)], "seo")
    assert summaries.word_statistics(snap, "article_word_count").first().asDict() == {"min": 100, "max": 5000, "median": 500, "avg": 1375}
    assert {r[0]: r[1] for r in summaries.word_buckets(snap).collect()} == {"<150": 1, "150-500": 2, "500-1k": 1, "1k-2k": 1, "2k-5k": 0, "5k+": 1}
    assert summaries.word_statistics(snap.where("false"), "word_count").first().asDict() == {"min": 0, "max": 0, "median": 0, "avg": 0}
    assert {r["flag"]: r["pages"] for r in summaries.flag_totals(snap).collect()}["WARN_THIN_CONTENT"] == 1


def test_sitemap_summary(spark):
    rows = spark.createDataFrame([("https://e.com/a/b", "2024-02-01", "daily", 0.85), ("https://e.com/", "", None, None), ("junk", "2023", "daily", 0.25)], "url string, lastmod string, changefreq string, priority double")
    assert summaries.sitemap_totals(rows).first().asDict() == {"total_urls": 3, "with_lastmod": 2, "with_priority": 2, "oldest_lastmod": "2023", "newest_lastmod": "2024-02-01"}
    # 0.85 lies just below the tie in binary, 0.25 is a tie
    assert {tuple(r) for r in summaries.priority_histogram(rows).collect()} == {("0.8", 1), ("0.3", 1)}
    assert {tuple(r) for r in summaries.url_depth_histogram(rows).collect()} == {(2, 1), (0, 1)} and summaries.changefreq_histogram(rows).first()["urls"] == 2


def graph_snapshot(spark):
    e = "https://e.com"
    link = lambda *to: ([(e + t, f"to {t}", None) for t in to], [])
    rows = [
        (0, e + "/", 200, 0, False, None, link("/a", "/b")), (1, e + "/a", 200, 1, False, None, link("/", "/b/")), (2, e + "/b", 200, 1, False, None, link("/x")),
        (3, e + "/d", 200, 1, True, None, link("/c")), (4, e + "/c", 200, 2, False, None, link()),
    ]
    return pages(spark, rows, "seo", "links")


def test_link_graph(spark):
    graph = link_graph.link_graph(graph_snapshot(spark))
    at = {r["url"].removeprefix("https://e.com"): (r["in_links"], r["out_links"]) for r in graph.nodes.collect()}
    assert at == {"/": (1, 2), "/a": (1, 2), "/b": (2, 0), "/c": (0, 0)}
    assert graph.totals().first().asDict() == {"page_count": 4, "total_internal_links": 4}
    assert [r["url"] for r in link_graph.orphans(graph, "https://e.com/").collect()] == ["https://e.com/c"]
    assert [r["url"] for r in link_graph.by_depth_and_url(link_graph.sinks(graph)).collect()] == ["https://e.com/b", "https://e.com/c"]
    assert {(r["url"], r["linked_from"], r["anchor"]) for r in link_graph.single_path(graph).collect()} == {("https://e.com/", "https://e.com/a", "to /"), ("https://e.com/a", "https://e.com/", "to /a")}
    assert [(r["from"], r["href"]) for r in link_graph.broken_links(graph).collect()] == [("https://e.com/b", "https://e.com/x")]
    assert link_graph.top_pages(graph, "in_links", 1).first()["url"] == "https://e.com/b"


def test_link_graph_last_record_wins(spark):
    none = ([], [])
    rows = [(0, "https://e.com/a/", 200, 0, False, seo("old"), ([("https://e.com/b", "", None)], [])), (1, "https://e.com/b", 200, 1, False, seo("b"), none), (2, "https://e.com/a", 200, 5, False, seo("new"), none)]
    nodes = {r["key"]: r for r in link_graph.link_graph(pages(spark, rows, "seo", "links")).nodes.collect()}
    a = nodes["https://e.com/a"]
    assert (a["title"], a["ord"], a["depth"], a["out_links"]) == ("new", 0, 5, 1) and len(nodes) == 2


def test_comparison(spark):
    robots = lambda v: (None, (v, False, False, False, ""), None, None, [], None)
    e = "https://e.com"
    rows = [(0, e + "/", 200, 0, False, None, None), (1, e + "/n", 200, 1, False, None, robots(True)), (2, e + "/e", 404, 1, False, None, None), (3, e + "/g", 200, 1, False, None, robots(False)), (4, e + "/k", 200, 1, True, None, None)]
    snap = pages(spark, rows, "seo", "meta")
    listed = spark.createDataFrame([(k, e + u) for k, u in enumerate(("/", "/k/", "/s"))], "ord long, url string")
    missing, extra = comparison.sitemap_gaps(snap, listed)
    assert sorted(r["url"] for r in missing.collect()) == [e + "/k/", e + "/s"]
    assert {(r["url"], r["gap"], r["note"]) for r in extra.collect()} == {(e + "/n", "noindex", "noindex, rightly not listed"), (e + "/e", "error", "HTTP 404"), (e + "/g", "genuine", None)}
    assert comparison.gap_counts(missing, extra).first().asDict() == {"captured_not_in_sitemap": 3, "noindex": 1, "error": 1, "genuine": 1, "in_sitemap_not_captured": 2}
    found = comparison.undiscovered(snap, spark.createDataFrame([(e + "/k",), (e + "/z",), (e + "/z",)], "url string"))
    assert [r["url"] for r in found.collect()] == [e + "/z", e + "/z"]
    assert comparison.host_warning("https://a.com", "https://b.com/s.xml") and comparison.host_warning("https://a.com", "https://a.com/s") is None


def test_audits(spark):
    html = {
        "https://e.com/1": '<title>one</title><link rel="canonical" href="https://e.com/1"><meta property="og:title" content="t"><h1>a</h1><h2>b</h2><h4>c</h4><img src="/i" alt="x" width=1 height=1>'
        '<script type="application/ld+json">{"@type":"Article","name":"N"}</script>',
        "https://e.com/2": '<link rel="canonical" href="https://o.com/2"><meta name="robots" content="noindex"><h2>x</h2><h1>y</h1><h1>z</h1><img src="/j"><img src="/k" alt="" loading="lazy">'
        '<link rel="alternate" hreflang="fr" href="/fr"><link rel="alternate" hreflang="de" href="/de">',
        "https://e.com/3": '<link rel="canonical" href="/4"><meta name="viewport" content="w"><script type="application/ld+json">[{"@type":["Article","News"]}]</script>',
        "https://e.com/4": "<p>dup",
    }
    rows = [(k, u, h, 200, k, u.endswith("4")) for k, (u, h) in enumerate(html.items())]
    snap = extraction.extract_records(spark.createDataFrame(rows, "ord long, url string, html string, status_code int, depth int, is_duplicate boolean"))
    m = audits.meta_summary(snap).first().asDict()
    assert (m["pages_analyzed"], m["noindex"], m["missing_canonical"], m["cross_domain_canonical"], m["cross_page_canonical"]) == (3, 1, 0, 1, 1)
    assert (m["missing_open_graph"], m["missing_og_description"], m["missing_viewport"], m["with_hreflang"], m["hreflang_languages"]) == (2, 1, 2, 1, ["de", "fr"])
    assert [r["url"] for r in audits.meta_pages(snap, "cross_page_canonical").collect()] == ["https://e.com/3"]
    assert audits.heading_summary(snap).first().asDict() == {"pages_analyzed": 3, "missing_h1": 1, "multiple_h1": 1, "h1_not_first": 1, "skipped_levels": 1}
    skip = audits.heading_pages(snap, "skipped_levels").first()
    assert (skip["url"], skip["first_skip"], skip["h1_texts"]) == ("https://e.com/1", "H2 → H4", ["a"])
    assert {tuple(r) for r in audits.heading_distribution(snap).collect()} == {(0, 1), (1, 1), (2, 1)}
    i = audits.image_summary(snap).first().asDict()
    assert (i["pages_with_images"], i["total"], i["missing"], i["missing_dims"], i["alt_coverage_rate"], i["lazy_load_rate"], i["pages_with_complete_failure"]) == (2, 3, 1, 2, 50, 33, 0)
    assert [r["url"] for r in audits.worst_images(snap).collect()] == ["https://e.com/2"]
    assert [tuple(r) for r in audits.schema_types(snap).collect()] == [("Article", 2), ("News", 1)] and [tuple(r) for r in audits.schema_types(snap, ("news",)).collect()] == [("News", 1)]
    assert audits.schema_summary(snap).first().asDict() == {"pages_analyzed": 3, "pages_with_schema": 2, "pages_without_schema": 1, "adoption_rate": 67, "unique_types": 2}
    assert [r["url"] for r in audits.pages_without_schema(snap).collect()] == ["https://e.com/2"]
    assert {r["value"] for r in audits.schema_properties(snap, "$.name").collect()} == {"N", None}


def test_own_extractor_and_failures(spark):
    def count(page):
        if "bad" in page.html:
            raise ValueError
        return {"n": len(page.html)}

    rows = spark.createDataFrame([(1, "https://e.com/", "abc"), (2, "https://e.com/", "bad"), (3, None, None)], "ord long, url string, html string")
    got = {r["ord"]: r for r in extraction.extract_records(rows, ("seo",), {"mine": ("struct<n:int>", count)}).collect()}
    assert got[1]["mine"]["n"] == 3 and got[2]["mine"] is None and got[2]["errors"] == ["mine"] and got[2]["seo"] is not None and got[3]["seo"] is None


def test_sitemap_text(spark):
    xml = "<url><loc><![CDATA[https://e.com/a?x=1&y=2]]></loc><priority>0.8 high</priority></url><URL><loc> https://e.com/b?x=1&amp;y=2 </loc><priority>no</priority></URL><url><lastmod>2025-01-01</lastmod></url>"
    files = spark.createDataFrame([(xml,)], "xml string")
    assert [(r["url"], r["priority"]) for r in sitemaps.parse_urlset(files).orderBy("pos").collect()] == [("https://e.com/a?x=1&y=2", 0.8), ("https://e.com/b?x=1&amp;y=2", None)]
    assert sitemaps.seed_locations(files).orderBy("pos").collect()[1]["url"] == "https://e.com/b?x=1&y=2"
    index = spark.createDataFrame([("<sitemapindex><sitemap><loc>u1</loc></sitemap><sitemap><loc>gone</loc></sitemap><sitemap><loc>u2</loc></sitemap></sitemapindex>",)], "xml string")
    children = spark.createDataFrame([("u2", "<url><loc>c</loc></url>"), ("u1", "<url><loc>a</loc></url><url><loc>b</loc></url>")], "url string, xml string")
    assert [r["url"] for r in sitemaps.expand_index(index, children).collect()] == ["a", "b", "c"] and sitemaps.expand_index(index, children, 2).count() == 2
    assert [r["url"] for r in sitemaps.expand_index(files, children).collect()] == ["https://e.com/a?x=1&y=2", "https://e.com/b?x=1&amp;y=2"]


def test_api_pages(spark):
    body = lambda n, **more: json.dumps({"d": {"r": list(range(n))}} | more)
    three = [("a", k, 200, body(n, t=40)) for k, n in enumerate((20, 20, 5))]

    def run(rows, **how):
        items, summary = api_pages.collect_items(spark.createDataFrame(rows, "api string, page_no int, status int, body string"), **how)
        s = summary.first()
        assert items.count() == s["items_collected"]
        return s["items_collected"], s["pages_fetched"], s["natural_end"], s["warning"]

    assert run(three, results_path="d.r") == (45, 3, True, None)
    assert run(three, results_path="d.r", max_items=30) == (40, 2, False, None)
    assert run(three, results_path="d.r", total_path="t") == (40, 2, True, None)
    assert run(three, results_path="d.r", max_pages=1) == (20, 1, False, None)
    assert run([("a", 0, 200, '{"x": 1}')]) == (1, 1, True, None) and run([("a", 0, 200, "[1, 2]")]) == (2, 1, True, None)
    assert run([*three[:1], ("a", 1, 500, "x"), ("a", 2, 200, body(3))], results_path="d.r") == (20, 1, False, "HTTP 500")
    assert run([("a", 0, 200, "oops")], results_path="d.r")[3] == "no JSON" and run([("a", 0, 200, "{}")], results_path="d.r")[3] == "no array at the path"


def site(spark, pages_, redirects=()):
    rows = [(f"https://example.com{u}" if u.startswith("/") or not u else u, 200, b, None, [t if t.startswith("http") else f"https://example.com{t}" for t in to]) for u, b, to in pages_]
    rows += [(f"https://example.com{u}", 302, "", to if to.startswith("http") else f"https://example.com{to}", []) for u, to in redirects]
    return spark.createDataFrame(rows, "url string, status int, body string, location string, targets array<string>")


def captured(result):
    return {r["url"].removeprefix("https://example.com"): (r["depth"], r["is_duplicate"]) for r in result.pages.where("status = 200").collect()}


def test_walk_levels_and_scope(spark):
    store = site(spark, [("", "home", ["/a", "/b", "https://other.com/x"]), ("/a", "A", ["/deep"]), ("/b", "A", ["/only-b"]), ("/deep", "D", []), ("https://other.com/x", "O", [])])
    result = walk(spark, store, WalkConfig("https://example.com", max_depth=1))
    assert captured(result) == {"": (0, False), "/a": (1, False), "/b": (1, True)}
    assert [(r["url"], r["depth"]) for r in result.buried.collect()] == [("https://example.com/deep", 2)]
    assert {tuple(r) for r in result.summary().collect()} == {("MAX_DEPTH", 1)}
    full = walk(spark, store, WalkConfig("https://example.com"))
    assert captured(full)["/deep"] == (2, False) and "/only-b" not in captured(full)  # a duplicate's links are not followed


def test_walk_redirects_and_robots(spark):
    store = site(spark, [("", "h", ["/step1", "/out", "/secret/p", "/gone"]), ("/final", "F", []), ("/secret/p", "S", [])], [("/step1", "/step2"), ("/step2", "/final"), ("/out", "https://other.com/")])
    robots = spark.createDataFrame([("example.com", 200, "User-agent: *\nDisallow: /secret/")], "host string, status int, text string")
    verdicts = fetches.robots_verdicts(store, robots)
    result = walk(spark, store, WalkConfig("https://example.com"), verdicts)
    assert captured(result) == {"": (0, False), "/final": (1, False)}
    assert {tuple(r) for r in result.summary().collect()} == {("REDIRECT", 3), ("ROBOTS", 1)}
    assert [r["status"] for r in result.pages.where("url like '%/gone'").collect()] == [404]


def test_walk_config():
    assert WalkConfig("https://www.e.com/x").domain == "e.com" and stop_reason(False, True) == "drained" and stop_reason(True, True) == "time_limit"
    for bad in (lambda: WalkConfig("ftp://e.com"), lambda: WalkConfig("https://e.com", max_depth=-1), lambda: WalkConfig("https://e.com", include=("a",), exclude=("a",))):
        with pytest.raises(ValueError):
            bad()


def test_duplicate_bodies(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, ""), (4, ""), (5, None), (6, "y")], "ord int, body string")
    assert [r["ord"] for r in duplicate_bodies(rows, "body", ["ord"]).where("is_duplicate").collect()] == [2]


def test_fetches(spark):
    rows = spark.createDataFrame([(bytearray(b"abcdef"), 403, 'Text/HTML; charset="ISO-8859-1"', {"cf-ray": "1"}), (bytearray(b"abc"), 0, None, {})], "body binary, status int, content_type string, headers map<string,string>")
    one, two = fetches.classify(fetches.cap_body(rows, 3)).collect()
    assert (bytes(one["body"]), one["truncated"], one["is_html"], one["is_blocked"], two["truncated"], two["is_broken"]) == (b"abc", True, True, True, False, True)
    assert [r[0]["charset"] for r in rows.select(fetches.content_type(F.col("content_type"))).collect()] == ["iso-8859-1", "utf-8"]


def test_manifests(spark, tmp_path):
    capture_file = {"meta": {"source": "site"}, "pages": [
        {"url": "https://e.com/", "statusCode": 200, "depth": 0, "isDuplicate": False, "mcp.seo": {"title": "T", "wordCount": 3, "articleWordCount": 2},
         "mcp.schema": {"blocks": [{"types": ["A"], "raw": {"@type": "A", "n": 1}}], "types": ["A"], "hasSchema": True}},
        {"url": "https://e.com/b", "statusCode": 404, "depth": 1, "isDuplicate": True}]}
    (tmp_path / "c.json").write_text(json.dumps(capture_file, indent=2))
    kind, snap = manifests.load(spark, "c.json", [str(tmp_path)])
    one, two = snap.orderBy("ord").collect()
    assert kind == "capture" and (one["seo"]["title"], one["seo"]["word_count"], one["seo"]["h1"]) == ("T", 3, None)
    assert json.loads(one["schema"]["blocks"][0]["raw"]) == {"@type": "A", "n": 1} and two["seo"] is None and two["is_duplicate"]
    manifests.save_snapshot(snap, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 2
    entries = spark.createDataFrame([(0, "u", None, "daily", 0.5)], "ord long, url string, lastmod string, changefreq string, priority double")
    manifests.save_sitemap(entries, "s.json", "https://e.com/s.xml", "now", [str(tmp_path)])
    kind, rows = manifests.load(spark, "s.json", [str(tmp_path)])
    assert kind == "sitemap" and rows.first().asDict() == {"ord": 0, "url": "u", "lastmod": None, "changefreq": "daily", "priority": 0.5}
    with pytest.raises(PermissionError):
        manifests.load(spark, "../x.json", [str(tmp_path / "in")])
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        manifests.load(spark, "bad.json", [str(tmp_path)])


def test_url_columns(spark):
    rows = spark.createDataFrame([("HTTP://E.com:81/a?b#c",), ("junk",), (None,)], "u string").select(C.url_parts("u").alias("p"), C.hostname_of("u").alias("h"), C.seen_key("u").alias("s"))
    one, two, three = rows.collect()
    assert one["p"].asDict() == {"scheme": "http", "host": "e.com", "port": 81, "path": "/a", "query": "b", "fragment": "c", "origin": "http://e.com:81"} and one["s"] == "HTTP://E.com:81/a?b"
    assert two["h"] is None and three["h"] is None and two["p"]["scheme"] is None


def test_ingest(spark, tmp_path):
    rows = [("https://e.com/1", "<title>A</title>", "2024-01-01 00:10:00"), ("https://e.com/2", "<title>A</title>", "2024-01-01 00:20:00"), ("https://e.com/3", "<title>B</title>", "2024-01-01 01:20:00")]
    spark.createDataFrame(rows, "url string, html string, at string").select("url", "html", F.to_timestamp("at").alias("captured_at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.distinct_bodies(ingest.page_stream(spark, str(tmp_path / "in")))
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"), ("seo",)).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["seo"]["title"] for r in got.collect()) == ["A", "B"]
    assert math.isclose(got.count(), 2)


def test_private_addresses_as_columns(spark):
    """The column expression against the plain predicate, on the ends of all networks and their neighbours."""
    found = {"", "1.2.3", "1.2.3.4.5", "999.1.1.1", "::", "::1", "fc00::1", "fe80::1", "2001:db8::1", "::ffff:1.1.1.1", "::ffff:10.0.0.1", "::ffff:a00:1", "::FFFF:0808:0808", "::ffff:zz", "junk", "2a00::1"}
    for network in hints.PRIVATE_NETWORKS:
        net = ipaddress.ip_network(network)
        found |= {str(ipaddress.ip_address(n % (1 << 32))) for n in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1)}
    rows = spark.createDataFrame([(x,) for x in [*found, None]], "ip string").select("ip", C.is_private_address("ip").alias("p")).collect()
    assert {r["ip"]: r["p"] for r in rows} == {x: hints.is_private_address(x) for x in found} | {None: None}


def test_duplicates_without_bodies(spark):
    rows = spark.createDataFrame([(1, "x", "s"), (2, None, "s"), (3, "x", "s"), (4, None, "s"), (5, "", "s"), (6, "", "s"), (7, "y", "s")], "n int, body string, sha string")
    assert {r["n"]: r["is_duplicate"] for r in duplicate_bodies(rows, "body", ["n"]).collect()} == {k: k == 3 for k in range(1, 8)}
    assert duplicate_bodies(rows, "body", ["n"]).columns == ["n", "body", "sha", "is_duplicate"]


def test_manifest_folders(spark, tmp_path):
    entries = spark.createDataFrame([(0, "https://e.com/a", "2024-01-01", None, 0.5), (1, "https://e.com/b", None, "daily", None)], "ord long, url string, lastmod string, changefreq string, priority double")
    manifests.save_entries(entries, f"{tmp_path}/s", "https://e.com/s.xml", "now")
    kind, read = manifests.read_saved(spark, f"{tmp_path}/s")
    assert kind == "sitemap" and sorted(map(tuple, read.collect())) == sorted(map(tuple, entries.collect()))
    pages = spark.createDataFrame([("https://e.com/a", "<title>T</title><article><p>" + "word, " * 20 + "</p></article>")], "url string, html string")
    manifests.save_articles(extraction.read_articles(pages), f"{tmp_path}/a", "now")
    kind, read = manifests.read_saved(spark, f"{tmp_path}/a")
    assert kind == "article" and (read.first()["title"], read.first()["length"]) == ("T", 119)
    with pytest.raises(ValueError, match="no meta data"):
        tools.analyse_meta(extraction.extract_records(pages.withColumn("is_duplicate", F.lit(False)), ("seo",)))
