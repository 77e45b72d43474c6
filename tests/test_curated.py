"""Crawls, kept images, listings, chronologies, casts and feeds on literal rows."""

import json

from pyspark.sql import functions as F

from archloom.functions import prose as P
from archloom.operators import crawl as C
from archloom.operators import lines as L
from archloom.operators.ranking import numbered
from archloom.sources import feeds
from archloom.sources.scratch import Scratch

A, B = "http://a.org", "http://b.org"


def test_crawl_stays_on_its_host_and_stops_at_its_bound(spark):
    links = spark.createDataFrame(
        [("a.org", f"{A}/", f"{A}/x/"), ("a.org", f"{A}/", f"{A}/x/"), ("a.org", f"{A}/x/", f"{A}/y/"), ("a.org", f"{A}/x/", f"{B}/"), ("a.org", f"{A}/y/", f"{A}/p.jpg"), ("a.org", f"{A}/y/", f"{A}/"), ("a.org", f"{A}/y/", None)],
        "host string, url string, target string",
    )
    start = spark.createDataFrame([("a.org", f"{A}/"), ("b.org", f"{B}/")], "host string, url string")
    reach = lambda **k: {(r.url, r.hop) for r in C.crawl(start, links, Scratch(spark, "t"), **k).collect()}
    assert reach() == {(f"{A}/", 0), (f"{A}/x/", 1), (f"{A}/y/", 2), (f"{B}/", 0)}
    assert reach(most=2) == {(f"{A}/", 0), (f"{A}/x/", 1), (f"{B}/", 0)}
    assert C.crawl(start.limit(0), links, Scratch(spark, "t")).count() == 0


def test_site_map_goes_before_crawl(spark):
    maps = spark.createDataFrame([("a.org", f"<loc> {A}/x </loc><loc>{A}/x/</loc><loc>{B}/y</loc><loc>{A}/i.png</loc>"), ("b.org", ""), ("c.org", None)], "host string, xml string")
    mapped = C.site_map_urls(maps)
    assert [tuple(r) for r in mapped.collect()] == [("a.org", f"{A}/x/")]
    crawled = spark.createDataFrame([("a.org", f"{A}/z/"), ("b.org", f"{B}/")], "host string, url string")
    assert {tuple(r) for r in C.host_urls(mapped, crawled).collect()} == {("a.org", f"{A}/x/", "map"), ("b.org", f"{B}/", "crawl")}


def test_kept_images(spark):
    images = spark.createDataFrame(
        [(1, 1, "/m/poster.jpg", True, "", False), (1, 2, "/m/in.jpg", True, "", False), (1, 3, "/m/gone.jpg", True, "", False), (2, 1, "/m/said.jpg", False, "", False), (2, 2, "/m/own.jpg", False, "words", False), (3, 1, "/m/x.jpg", None, None, None)],
        "page_id int, pos int, src string, landing boolean, alt string, captioned boolean",
    )
    bodies = spark.createDataFrame([(1, "![](_images/in.jpg)"), (2, "said.jpg own.jpg gone.jpg"), (3, None)], "page_id int, body string")
    said = spark.createDataFrame([("said.jpg", "A [big] \\ one")], "name string, alt string")
    assert sorted(tuple(r) for r in C.kept_images(images, bodies, said).collect()) == [
        (1, "in.jpg", False, "", True), (1, "poster.jpg", True, "", False), (2, "own.jpg", False, "", False), (2, "said.jpg", False, "A \\[big\\] \\\\ one", False),
    ]


def test_last_source_wins(spark):
    rows = spark.createDataFrame([("a.pdf", "u1", 1, 2), ("a.pdf", "u2", 2, 0), ("b.pdf", "u3", 1, 0)], "name string, url string, page int, pos int")
    assert {tuple(r) for r in C.last_sources(rows).collect()} == {("a.pdf", "u2"), ("b.pdf", "u3")}


def test_listing_rows(spark):
    rows = [
        (1, 1, "<p>Hello &amp; welcome</p>"), (1, 2, "<p><strong>May 2031</strong></p>"), (1, 3, '<p>◦ <strong>Dinner at Eight</strong> at the Old Hall (1 – 9 May)<br/>Seats <a href="/s">here</a></p>'),
        (1, 4, f"<p><b>{'long ' * 12}</b></p>"), (1, 5, "<p>◦ <b>Tea</b></p>"), (1, 6, ""), (1, 7, None), (2, 1, "<p>◦ Plain</p>"),
    ]
    out = L.listing_rows(spark.createDataFrame(rows, "page_id int, pos int, markup string")).orderBy("page_id", "pos").collect()
    assert [(r.pos, r.kind, r.heading, r.title, r.venue, r.dates, r.detail, r.href) for r in out] == [
        (1, "intro", None, None, None, None, None, None), (3, "item", "May 2031", "Dinner at Eight", "The Old Hall", "1 – 9 May", "Seats here", "/s"), (5, "item", "May 2031", "Tea", "", "", "", None), (1, "item", None, "Plain", "", "", "", None),
    ]
    pages = spark.createDataFrame([("TEA ", "plays/tea"), ("Tea", "plays/tea-2")], "title string, route string")
    posters = spark.createDataFrame([("plays/tea", "t.jpg")], "route string, poster string")
    found = L.listing_targets(spark.createDataFrame([("tea",), ("x",), (None,)], "title string"), pages, posters)
    assert {tuple(r) for r in found.collect()} == {("tea", "plays/tea", "t.jpg"), ("x", None, None), (None, None, None)}


def test_timeline_rows(spark):
    text = ["Lead\n**1 May 1901** Opens\n.. and closes\n○ More", "**1902**", "plain", "**Tours**\nsays\n**1903** A\n**○** B\n**○ C**d\n**June 1904**\n.. E"]
    rows = [(1, i, t) for i, t in enumerate(text, 1)] + [(1, 5, "**1905**\n**1906**"), (2, 1, "**1905** too few"), (3, 1, None), (3, 2, "")]
    out = L.timeline_rows(spark.createDataFrame(rows, "page_id int, pos int, text string")).orderBy("page_id", "run", "entry", F.desc("kind")).collect()
    assert [(r.run, r.entry, r.kind, r.year, r.events) for r in out] == [
        (1, 0, "prose", None, ["Lead"]), (1, 1, "date", 1901, ["Opens and closes", "More"]), (1, 2, "date", 1902, []),
        (2, 1, "prose", None, ["says"]), (2, 1, "label", None, ["Tours"]), (2, 2, "date", 1903, ["A", "B", "**C**d"]), (2, 3, "date", 1904, ["E"]), (2, 4, "date", 1905, []), (2, 5, "date", 1906, []),
    ]


def test_cast_tables(spark):
    text = ["**Set** Ann\n**Part** **Actor**\n**Jo** Bo", "**Side** **Goals**\n**Red** 2", "note\n**Part** **Actor**\n**Jo** Bo", "**Part** **Actor**\nno row", "**Part** **Actor**", None, ""]
    out = L.cast_tables(spark.createDataFrame([(i, 0, t) for i, t in enumerate(text)], "page_id int, pos int, text string")).orderBy("page_id").collect()
    assert [(r.page_id, r.caption, r.columns, [tuple(x) for x in r.credits], [tuple(x) for x in r.rows]) for r in out] == [
        (0, "Cast", ["Part", "Actor"], [("Set", "Ann")], [("Jo", "Bo")]), (1, None, ["Side", "Goals"], [], [("Red", "2")]),
    ]


def test_quotations_and_extracts(spark):
    text = ['"Short"\n(A very long source of it, 1990)', "A body longer than its source is\n(Post, 1990)", "Short\n(A very long source of it, 1990)", "“Open without a source”"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(P.kind(F.col("t"))).collect()] == ["quotation", "extract", "prose", "quotation"]


def test_video_details_and_feed_columns(spark):
    html = '{"uploadDate":"2030-01-02","shortDescription":" one\\ntwo \\"q\\" \\\\ "}'
    rows = spark.createDataFrame([("a", html), ("b", "<p>"), ("c", None)], "id string, html string")
    assert {tuple(r) for r in feeds.video_details(rows).collect()} >= {("a", "2030-01-02", 'one\ntwo "q" \\'), ("b", None, "")}
    nodes = spark.createDataFrame([("x", 0, '{"k":3,"title":{"text":" T "},"overlays":[{"badge":null},{"badge":"1:02"}]}'), ("y", 60, "{}")], "key string, taken long, node string")
    shown = nodes.select(*feeds.feed_columns(F.col("key"), F.col("taken"), F.from_json("node", feeds.FEED_NODE))).orderBy("id").collect()
    assert [tuple(r) for r in shown] == [("x", "/p/x/", "1970-01-01 00:00:00", "T", 3, "1:02"), ("y", "/p/y/", "1970-01-01 00:01:00", "", 0, "")]


def test_curated_pages_and_feed_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.json").write_text(json.dumps([{"slug": "news", "content": {"rendered": "<p>x</p>"}, "modified": "2030-01-02T03:04:05"}, {"slug": "empty"}]))
    got = {r.slug: (r.content, str(r.modified)) for r in feeds.read_pages(spark, str(tmp_path / "in")).collect()}
    assert got == {"news": ("<p>x</p>", "2030-01-02 03:04:05"), "empty": ("", "None")}
    feeds.write_feed(spark.createDataFrame([("a",)], "id string"), str(tmp_path / "out"), "2030-01-01")
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("id", "updated").collect()] == [("a", "2030-01-01")]


def test_numbered(spark):
    rows = [(None, 7), ("b", 1), ("b", 0), ("a", 3)] + [("c", i) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, k int").repartition(5)
    out = numbered(df, Scratch(spark, "t"), "s", "k").orderBy("n").collect()
    assert [(r.s, r.k) for r in out] == sorted(rows, key=lambda r: (r[0] or "", r[1])) and [r.n for r in out] == list(range(1, 205))
    assert numbered(df.limit(0), Scratch(spark, "t"), "s", "k").count() == 0


def test_timelines_sort_their_lines_once(spark):
    rows = spark.createDataFrame([(1, 1, "x")], "page_id long, pos int, text string")
    plan = L.timeline_rows(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [page_id") == 1, plan


def test_what_is_below_a_label_is_prose_of_its_own(spark):
    days = "\n".join(f"**{d} May 1990** day {d}\n.. on" for d in range(1, 7))
    text = f"lead\n.. lead on\n{days}\n**A label**\nbelow\n.. below on\n**7 May 1990**\n.. first\nsecond"
    rows = spark.createDataFrame([(1, 0, text), (1, 1, "**8 May 1990**"), (1, 2, "no day"), (1, 3, "**9 May 1990**"), (2, 0, "**1 May 1990**")], "page_id long, pos int, text string")
    got = [(r.page_id, r.run, r.entry, r.kind, list(r.events)) for r in L.timeline_rows(rows).orderBy("run", "entry", "kind").collect()]
    days = [(1, 1, d, "date", [f"day {d} on"]) for d in range(1, 7)]
    after = [(1, 1, 7, "label", ["A label"]), (1, 1, 7, "prose", ["below", "below on"]), (1, 1, 8, "date", ["first", "second"]), (1, 1, 9, "date", []), (1, 2, 1, "date", [])]
    assert got == [(1, 1, 0, "prose", ["lead", "lead on"]), *days, *after]
