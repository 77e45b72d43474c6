"""Operators on literal rows, and every registered query against its SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from archloom.jobs import registry
from archloom.operators import blocks as B
from archloom.operators.graph import build_routes, host_closure
from archloom.sources import documents as D
from archloom.sources.feeds import find_nodes, read_photos
from archloom.sources.scratch import Scratch
from archloom.streaming.incremental import stream_new_pages

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(v):
    return f"{v:.6g}" if isinstance(v, float) else [shown(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr([shown(x) for x in r]) for r in df.select(*cols).collect()) == sorted(repr([shown(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def read(spark, html):
    rows = B.page_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("pos").collect()
    return [(r.type, r.text or r["items"] or r.rows) for r in rows]


def test_blocks(spark):
    html = "<nav><p>menu</p></nav><article><h1>T <b>x</b></h1><p><b>Bold<br>over</b> a <i>break</i><br><br>next <a href='/y'>link</a></p><ul><li>one</li><li>two</li></ul><img src='/a.png' alt='A'><table><tr><td>Venue:</td><td>Hall</td></tr></table><table><tr><td>a</td><td>b</td><td>c</td></tr></table><script>no</script><p>unclosed <b>bold"
    assert read(spark, html) == [("h", "T x"), ("p", "**Bold**\n**over** a *break*"), ("p", "next [link](/y)"), ("list", ["one", "two"]), ("img", "A"), ("p", "**Venue:** Hall"), ("table", [["a", "b", "c"]]), ("p", "unclosed **bold**")]


def test_references_without_their_end_stay(spark):
    html = "<article><h1>a &amp; b &lt;i&gt; cut &amp</h1><p>&quot;R&amp;amp;D&quot; &#233;&#x41; &copy 1 &copyx; <a href='/x?a=1&copy=2&amp;b=3'>y</a> &am</p></article>"
    assert read(spark, html) == [("h", "a & b <i> cut &amp"), ("p", '"R&amp;D" éA &copy 1 &copyx; [y](/x?a=1&copy=2&b=3) &am')]


def test_headings_keep_quotes_escaped(spark, tmp_path, duck):
    html = "<article><h1>key = &quot;a &amp;lt; b&quot; &lt;i&gt; &copy; cut &am</h1><p>x</p></article>"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duck.sql(registry.ORACLE_SQL["page_headings"].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")).fetchall()
    assert [tuple(r) for r in registry.QUERIES["page_headings"](spark, str(tmp_path)).collect()] == want == [(1, 1, "key = &quot;a &lt; b&quot; <i> &copy; cut &am")]


def test_navigation_takes_its_headings(spark):
    rows = [(1, i, t, n) for i, (t, n) in enumerate([("h", False), ("p", False), ("h", False), ("h", False), ("p", True), ("p", True), ("p", False)])]
    kept = B.drop_navigation(spark.createDataFrame(rows, "page_id int, pos int, type string, nav boolean"))
    assert sorted(r.pos for r in kept.collect()) == [0, 1, 6]
    cases = [("[a](/1) | [b](/2)", True), ("see [a](/1) and much more prose than that, as well as [b](/2) here", False), ("**Years** [first page](/1) [second page](/2)", False), ("**Years** [first page](/1) [second page](/1)", True), ("[a](/1)", False)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert df.where(B.is_navigation(F.col("t")) != F.col("want")).count() == 0


def test_layout_pages_are_parsed_once_by_many_tasks(spark, sf):
    from archloom.jobs import extraction as E

    nodes = E._layout_nodes(spark, sf, Scratch(spark, "t"))
    assert "MapInArrow" not in nodes._jdf.queryExecution().optimizedPlan().toString()
    assert len(nodes.inputFiles()) > 1 and sorted(map(repr, nodes.collect())) == sorted(map(repr, B.page_blocks(E.layout_pages(spark, sf)).collect()))


def test_empty_labels(spark):
    def left(ranks):
        rows = [(1, i, r) for i, r in enumerate(ranks)]
        return [r["rank"] for r in B.drop_empty_labels(spark.createDataFrame(rows, "page_id int, pos int, rank int")).orderBy("pos").collect()]

    assert left([2]) == []
    assert left([2, 3, None]) == [2, 3, None]
    assert left([3, 2, None]) == [2, None]
    assert left([2, None, 3]) == [2, None]


def test_facts(spark):
    lines = ["**World Premiere:** 1956", "prose", "**Venue:** Library Theatre", "**Venue:** Elsewhere", "**Banner:** ![x](/y)", "**lower:** no", "**Cast:** a", "**Cast:** b"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "page_id int, pos int, text string")
    assert B.fact_sheets(df).first().facts == {"World Premiere": "1956", "World Premiere Venue": "Library Theatre", "Venue": "Elsewhere", "Cast": "a"}


def test_columns_pair(spark):
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(B.pair_columns(F.col("a"), F.col("b")).alias("x")).first().x
    assert pair(["A:", "B:", "C:"], ["1", "2", "3" * 90]) == [["A:", "1"], ["B:", "2"], ["C:", "3" * 90]]
    assert pair(["A", "B"], ["1", "2"]) is None
    assert pair(["A" * 90, "B", "C"], ["1", "2", "3"]) is None
    assert pair(["• a", "• b", "• c"], ["• d", "• e", "• f"]) is None
    assert pair(["A", "B", "C"], ["1", "2"]) is None


def test_closure_and_claims(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("c", "d", 3), ("b", "e", 4), ("x", "y", 5)], "src string, dst string, pos long")
    prefixes = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "q"), ("d", "r"), ("e", "s"), ("y", "t")], "host string, prefix string")
    got = host_closure(edges, spark.createDataFrame([("a",)], "host string"), prefixes, Scratch(spark, "t"))
    assert {(r.host, r.hop, r.status) for r in got.collect()} == {("a", 0, "crawled"), ("b", 1, "crawled"), ("c", 1, "claimed"), ("e", 2, "crawled")}


def test_routes(spark):
    rows = [("r", None, "Life", 1), ("a", "r", "Life", 1), ("b", "r", "Work", 2), ("c", "r", "Work", 3), ("d", "b", "Essay", 1)]
    got = build_routes(spark.createDataFrame(rows, "id string, parent string, title string, ord int"), Scratch(spark, "t"))
    assert {r.id: r.route for r in got.collect()} == {"r": "life", "a": "life-2", "b": "life/work", "c": "life/work-2", "d": "life/work/essay"}


def test_documents(spark, tmp_path):
    (tmp_path / "plays").mkdir()
    (tmp_path / "index.md").write_text('---\ntitle: "Home"\nsource: "http://a.org/"\n---\nHello\n')
    (tmp_path / "plays" / "x.md").write_text('---\ntitle: "X"\n---\n')
    docs = D.read_markdown(spark, str(tmp_path))
    assert {(r.id, r.body) for r in docs.collect()} == {("welcome", "Hello\n"), ("plays/x", "")}
    assert [tuple(r) for r in D.route_map(docs).collect()] == [("http://a.org", "/welcome")]
    rows = spark.createDataFrame([("", "ftp", 1900, None), ("T", None, None, ["a"])], "title string, source string, year int, categories array<string>")
    got = [(r.errors, r.categories) for r in D.validate(rows).collect()]
    assert got == [(["title is empty", "source is no url", "year is out of range"], []), ([], ["a"])]
    md = D.to_markdown(spark.createDataFrame([("i", {"title": 'a "b"'}, "body")], "id string, fields map<string,string>, body string")).first().markdown
    assert md == '---\ntitle: "a \\"b\\""\n---\nbody'


def test_partial_writes_keep_other_hosts(spark, tmp_path):
    out = str(tmp_path / "out")
    D.write_documents(spark.createDataFrame([("a", 1), ("b", 2)], "host string, n int"), out, part="host")
    D.write_documents(spark.createDataFrame([("a", 3)], "host string, n int"), out, part="host")
    assert {(r.host, r.n) for r in spark.read.parquet(out).collect()} == {("a", 3), ("b", 2)}


def test_feeds(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"items": [{"id": "1", "taken_at": 0, "caption": " x ", "own": {"src": "s"}, "carousel": None}, {"id": "2", "taken_at": 1, "own": None, "carousel": [{"src": "a", "video": True}]}]}))
    rows = read_photos(spark, str(tmp_path / "p.json")).orderBy("id").collect()
    assert [(r.caption, [tuple(p) for p in r.pictures]) for r in rows] == [("x", [("s", "", False)]), ("", [("a", "", True)])]
    pages = spark.createDataFrame([(0, '{"a":[{"video":{"id":"v","n":1}},{"b":{"video":{"id":"w"}}}]}'), (1, '{"video":{"id":"v","n":2}}'), (2, "broken")], "page long, json string")
    got = {r.id: ((r.pos.page, r.pos.path), json.loads(r.node)) for r in find_nodes(pages, "video", Scratch(spark, "t")).collect()}
    assert got == {"v": ((0, [0, 0, 0]), {"id": "v", "n": 2}), "w": ((0, [0, 1, 0, 0]), {"id": "w"})}


def test_streamed_pages_come_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    one = spark.createDataFrame([("u1", "h"), ("u2", "h"), ("u1", "h")], "url string, host string")
    one.write.parquet(str(src))
    for k in range(2):
        stream_new_pages(spark.readStream.schema(one.schema).parquet(str(src)), out, str(tmp_path / f"c{k}")).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["u1", "u2"]


def routed(spark, rows):
    df = spark.createDataFrame(rows, "id string, parent string, title string, ord int, heading string")
    return {r.id: r.route for r in build_routes(df, Scratch(spark, "t")).collect()}


def test_no_two_pages_share_a_route(spark):
    rows = [("a", None, "Work", 1, None), ("b", None, "Work", 2, None), ("c", None, "Work 2", 3, None), ("d", None, "Work", 4, "Old Work"), ("e", None, "Work", 5, "Old Work")]
    rows += [("f", "a", "Work", 1, None), ("g", "a", "Work", 2, None), ("h", "a", "Lot", 1, None), ("i", "gone", "Lost", 1, None), ("j", "b", "", 1, " ")]
    got = routed(spark, rows)
    assert got["a"] == "work"
    assert got["c"] == "work-2"
    assert got["d"] == "old-work"
    assert got["b"] == "work-3" or got["e"] == "work-3"
    assert got["h"] == "work/lot"
    assert got["j"].endswith("/page")
    assert "i" not in got
    assert len(set(got.values())) == len(got) == 9
    assert routed(spark, []) == {}


def test_many_pages_of_one_title_get_all_numbers(spark):
    got = routed(spark, [(f"p{i:03}", None, "Same" if i else "Same 7", i, None) for i in range(60)])
    assert sorted(got.values()) == sorted(["same", *[f"same-{n}" for n in range(2, 61)]])


def test_bodies_are_rewritten(spark):
    from archloom.operators import rewrite as W

    body = '<p>A <a class="k" href="/one?x=1#top"><b>link</b></a>, <A HREF="http://b.org/two/">b</A> <a href="/none">words <i>stay</i></a> <a href="http://x.org/">out</a> <a href="mailto:m@n">m</a> <a name="q">q</a> <a href="/f/Doc.PDF">f</a> <img alt="P" src="/p.jpg"><img src="/lost.jpg"> end'
    pages = spark.createDataFrame([(1, "a.org", body), (2, "a.org", None), (3, "b.org", "no links"), (4, "b.org", '<a href="/one">other host</a>')], "page_id long, host string, body string")
    routes = spark.createDataFrame([("http://a.org/one/", "first/one"), ("http://b.org/two/", "two")], "url string, route string")
    media = spark.createDataFrame([("http://a.org/p.jpg", "m/p.jpg")], "url string, key string")
    found = W.dispositions(W.link_targets(pages), routes, media)
    kinds = {(r.page_id, r.ref): r.kind for r in found.collect()}
    assert kinds == {(1, "/one?x=1#top"): "page", (1, "http://b.org/two/"): "page", (1, "/none"): "unresolved", (1, "http://x.org/"): "kept", (1, "mailto:m@n"): "kept", (1, "/f/Doc.PDF"): "document", (1, "/p.jpg"): "image", (1, "/lost.jpg"): "unresolved", (4, "/one"): "unresolved"}
    got = {r.page_id: r.body for r in W.rewrite_bodies(pages, found).collect()}
    assert got == {1: '<p>A <a href="/first/one#top"><b>link</b></a>, <a href="/two">b</a> words <i>stay</i> <a href="http://x.org/">out</a> <a href="mailto:m@n">m</a> q <a href="/files/doc.pdf">f</a> <img src="/m/p.jpg" alt="P"> end', 2: None, 3: "no links", 4: "other host"}


def boxed(left, right):
    return f"<div class='row'><div class='column'>{'<br>'.join(left)}</div><div class='column'>{'<br>'.join(right)}</div></div>"


SHORT = ["1", "2", "3"]


@pytest.mark.parametrize(
    ("left", "right", "rows"),
    [
        (["a", "b", "c"], SHORT, [["a", "1"], ["b", "2"], ["c", "3"]]),
        (["a", "b"], ["1", "2"], None),  # three lines at least
        (["a", "b", "c"], ["1", "2"], None),
        (["a", "", "b", "c"], ["1", "", "2", ""], None),  # three and two
        (["", "a", "", "b", "c"], ["1", "2", "", "3", ""], [["a", "1"], ["", "2"], ["b", ""], ["c", "3"]]),  # blank lines align
        (["a", "", "b", "c"], SHORT, [["a", "1"], ["b", "2"], ["c", "3"]]),  # they don't
        (["a:", "b:", "c:"], ["One. Two is long. " * 9] * 3, [[f"{x}:", ("One. Two is long. " * 9).strip()] for x in "abc"]),
        (["a", "b", "c"], ["It was one. It was two", "It was one. It was two", "3"], None),  # prose
        (["a", "b", "c"], ["It was one. It was two", "2", "3"], [["a", "It was one. It was two"], ["b", "2"], ["c", "3"]]),
        (["<b>A</b>", "b " * 60, "c"], ["<b>B</b>", "2", "3"], [["**A**", "**B**"], [("b " * 60).strip(), "2"], ["c", "3"]]),
        (["<b>A</b>", "b " * 60, "<b>c</b>"], ["<b>B</b>", "2", "3"], None),  # bold below the head
        (["a", "b " * 60, "c"], SHORT, None),
        (["Place: Rome", "Time: noon", "c"], SHORT, None),  # finished labels and values
        (["• a", "• b", "• c"], ["• d", "• e", "• f"], None),
        (["• a", "• b", "• c"], ["• d", "e", "• f"], [["• a", "• d"], ["• b", "e"], ["• c", "• f"]]),
        ([boxed(["a", "b", "c"], SHORT)], ["x", "y", "z"], [["a", "1", "x"], ["b", "2", "y"], ["c", "3", "z"]]),
        ([boxed(["a:", "b:", "c:"], SHORT)], ["x", "y", "z"], None),  # labels that stand alone
        ([boxed(["a", "b"], ["1", "2"])], ["x", "y"], None),  # what is inside is no table
        ([boxed(["a", "", "b", "c"], ["1", "2", "", "3"])], ["x", "", "y", "z"], [["a", "1", "x"], ["", "2", ""], ["b", "", "y"], ["c", "3", "z"]]),
        (["<h2>A</h2>b", "c"], ["<h3>B</h3>2", "3"], [["A", "B"], ["b", "2"], ["c", "3"]]),
        ([f"a<br>{boxed(['p', 'q', 'r'], SHORT)}"], ["w", "x", "y", "z"], [["a", "w"], ["p", "1", "x"], ["q", "2", "y"], ["r", "3", "z"]]),
        (["<ul><li>a</li></ul>"], ["1"], None),
    ],
)
def test_columns_that_are_tables(spark, left, right, rows):
    from archloom.operators.layout import pair_boxes

    page = spark.createDataFrame([(1, f"<article>{boxed(left, right)}</article>"), (2, None)], "page_id long, html string")
    found = pair_boxes(B.page_blocks(page), Scratch(spark, "t")).orderBy("pos").first()
    assert found.paired == (rows is not None)
    assert (found.lines and [x.cells for x in found.lines]) == rows


def test_page_trees(spark):
    from archloom.operators.layout import page_tree, without_furniture

    three = boxed([boxed(["Ann", "Bo", "Cy"], SHORT)], ["x", "y", "z"])
    html = f"""<article><h1>Title</h1><h2>Name</h2><h2>No</h2><h2>Key</h2>{three}<h2>Short</h2>{boxed(["a", "<b>b</b> c", ""], ["1", "", "3"])}
      <div class='row'><div class='column'>one<br>two<br><br>three<h3>Under</h3>four</div><div class='column'>right</div></div>
      <div class='box'><h4>Box</h4><p>kept</p><h4>Menu</h4><p><a href='/a'>a</a> <a href='/b'>b</a></p></div><aside><h4>Empty</h4><p><b>Only</b><br><b>labels</b></p></aside>
      <h2>Go</h2><p><a href='/a'>a</a> <a href='/b'>b</a></p><p>end<br>Copyright: all</p></article>"""
    pages = spark.createDataFrame([(1, html, "Title"), (2, None, "None")], "page_id long, html string, title string")
    scratch = Scratch(spark, "t")
    tree = page_tree(B.page_blocks(pages), scratch).join(pages.drop("html"), "page_id")
    got = [(r.type, r.aside is not None, r.rows or r.text) for r in without_furniture(tree, "(?i)^copyright", scratch).orderBy("pos").collect()]
    assert got == [
        ("table", False, [["Name", "No", "Key"], ["Ann", "1", "x"], ["Bo", "2", "y"], ["Cy", "3", "z"]]),
        ("h", False, "Short"),
        ("p", False, "a\n**b** c"),
        ("p", False, "1"),
        ("p", False, "3"),
        ("p", False, "one\ntwo"),
        ("p", False, "three"),
        ("h", False, "Under"),
        ("p", False, "four"),
        ("p", False, "right"),
        ("aside", False, None),
        ("h", True, "Box"),
        ("p", True, "kept"),
        ("p", False, "end"),
    ]
