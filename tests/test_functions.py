"""Literal cases of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from archloom.functions import text as X
from archloom.functions import urls as U


def run(spark, expr, **cols):
    names = list(cols)
    row = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} {KINDS[type(cols[n])]}" for n in names)) if names else spark.range(1)
    return row.select(expr.alias("x")).first().x


KINDS = {str: "string", int: "int", list: "array<int>", dt.date: "date", type(None): "string"}


def each(spark, fn, cases):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v string")
    got = {r.i: r.x for r in rows.select("i", fn(F.col("v")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_canonical(spark):
    each(spark, U.canonical, [("https://A.example.org/x?y=1#z", "http://a.example.org/x/"), ("http://a.org/p/q.html", "http://a.org/p/q.html"), ("http://a.org", "http://a.org/"), ("mailto:x@y", None), ("http://a.org/v1.2/x", "http://a.org/v1.2/x"), (None, None)])


def test_pages(spark):
    each(spark, U.is_page, [("http://a.org/", True), ("http://a.org/x/n7.html", True), ("http://a.org/Q.htm", True), ("http://a.org/w.pdf", False), ("http://a.org/Form.php", False), ("http://a.org/contact-form/", False), ("http://a.org/contact-form-2/", False)])


def test_segments(spark):
    each(spark, U.segments, [("http://a.org/x/y.html", ["x", "y"]), ("http://a.org/x/index.html", ["x"]), ("http://a.org/", []), ("http://a.org/x/y/", ["x", "y"])])
    each(spark, U.parent, [("http://a.org/x/y.html", "http://a.org/x/"), ("http://a.org/", None), ("http://a.org/x/", "http://a.org/")])


def test_slugs(spark):
    each(spark, U.slugify, [("Café Ünïque", "cafe-unique"), ("R & D", "r-and-d"), ("It’s", "its"), ("!!!", "page"), ("", "page"), ("a" * 90, "a" * 70)])
    each(spark, U.media_key, [("https://m.org/c/uploads/1987/11/Red Barn.PNG?w=32", "news/1987/red-barn-w32.png"), ("https://x.org/a%b", "news/undated/a-b.jpg")])
    each(spark, U.file_name, [("http://a.org/My%20File.PDF", "my-file.pdf"), ("http://a.org/a+b.doc", "a-b.doc")])


def test_dates(spark):
    each(
        spark,
        X.date_of,
        [
            ("• 1723:", Row(label="1723", year=1723)),
            ("1801—1803", Row(label="1801 – 1803", year=1801)),
            ("late-Nov. 1899", Row(label="late Nov. 1899", year=1899)),
            ("3rd Feb 2001 to 7 March 2002", Row(label="3rd Feb 2001 to 7 March 2002", year=2001)),
            ("between 1640 and 1641", Row(label="between 1640 and 1641", year=1640)),
            ("autumn 1650", Row(label="autumn 1650", year=1650)),
            ("1650 [a fire]", None),
            ("late 1802 / early 1803", Row(label="late 1802 / early 1803", year=1802)),
            ("winter 1802/03", None),
            ("room 1650", None),
            ("12 May", None),
            ("1599", None),
            ("", None),
            (None, None),
        ],
    )
    cases = [(("2 Feb 1801", 1801), "2 Feb"), (("1801", 1801), ""), (("circa 1801", 1801), "circa 1801"), (("1801 – 1803", 1801), "1801 – 1803"), (("June 1801", 1803), "June 1801"), (("1801 – 1803", 1803), "1801 – 1803")]
    rows = spark.createDataFrame([c[0] for c in cases], "l string, y int").select(X.when_of(F.col("l"), F.col("y")).alias("x"))
    assert [r.x for r in rows.collect()] == [c[1] for c in cases]


@pytest.mark.parametrize(
    ("when", "start", "end"),
    [
        ("28 February – 2 March 2024", "2024-02-28", "2024-03-02"),
        ("1, 3 – 5 May 2024", "2024-05-01", "2024-05-05"),
        ("30 December 2024 – 4 January 2025", "2024-12-30", "2025-01-04"),
        ("through 9 Sept. 2024", None, "2024-09-09"),
        ("from 9 June", "2024-06-09", None),
        ("2 January", "2025-01-02", "2025-01-02"),
        ("8 June 2024 at 11 a.m.", "2024-06-08", "2024-06-08"),
        ("31 June 2024", None, None),
        ("27 December – 6 January 2001", "2000-12-27", "2001-01-06"),
        ("27 December – 6 January", "2024-12-27", "2025-01-06"),
        ("27 December 1998 – 6 January", "1998-12-27", "2025-01-06"),
        ("May 6 and 9", "2024-05-06", "2024-05-09"),
        ("4 and 6 May, 1 June 2023", "2023-05-04", "2023-06-01"),
        ("8 p.m. from 4 May 2024", "2024-05-04", "2024-05-04"),
        (None, None, None),
        ("every week", None, None),
        ("June 2024", None, None),
    ],
)
def test_run_dates(spark, when, start, end):
    row = spark.createDataFrame([(when, dt.date(2024, 3, 1))], "w string, d date").select(X.run_dates(F.col("w"), F.col("d")).alias("x")).first().x
    assert (row["from"] and str(row["from"]), row["to"] and str(row["to"])) == (start, end)


def test_names_and_lists(spark):
    each(spark, X.sort_key, [("The Long Road", "Long Road"), ("Another", "Another"), ("a b", "b")])
    assert run(spark, X.rerank(F.col("v")), v=[4, 2, 6, 2, 3]) == [2, 2, 3, 2, 3]
    assert run(spark, X.rerank(F.col("v")), v=[1, 2, 3, 4, 5, 6, 6]) == [2, 3, 4, 5, 6, 6, 6]
    name = lambda a, b: run(spark, X.link_name(F.col("a"), F.col("b")), a=a, b=b)
    assert name("Tickets are sold ", "Click here.") == "Tickets are sold Click here."
    assert name("", "more") == ""
    assert name("All maps are old. Read ", "more") == "All maps are old. Read more"
    assert name("- (a [b]) c ", "link") == "a b c link"
    assert name("one two three four five six seven eight nine ten eleven twelve ", "here") == "three four five six seven eight nine ten eleven twelve here"
    assert name("x", " The Atlas ") == "The Atlas"
    assert run(spark, X.list_label(F.lit("Maps: 1801"), F.lit("Old Maps"), F.lit(""))) == "Maps: 1801"
    assert run(spark, X.list_label(F.lit("Old Maps: 1801"), F.lit("Maps"), F.lit(""))) == "1801"
    assert run(spark, X.list_label(F.lit("Maps"), F.lit("Maps"), F.lit("y\n### A *big* _one_ \n"))) == "A big one"
    links = "<p>old <a href='/a'>x</a></p><li>See<br>our \"map\" <a href='/m'><b>here</b></a>, or <a href='/n'>more</a> <a aria-label='k' href='/o'>here</a>"
    named = links.replace("'/m'>", "'/m' aria-label=\"See our &quot;map&quot; here\">").replace("'/n'>", "'/n' aria-label=\"See our &quot;map&quot; here, or more\">")
    assert run(spark, X.label_links(F.col("v")), v=links) == named
    assert run(spark, X.label_links(F.col("v")), v="no links") == "no links"


def test_markup(spark):
    each(spark, X.visible, [("<b>a</b>&nbsp;&amp;&nbsp;b ", "a & b"), ("x &ndash; y&hellip;", "x — y…")])
    each(spark, X.decode_all, [("&#233;&#128512; &ndash;&#9999999;", "é😀 —&#9999999;"), ("none", "none"), (None, None)])
    each(spark, X.caption, [("one\n\ntwo\n\n#a @b", Row(lines=["one", "two"], tags="#a @b")), ("#a", Row(lines=["#a"], tags=""))])
    each(spark, X.seconds, [("3:05", 185), ("1:00:01", 3601)])
    each(spark, X.posted, [("Updated: 31/12/24", Row(posted=dt.date(2024, 12, 31), revised=True)), ("on 01/02/03", Row(posted=dt.date(2003, 2, 1), revised=False)), ("30/02/24", Row(posted=None, revised=False)), ("soon", Row(posted=None, revised=False))])
    assert run(spark, X.listing_line(F.lit("◦ Maps of Sand at the Old Mill (1 May 2024)"), F.lit("◦ Maps of Sand"))) == Row(title="Maps of Sand", where="The Old Mill", when="1 May 2024")
    listed = lambda lead, bold: tuple(run(spark, X.listing_line(F.lit(lead), F.lit(bold))))
    assert listed("◦ Salt (a study) at Pier Nine (2 May) new", "◦ Salt (a study) at") == ("Salt (a study)", "Pier Nine", "2 May")
    assert listed("◦ An evening of songs", "") == ("An evening of songs", "", "")
    assert listed("◦ With Salt (May)", "Salt") == ("With Salt", "", "May")
    assert run(spark, X.json_ld(F.struct(F.lit("</script>").alias("name")))) == '{"name":"\\u003c/script>"}'
