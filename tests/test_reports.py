"""Sections against a page-by-page version, and reports on literal rows."""

import random

from pyspark.sql import functions as F

from archloom.operators.report import listed, read_exceptions, read_numbers, write_observed, write_report
from archloom.operators.sections import ordered_children, section_stops
from archloom.sources.scratch import Scratch


def plain_stops(pages):
    """(root, place, id, label, merged, target, under) of (id, title, ord), list by list."""
    titles = {i: t for i, t, _ in pages}
    below = {}
    for i, t, o in pages:
        if "/" in i:
            below.setdefault(i.rpartition("/")[0], []).append((o, i, t))

    def name(t, parent):
        up = titles.get(parent)
        return t.split(": ", 1)[1] if up and t != up and ": " in t and t.split(": ")[0].endswith(up) else t

    lists = {p: [(i, name(t, p)) for _, i, t in sorted(c)] for p, c in below.items()}
    out = []
    for root, kids in lists.items():
        if "/" in root:
            continue
        labels = [k[1] for k in kids]
        merged = root in titles and not (len(kids) > 20 or (len(kids) > 6 and max(map(len, labels)) <= 5))
        for place, (i, label) in enumerate(kids, 1):
            under = lists.get(i, []) if merged else []
            out.append((root, place, i, label, merged, f"{root}#{i.rpartition('/')[2]}" if merged else i, under if len(under) <= 20 else []))
    return sorted(out)


def test_sections_page_by_page(spark):
    rng = random.Random(5)
    pages = []
    for r, (kids, wide) in enumerate([(3, True), (7, False), (6, False), (20, True), (21, True), (45, True), (0, True)]):
        pages.append((f"r{r}", f"Root {r}", r))
        for k in range(kids):
            title = f"Root {r}: stop {k}" if wide and k % 3 else (f"A longer name {k}" if wide else f"{k}")
            pages.append((f"r{r}/k{k}", title, rng.randrange(4)))
            pages += [(f"r{r}/k{k}/{j}", f"leaf {j}", rng.randrange(3)) for j in range(rng.choice([0, 1, 20, 21]))]
    pages += [("gone/a", "Not filed", 1), ("gone/a/b", "deep", 1)]
    rng.shuffle(pages)
    df = spark.createDataFrame(pages, "id string, title string, ord long")
    got = [(r.root, r.place, r.id, r.label, r.merged, r.target, [tuple(u) for u in r.under]) for r in section_stops(df, Scratch(spark, "t")).collect()]
    want = plain_stops(pages)
    assert sorted(got) == want
    assert {m for _, _, _, _, m, _, _ in want} == {True, False} and any(len(w[6]) == 20 for w in want)


def test_no_child_is_dropped(spark):
    n = 3000
    hot = spark.range(n).select(F.concat(F.lit("hot/"), F.col("id").cast("string")).alias("id"), F.lit("x").alias("title"), (-F.col("id")).alias("ord"))
    pages = hot.unionByName(spark.createDataFrame([("hot", "Hot", 0), ("cold", "Cold", 0), ("cold/a", None, None), (None, "none", 1)], "id string, title string, ord long"))
    rows = ordered_children(pages, Scratch(spark, "t")).collect()
    assert sorted((r.place, r.id) for r in rows if r.parent == "hot") == [(i + 1, f"hot/{n - 1 - i}") for i in range(n)]
    assert [(r.place, r.label) for r in rows if r.parent == "cold"] == [(1, None)]
    none = pages.limit(0)
    assert ordered_children(none, Scratch(spark, "t")).count() == 0 and section_stops(none, Scratch(spark, "t")).count() == 0


def test_long_lists_are_placed_by_ranges(spark):
    kids = lambda p, n: spark.range(n).select(F.concat(F.lit(f"{p}/"), F.col("id").cast("string")).alias("id"), F.concat(F.lit(f"{p}: "), F.col("id").cast("string")).alias("title"), (F.col("id") % 3).alias("ord"))
    pages = kids("long", 40).unionByName(kids("lost", 30)).unionByName(kids("short", 5)).unionByName(kids("gone", 2))
    pages = pages.unionByName(spark.createDataFrame([("long", "long", 0), ("short", "short", 0)], "id string, title string, ord long"))
    fields = ("parent", "place", "n", "there", "id", "label")
    dealt, windowed = (sorted(tuple(r[f] for f in fields) for r in ordered_children(pages, Scratch(spark, "t"), most=m).collect()) for m in (10, 1000))
    assert dealt == windowed and len(dealt) == 77
    assert {(p, n, there) for p, _, n, there, _, _ in dealt} == {("long", 40, True), ("lost", 30, False), ("short", 5, True), ("gone", 2, False)}
    assert [r[4:] for r in dealt if r[0] == "short"] == [(f"short/{i}", str(i)) for i in (0, 3, 1, 4, 2)] and dealt[0][5] == "gone: 0"


def test_pages_are_read_once_for_their_children(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pages = spark.range(50).select(F.when(F.col("id") == 0, "p").otherwise(F.concat(F.lit("p/"), F.col("id").cast("string"))).alias("id"), F.lit("t").alias("title"), F.col("id").alias("ord"))
    once = pages.mapInArrow(count, pages.schema)
    assert section_stops(once, Scratch(spark, "t")).count() == 49 and seen.value == 50


def test_numbers_come_from_the_pass_that_writes(spark, tmp_path):
    rows = spark.range(1000, numPartitions=7).select("id", (F.col("id") % 10).alias("k")).repartition(5, "k")
    got = write_observed(rows, str(tmp_path / "a"), rows=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1), total=F.sum("id"))
    assert got == {"rows": 1000, "odd": 500, "total": 499500} and spark.read.parquet(str(tmp_path / "a")).count() == 1000
    assert write_observed(rows.where("id < 0"), str(tmp_path / "b"), rows=F.count("*"), total=F.sum("id")) == {"rows": 0, "total": 0}
    assert write_observed(rows.limit(0), str(tmp_path / "c"), rows=F.count("*")) == {"rows": 0}


def test_report_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("http://a/", None), (None, "x")], "u string, w string")
    folder = str(tmp_path / "r")
    for numbers in ({"pages": 3, "failed": 0}, {"pages": 2, "failed": 1}):  # written anew
        write_report(spark, folder, numbers, listed(rows, "a list", F.col("u"), F.col("w")).unionByName(listed(rows.where("w = 'x'"), "other/list", F.col("w"))))
    assert [tuple(r) for r in read_numbers(spark, folder, ["pages", "failed"]).collect()] == [(2, 1)]
    assert sorted(tuple(r) for r in read_exceptions(spark, folder).collect()) == [("a list", "", "x"), ("a list", "http://a/", ""), ("other/list", "x", "")]
    write_report(spark, folder, {"pages": 0}, listed(rows.limit(0), "a list", F.col("u")))
    assert read_exceptions(spark, folder).count() == 0


def test_pages_are_read_once_for_their_references_and_hosts(spark, sf):
    from archloom.jobs import graph, rewriting

    for job in (rewriting.rewritten_references, graph.unvisited_hosts):
        rows = job(spark, sf)
        assert "html" not in rows._jdf.queryExecution().optimizedPlan().toString()
        assert rows.count() > 0
