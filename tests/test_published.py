"""Trees of files, nodes at any depth, and the crawl with claims, on literal rows and against plain versions."""

import json
import random
from unittest import mock

import pytest
from pyspark.sql import functions as F

from archloom.jobs import extraction, graph
from archloom.operators.graph import host_closure
from archloom.sources import documents as D
from archloom.sources.feeds import find_nodes
from archloom.sources.scratch import Scratch
from archloom.sources.trees import read_tree, write_tree


def test_tree_gives_texts_back(spark, tmp_path):
    rows = {"a": "x\n\ny\r\n", "b/c d/é=1": "", "tree/" + "n" * 300: "--- \u2028", "853": "no end", "d%2F": "\n", "..": "dots"}
    df = spark.createDataFrame([*rows.items(), ("none", None)], "id string, text string")
    write_tree(df, str(tmp_path / "t"))
    got = {r.id: r.value for r in read_tree(spark, str(tmp_path / "t")).collect()}
    long = next(k for k in got if "~" in k)
    assert long.startswith("tree/nnn") and len(long) < 100
    want = {k: v for k, v in rows.items() if len(k) < 200}
    assert {k: v for k, v in got.items() if k != long} == {**want, "none": ""} and got[long] == "--- \u2028"
    write_tree(df.limit(0), str(tmp_path / "e"))
    assert read_tree(spark, str(tmp_path / "e")).count() == 0


def test_tree_needs_no_task_for_each_file(spark, tmp_path):
    spark.sparkContext.setJobGroup("tree", "a tree of many files")
    write_tree(spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("text")), str(tmp_path / "t"))
    assert read_tree(spark, str(tmp_path / "t")).where("value = 'x'").count() == 300
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("tree") for s in status.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(i.numTasks for i in map(status.getStageInfo, stages) if i) < 60
    assert len(list((tmp_path / "t").rglob("*.txt"))) == 300


def test_documents_round_trip(spark, tmp_path):
    fields = {"title": 'T "q" \\n x\ny\ttab\r', "year": "12", "empty": "", "gone": None}
    docs = [("tree/a", fields, {"cats": ["u", 'v "w" - x'], "no": []}, "---\nbody\n---\n"), ("b", {}, {}, None)]
    md = D.to_markdown(spark.createDataFrame(docs, "id string, fields map<string,string>, lists map<string,array<string>>, body string"))
    write_tree(md, str(tmp_path / "d"), text="markdown")
    back = D.split_front(read_tree(spark, str(tmp_path / "d")), F.concat(F.lit("tree/"), "id"), "tree")
    names = ["title", "year", "empty", "gone"]
    rows = back.select("id", "body", *[D.front_field(n).alias(n) for n in names], D.front_list("cats").alias("cats"), D.front_list("no").alias("no")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("b", "", None, None, None, None, None, None), ("tree/a", "---\nbody\n---\n", fields["title"], "12", None, None, ["u", 'v "w" - x'], None)]


def test_bare_values_are_read(spark):
    front = "title: Bare: value \nlist:\n  - one\n- \"two\"\nafter: 'x'"
    row = spark.createDataFrame([(front,)], "front string").select(D.front_field("title").alias("t"), D.front_list("list").alias("l"), D.front_field("after").alias("a")).first()
    assert tuple(row) == ("Bare: value", ["one", "two"], "'x'")


def test_quarantine(spark):
    rows = spark.createDataFrame([("", "ftp", 1900, None), ("T", None, None, ["a"]), (None, None, None, None)], "title string, source string, year int, categories array<string>")
    kept, out = D.split_valid(D.validate(rows))
    assert [r.title for r in kept.collect()] == ["T"] and sorted(len(r.errors) for r in out.collect()) == [1, 3]


def plain_nodes(pages, key):
    """Every object under ``key``, in the order of walking fields by name."""
    found = {}

    def walk(page, x, path, depth=0):
        inside = sorted(x.items()) if isinstance(x, dict) else [(None, v) for v in x]
        for i, (name, v) in enumerate(inside):
            if isinstance(v, dict | list):
                if name == key and isinstance(v, dict) and v.get("id") is not None:
                    found.setdefault(str(v["id"]), [(page, [*path, i]), None])[1] = v
                walk(page, v, [*path, i])

    for page, text in pages:
        try:
            x = json.loads(text or "null")
        except ValueError:
            continue
        if isinstance(x, dict | list):
            walk(page, x, [])
    return {k: tuple(v) for k, v in found.items()}


def test_nodes_at_any_depth(spark):
    rng = random.Random(5)

    def make(depth):
        if depth == 0 or rng.random() < 0.15:
            return rng.choice([1, "video", None, {}, []])
        if rng.random() < 0.4:
            return [make(depth - 1) for _ in range(rng.randint(0, 3))]
        x = {name: make(depth - 1) for name in rng.sample(["a", "video", "z"], rng.randint(1, 3))}
        return x | ({"id": rng.choice([7, "7", "w", None])} if rng.random() < 0.6 else {})

    pages = [(n, json.dumps(make(6))) for n in range(60)] + [(60, None), (61, "{"), (62, "3"), (63, "")]
    got = find_nodes(spark.createDataFrame(pages, "page long, json string"), "video", Scratch(spark, "t")).collect()
    assert {r.id: ((r.pos.page, r.pos.path), json.loads(r.node)) for r in got} == plain_nodes(pages, "video")
    assert find_nodes(spark.createDataFrame([], "page long, json string"), "video", Scratch(spark, "t")).count() == 0


def test_many_levels_are_opened_in_a_pass(spark):
    rounds = []

    class Counted(Scratch):
        def keep(self, df):
            rounds.append(df)
            return super().keep(df)

    def nested(depth, inner):
        return inner if depth == 0 else {"a": nested(depth - 1, inner)} if depth % 2 else [nested(depth - 1, inner), "video"]

    def passes(depths):
        rounds.clear()
        pages = [(n, json.dumps(nested(d, {"video": {"id": d % 4, "n": n, "more": [{"video": {"id": "in"}}]}}))) for n, d in enumerate(depths)]
        got = find_nodes(spark.createDataFrame(pages, "page long, json string"), "video", Counted(spark, "t")).collect()
        assert {r.id: ((r.pos.page, r.pos.path), json.loads(r.node)) for r in got} == plain_nodes(pages, "video")
        return len(rounds)

    assert passes(range(7)) == 1
    assert passes(range(30)) == 3


def test_feed_is_dealt_out_before_it_is_parsed(spark, sf):
    plans = []

    class Seen(Scratch):
        def keep(self, df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().keep(df)

    with mock.patch("archloom.jobs.extraction.Scratch", Seen):
        extraction.feed_nodes(spark, sf)
    above, _, below = plans[0].partition("Exchange hashpartitioning(event_id")
    assert "parseJson" in above and below and "parseJson" not in below and len(plans) == 1


def plain_closure(edges, start, given, named):
    """The crawl with one queue."""
    out, taken, seen, hop = {}, set(), set(start), 0
    queue = [(h, None) for h in sorted(set(start))]
    place = 0
    while queue:
        found = {}
        for host, label in queue:
            place += 1
            prefix = given.get(host) or (named(label) if label else None) or None
            status = "no prefix" if not prefix else "claimed" if prefix in taken else "crawled"
            out[host] = (hop, place, label, prefix, status)
            if status == "crawled":
                taken.add(prefix)
                for src, dst, pos, text in edges:
                    if src == host:
                        found[dst] = min(found.get(dst, ((1 << 60,), "")), ((place, pos), text))
        queue = [(h, x[1]) for h, x in sorted(found.items(), key=lambda kv: (kv[1], kv[0])) if h not in seen]
        seen |= {h for h, _ in queue}
        hop += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closure_with_claims(spark, seed):
    rng = random.Random(seed)
    hosts = [f"h{i}" for i in range(30)]
    edges = [(a, b, n, rng.choice(["x", "y", "zz", "w", "v", ""])) for n, (a, b) in enumerate(rng.sample([(a, b) for a in hosts for b in hosts], 70))]
    given = {"h0": "home", "h1": "home", "h5": "x"}
    df = spark.createDataFrame(edges, "src string, dst string, pos long, label string")
    prefixes = spark.createDataFrame(list(given.items()), "host string, prefix string")
    start = spark.createDataFrame([("h1",), ("h0",), ("h0",)], "host string")
    got = host_closure(df, start, prefixes, Scratch(spark, "t"), lambda c: F.when(c != "zz", c)).collect()
    want = plain_closure(edges, ["h0", "h1"], given, lambda t: t if t != "zz" else None)
    assert len(got) == len(want) and {r.host: (r.hop, r.place, r.label, r.prefix, r.status) for r in got} == want
    assert {"claimed", "crawled"} <= {r.status for r in got}
    assert host_closure(df, start.limit(0), None, Scratch(spark, "t")).count() == 0


def test_claims_over_pages(spark, sf):
    edges = [((r.page, r.place), r) for r in graph.host_edges(spark, sf).collect()]
    start = [r.host for r in graph._start(spark, sf).collect()]
    usable = {r.label: r.prefix for r in graph.host_claims(spark, sf).collect() if r.label}
    want = plain_closure([(r.src, r.dst, pos, r.label) for pos, r in edges], start, {h: "sites/" + h.replace(".", "-") for h in start}, usable.get)
    got = {r.host: (r.hop, r.place, r.label, r.prefix, r.status) for r in graph.host_claims(spark, sf).collect()}
    assert got == want and len(got) > len(start)
