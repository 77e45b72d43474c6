"""Relative references and routes of real urls, against other implementations."""

import random
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from archloom.functions import urls as U
from archloom.jobs import graph
from archloom.operators.graph import FILLER, routes_of_urls, stand_ins
from archloom.sources.scratch import Scratch


def test_relative_references_are_read_as_the_standard_library_reads_them(spark):
    r = random.Random(7)
    pieces = ["a", "b.html", "..", ".", "x y", "c;d", "é"]  # it drops empty segments
    bases = ["http://h.org", "http://h.org/", "https://h.org/p/q.html", "http://h.org:8080/p/q/?k=/../v#f", "http://h.org/p/./q/../r/"]
    refs = ["?n=1", "#top", "?n=1#top", "//g.org", "//g.org/a/../b", "http://g.org/a/./b?c#d", "mailto:a@b", "tel:1", "data:x/../y", "g:h"]
    refs += ["/".join(r.choices(pieces, k=r.randrange(1, 7))) + r.choice(["", "", "?x=../y", "#a/../b"]) for _ in range(300)]
    pairs = [(h, b) for h in refs for b in bases if not h.startswith(("//", " ")) or h.startswith("//g")]
    rows = spark.createDataFrame(pairs, "href string, base string")
    got = {(x.href, x.base): x.u for x in rows.select("href", "base", U.resolve(F.col("href"), F.col("base")).alias("u")).collect()}

    def want(href, base):
        """urljoin keeps the dots of a base and of absolute references, and a bare origin without ``/``."""
        u = urljoin(base, href)
        if urlsplit(u).scheme not in ("http", "https"):
            return u
        s = urlsplit(u)
        whole = urlsplit(urljoin(f"{s.scheme}://{s.netloc}/", s.path or "/"))
        back = s._replace(path=whole.path).geturl()
        return back + "?" * (href == "?") + "#" * (href == "#")

    assert {k: v for k, v in got.items() if v != want(*k)} == {}


@pytest.mark.parametrize(
    ("href", "base", "want"),
    [
        (" \n/x\t", "http://h.org/a/", "http://h.org/x"),
        ("..\\x\\y?a\\b", "http://h.org/a/b/c", "http://h.org/a/x/y?a\\b"),
        ("%2E%2e/x/%2e", "http://h.org/a/b/", "http://h.org/a/x/"),
        ("../../../../x", "http://h.org/a/", "http://h.org/x"),
        ("HTTP://H.org", "http://b.org/", "http://H.org/"),
        ("", "http://h.org/a/b?c#d", "http://h.org/a/b?c"),
        ("..//x", "http://h.org/a/b/", "http://h.org/a//x"),
        ("x", "ftp://h.org/", None),
        ("x", None, None),
        (None, "http://h.org/", None),
        ("http:x", "http://h.org/a/", None),
        ("//g.org/x", "", None),
        ("http://g.org/x", "", "http://g.org/x"),
        ("javascript:void(0)", "http://h.org/", "javascript:void(0)"),
    ],
)
def test_odd_references(spark, href, base, want):
    row = spark.createDataFrame([(href, base)], "h string, b string").select(U.resolve(F.col("h"), F.col("b")).alias("u"))
    assert row.first().u == want


# -- routes of urls


def parts_of(url):
    parts = [x for x in urlsplit(url).path.split("/") if x]
    if parts and "." in parts[-1]:
        stem = parts[-1]
        return parts[:-1] if stem.lower().startswith(("index.", "default.")) else [*parts[:-1], stem.rsplit(".", 1)[0]]
    return parts


def folders_of(url):
    """Folders above a url, the nearest first."""
    s = urlsplit(url)
    parts = [x for x in s.path.split("/") if x][:-1]
    return [f"http://{s.hostname}/" + "".join(x + "/" for x in parts[:k]) for k in range(len(parts), -1, -1)]


def is_file(url):
    return "." in urlsplit(url).path.rsplit("/", 1)[-1]


def brute_routes(pages, labels, prefixes, slugs):
    """Page by page in each level, in rounds as documented."""
    import re

    pages = {u: (t, o) for u, t, o in pages if urlsplit(u).hostname in prefixes}
    files = {}
    for u in pages:
        if is_file(u):
            files.setdefault(folders_of(u)[0], []).append(u)
    landing = {d: us[0] for d, us in files.items() if len(us) == 1 and d not in pages}
    route, used = {}, set()

    def base_of(u):
        between, host = [], urlsplit(u).hostname
        for d in folders_of(u) if parts_of(u) else []:
            at = d if d in pages else landing.get(d) if landing.get(d) != u else None
            if at in route:
                return [route[at], *reversed(between)]
            if d in labels and urlsplit(d).path != "/":
                between.append(slugs[labels[d]])
        return [prefixes[host], *reversed(between)]

    level = lambda u: (len(parts_of(u)), not is_file(u))
    for k in sorted({level(u) for u in pages}):
        asked = []
        for u in sorted((u for u in pages if level(u) == k), key=lambda u: (pages[u][1], u)):
            base = "/".join(x for x in base_of(u) if x)
            title = (pages[u][0] or "").strip()
            name = parts_of(u)[-1] if parts_of(u) else None
            if name is not None:
                name = slugs[(labels.get(u) or "").strip() or (title if re.match(FILLER, name) and title else name)]
            same = name is None or base == name or base.endswith("/" + name)
            join = lambda *x: "/".join(y for y in x if y)
            asked.append((u, base if same else join(base, name), join(base, slugs[title]) if title else None))
        for turn in (1, 2):
            free = {}
            for row in asked:
                if row[turn] is not None and row[turn] not in used:
                    free.setdefault(row[turn], row[0])
            route.update({u: r for r, u in free.items()})
            used |= set(free)
            asked = [row for row in asked if row[0] not in route]
        yield_numbers(asked, route, used)
    return route


def yield_numbers(asked, route, used):
    """Numbers: each one waiting for a route asks for one more than the one before it, then all begin anew after those."""
    start = {}
    while asked:
        place, free = {}, {}
        for u, first, _ in asked:
            place[first] = place.get(first, 0) + 1
            r = f"{first}-{max(start.get(first, 0), 1) + place[first]}"
            if r not in used:
                free.setdefault(r, u)
        for first, n in place.items():
            start[first] = max(start.get(first, 0), 1) + n
        route.update({u: r for r, u in free.items()})
        used |= set(free)
        asked = [row for row in asked if row[0] not in route]


def check_routes(spark, pages, labels, prefixes):
    texts = {t for _, t, _ in pages if t} | set(labels.values()) | {p for u, _, _ in pages for p in parts_of(u)}
    rows = spark.createDataFrame([(t,) for t in {x.strip() for x in texts} | {"x"}], "t string")
    slugs = {r.t: r.s for r in rows.select("t", U.slugify(F.col("t")).alias("s")).collect()}
    found = routes_of_urls(spark.createDataFrame(pages, "url string, title string, ord long"), spark.createDataFrame(list(labels.items()), "url string, label string"), spark.createDataFrame(list(prefixes.items()), "host string, prefix string"), Scratch(spark, "t"))
    got = {r.url: r.route for r in found.collect()}
    assert got == brute_routes(pages, labels, prefixes, slugs)
    assert len(set(got.values())) == len(got)
    return got


def test_ancestors_and_stand_ins(spark):
    h = "http://h.org/"
    pages = [(h + "index.html", "Home", 1), (h + "life/Story.html", "A Story", 2), (h + "life/early/1950/", "Fifty", 3), (h + "page-3/", "Third: Way", 4), (h + "page-3/styled-4/work.html", "", 5), (h + "page-3/styled-4/other.html", None, 6), ("http://g.org/x/", "No prefix", 7), (h + "life/story/", "Twice", 8)]
    labels = {h + "life/early/": "Early & Young", h + "page-3/styled-4/": "Works", h + "page-3/styled-4/other.html": "Works", h: "never used"}
    got = check_routes(spark, pages, labels, {"h.org": "plays/h"})
    assert got[h + "index.html"] == "plays/h"
    assert got[h + "life/Story.html"] == "plays/h/story"  # the only file stands in for its folder
    assert got[h + "life/early/1950/"] == "plays/h/story/early-and-young/1950"
    assert got[h + "page-3/styled-4/work.html"] == "plays/h/third-way/works/work"
    assert got[h + "page-3/styled-4/other.html"] == "plays/h/third-way/works"
    assert got[h + "life/story/"] == "plays/h/story/twice"
    assert "http://g.org/x/" not in got


def test_routes_of_many_urls(spark):
    r = random.Random(1)
    folders, names = ["a", "b", "page-1", "styled", "d.v2"], ["", "a", "b", "styled", "c.html", "index.html", "Default.htm", "page.html"]
    urls = {f"http://{r.choice('hgk')}.org/" + "".join(f"{x}/" for x in r.choices(folders, k=r.randrange(4))) + r.choice(names) for _ in range(150)}
    urls = {u if "." in urlsplit(u).path or u.endswith("/") else u + "/" for u in urls}
    pages = [(u, r.choice(["", None, "Old Map", "New Map", "B"]), k) for k, u in enumerate(sorted(urls, key=lambda _: r.random()))]
    folders = {d for u in urls for d in folders_of(u)}
    labels = {u: r.choice(["B", "Maps", "a"]) for u in sorted(urls | folders) if r.random() < 0.3}
    check_routes(spark, pages, labels, {"h.org": "plays/x", "g.org": "plays/x", "k.org": ""})


def test_routes_of_the_given_pages(spark, sf):
    found = graph.url_routes(spark, sf).collect()
    urls = spark.read.parquet(f"{sf}/pages.parquet").select(U.canonical(F.col("url")).alias("u")).distinct()
    assert {r.url for r in found} == {r.u for r in urls.collect()}
    assert len({r.route for r in found}) == len(found)
    assert stand_ins(urls.select(F.col("u").alias("url"))).count() > 0
