"""Hosts, routes and closures by iterated joins. Each round's table is written, so lineage stays short."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.functions import urls as U
from archloom.functions.urls import slugify
from archloom.operators.ranking import numbered
from archloom.sources.scratch import Scratch


def host_closure(edges: DataFrame, start: DataFrame, prefixes: DataFrame | None, scratch: Scratch, named: Callable[[Column], Column] | None = None) -> DataFrame:
    """(host, hop, place, label, prefix, status) of the hosts reached from ``start`` (host) over ``edges`` (src, dst, pos, and label if links have one).

    Hosts are queued in one total order: those of a hop by the place of the host whose link found them first, then by
    that link's ``pos`` (of any type with an order), then by name; ``label`` is that first link's. A host's prefix is that
    in ``prefixes`` (host, prefix), else ``named`` of its label. It is crawled if it has a prefix that no host before it
    in the queue took; others are failures (``no prefix``, ``claimed``), and their links don't count. A host that was
    reached once isn't queued again. No start gives no rows.
    """
    label = F.col("label") if "label" in edges.columns else F.lit(None).cast("string")
    links = edges.select("src", F.col("dst").alias("host"), "pos", label.alias("label"))
    first_of = lambda df, key: df.groupBy(key).agg(F.min(F.struct("place", "pos", "label")).alias("at"))
    begin = start.select("host", F.lit(0).cast("long").alias("place"), F.lit(None).cast(edges.schema["pos"].dataType).alias("pos"), F.lit(None).cast("string").alias("label"))
    frontier, done, hop, queued = scratch.keep(first_of(begin, "host")), None, 0, 0
    while not frontier.isEmpty():
        queue = numbered(frontier.select("host", "at.label", "at"), scratch, "at", "host").select("host", "label", (F.col("n") + queued).alias("place"))
        given = F.lit(None).cast("string")
        if prefixes is not None:
            queue, given = queue.join(prefixes.select("host", F.col("prefix").alias("given")), "host", "left"), F.col("given")
        prefix = given if named is None else F.coalesce(given, named(F.col("label")))
        queue = scratch.keep(queue.select("host", "place", "label", F.nullif(prefix, F.lit("")).alias("prefix")))
        # the first to ask for each prefix, by an aggregation that combines before the shuffle
        first = queue.where("prefix is not null").groupBy("prefix").agg(F.min("place").alias("first_place"))
        met = queue.join(first, "prefix", "left")
        free = F.col("place") == F.col("first_place")
        if done is not None:
            taken = done.where("status = 'crawled'").select("prefix", F.lit(True).alias("taken"))
            met, free = met.join(taken, "prefix", "left"), free & F.col("taken").isNull()
        status = F.when(F.col("prefix").isNull(), "no prefix").when(free, "crawled").otherwise("claimed")
        now = scratch.keep(met.select("host", F.lit(hop).alias("hop"), "place", "label", "prefix", status.alias("status")))
        done = now if done is None else scratch.keep(done.unionByName(now))
        found = links.join(now.where("status = 'crawled'").select(F.col("host").alias("src"), "place"), "src")
        frontier = scratch.keep(first_of(found, "host").join(done.select("host"), "host", "left_anti"))
        hop, queued = hop + 1, done.count()
    return done if done is not None else scratch.spark.createDataFrame([], CLOSURE)


CLOSURE = "host string, hop int, place long, label string, prefix string, status string"
ROUTES = "id string, route string, depth int"


def _place_routes(level: DataFrame, taken: DataFrame, scratch: Scratch, depth: int) -> DataFrame:
    """(id, route, depth) for one level: every row gets a route that is in nobody's hands.

    ``level``: id, ord, base, first (the route by title), second (that by heading, or null). Rounds: by
    title, by heading, then numbers. Of rows that ask for one route the first by (ord, id) gets it. The
    numbers asked for grow by the rows still waiting, so a round settles all but those that meet a taken one.
    """
    todo = scratch.keep(level.withColumn("number", F.lit(0).cast("long")))
    done = None
    turn = 0
    while not todo.isEmpty():
        if turn == 0:
            asked = todo.withColumn("route", F.col("first"))
        elif turn == 1:
            asked = todo.withColumn("route", F.col("second"))
        else:
            # the place among those that wait for the same route, by ranges: one title that all pages have isn't one task
            queue = scratch.keep(numbered(todo, scratch, "first", "ord", "id"))
            queue = queue.join(queue.groupBy("first").agg((F.min("n") - 1).alias("_before")), "first")
            asked = queue.withColumn("number", F.greatest("number", F.lit(1).cast("long")) + F.col("n") - F.col("_before")).drop("n", "_before")
            asked = asked.withColumn("route", F.concat("first", F.lit("-"), F.col("number").cast("string")))
            # whoever asks again begins after all numbers that were asked for
            most = asked.groupBy("first").agg(F.max("number").alias("most"))
            asked = scratch.keep(asked.join(most, "first"))
        used = taken.select("route") if done is None else taken.select("route").unionByName(done.select("route"))
        free = asked.where("route is not null").join(used.distinct(), "route", "left_anti")
        won = free.groupBy("route").agg(F.min(F.struct("ord", "id")).alias("x"))
        won = scratch.keep(won.select("x.id", "route", F.lit(depth).alias("depth")))
        done = won if done is None else done.unionByName(won)
        rest = asked.join(won.select("id"), "id", "left_anti")
        if turn > 1:
            rest = rest.withColumn("number", F.col("most"))
        todo = scratch.keep(rest.select(*todo.columns))
        turn += 1
    return taken.limit(0) if done is None else done


def build_routes(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, route, depth): a readable route for each page, parents before children; no two pages share one.

    ``pages``: id, parent, title, ord, and heading if there is one. The slug of the title goes under the
    parent's route; a slug that repeats the parent's is left out. Where a route is taken, the slug of the
    heading is tried, then ``-2``, ``-3`` and so on. No rows give no rows; rows whose parent is not there
    are not reached.
    """
    heading = F.col("heading") if "heading" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"), "title", "ord", heading.alias("heading"))
    out = scratch.spark.createDataFrame([], ROUTES)
    level, depth = rows.where("parent is null").withColumn("base", F.lit("")), 0

    def under(words: Column) -> Column:
        slug = slugify(words)
        return F.when(F.col("base") == "", slug).when(F.substring_index("base", "/", -1) == slug, F.col("base")).otherwise(F.concat("base", F.lit("/"), slug))

    while True:
        asked = level.select("id", "ord", under(F.col("title")).alias("first"), F.when(F.trim("heading") != "", under(F.col("heading"))).alias("second"))
        now = _place_routes(asked, out, scratch, depth)
        if now.isEmpty():
            return out
        out = scratch.keep(out.unionByName(now))
        level = rows.join(now.select(F.col("id").alias("parent"), F.col("route").alias("base")), "parent")
        depth += 1


def stand_ins(pages: DataFrame) -> DataFrame:
    """(dir, landing): directories that aren't pages themselves and that hold exactly one file, which stands in for them. ``pages``: url."""
    u = F.col("url")
    files = pages.where(U.is_file(u)).groupBy(U.parent(u).alias("dir")).agg(F.count("*").alias("n"), F.min("url").alias("landing")).where("n = 1")
    return files.join(pages.select(u.alias("dir")), "dir", "left_anti").select("dir", "landing")


def _level(url: Column) -> Column:
    """When a page is placed: by the depth of its segments, files before directories."""
    return 2 * F.size(U.segments(url)) + F.when(U.is_file(url), 0).otherwise(1)


def _places(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(dir, level, parent, between) for the pages (url, dir, level) of each directory and level.

    ``parent``: the nearest page above that is placed at an earlier level, a stand-in counting for its directory
    (so neither a stand-in nor an index file is below itself); ``between``: the slugs of labelled directories on the
    way. Each different directory and level is completed once, however many pages it holds.
    """
    dirs = pages.select("dir", "level").where("dir is not null").distinct()
    parts = F.filter(F.split(U.path(F.col("dir")), "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.concat(F.lit("http://"), U.host(F.col("dir")), F.lit("/"), F.array_join(F.transform(F.slice(parts, F.lit(1), i), lambda x: F.concat(x, F.lit("/"))), "")))
    steps = dirs.select("dir", "level", F.size(parts).alias("depth"), F.posexplode(above).alias("k", "step"))
    crawled = pages.select(F.col("url").alias("step"), F.col("level").alias("own_level"))
    landing = stand_ins(pages).select(F.col("dir").alias("step"), "landing", _level(F.col("landing")).alias("landing_level"))
    names = labels.select(F.col("url").alias("step"), slugify(F.col("label")).alias("slug"))
    met = steps.join(crawled, "step", "left").join(landing, "step", "left").join(names, "step", "left")
    at = F.when(F.col("own_level") < F.col("level"), F.col("step")).when(F.col("landing_level") < F.col("level"), F.col("landing"))
    # the root has no name of its own
    met = met.select("dir", "level", "k", at.alias("at"), F.when(F.col("k") < F.col("depth"), F.col("slug")).alias("slug"))
    found = F.min(F.when(F.col("at").isNotNull(), F.struct("k", "at")))
    each = met.groupBy("dir", "level").agg(found.alias("found"), F.collect_list(F.when(F.col("slug").isNotNull(), F.struct("k", "slug"))).alias("named"))
    on = F.filter("named", lambda x: F.col("found").isNull() | (x["k"] < F.col("found.k")))
    return each.select("dir", "level", F.col("found.at").alias("parent"), F.array_join(F.transform(F.reverse(F.array_sort(on)), lambda x: x["slug"]), "/").alias("between"))


#: Names that a page builder gives to directories; such a page is named by its heading.
FILLER = r"(?i)^(page|styled)[-_]?\d*$"


def routes_of_urls(pages: DataFrame, labels: DataFrame, prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """(url, route, depth): a readable route for each page from its url, its label and its place below other pages.

    ``pages``: url (canonical, each once), title, ord. ``labels``: url (canonical, each once), label; directories that
    nobody crawled may have one too. ``prefixes``: host, prefix; pages of other hosts get no route. A route is that
    of the nearest page above (else the host's prefix), the slugs of labelled directories between that nobody
    crawled, and the page's own slug: of its label, of its heading where the name is filler, else of its name. A slug that
    repeats the end of what is above it is left out. Pages are placed level by level, files before directories; in
    a level, of those that ask for one route the first by ``ord`` gets it, others try their heading, then numbers.
    """
    u = F.col("url")
    rows = pages.select("url", "title", "ord", U.host(u).alias("host"), U.segments(u).alias("segments"), F.when(F.size(U.segments(u)) > 0, U.parent(u)).alias("dir"))
    rows = rows.join(prefixes, "host").join(labels, "url", "left")
    rows = scratch.keep(rows.withColumn("level", _level(u)))
    placed = rows.join(_places(rows, labels), ["dir", "level"], "left")
    seg = F.get("segments", F.size("segments") - 1)
    named = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.when(seg.rlike(FILLER), F.nullif(F.trim("title"), F.lit(""))), seg)
    placed = placed.select("url", "ord", "level", "prefix", F.when(F.trim("title") != "", slugify(F.col("title"))).alias("by_title"), F.when(seg.isNotNull(), slugify(named)).alias("slug"), "parent", F.coalesce("between", F.lit("")).alias("between"))
    placed = scratch.keep(placed)
    out = scratch.spark.createDataFrame([], ROUTES)

    def below(base: Column, name: Column) -> Column:
        return F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(name, F.lit("")))

    for level in sorted(r.level for r in placed.select("level").distinct().collect()):  # as many as paths are deep
        now = placed.where(F.col("level") == level).join(out.select(F.col("id").alias("parent"), F.col("route").alias("above")), "parent", "left")
        now = now.withColumn("base", below(F.coalesce("above", "prefix"), F.col("between")))
        repeats = F.col("slug").isNull() | (F.col("base") == F.col("slug")) | F.col("base").endswith(F.concat(F.lit("/"), F.col("slug")))
        first = F.when(repeats, F.col("base")).otherwise(below(F.col("base"), F.col("slug")))
        asked = now.select(F.col("url").alias("id"), "ord", first.alias("first"), below(F.col("base"), F.col("by_title")).alias("second"), "by_title")
        asked = asked.withColumn("second", F.when(F.col("by_title").isNotNull(), F.col("second"))).drop("by_title")
        out = scratch.keep(out.unionByName(_place_routes(asked, out, scratch, level // 2)))
    return out.withColumnRenamed("id", "url")
