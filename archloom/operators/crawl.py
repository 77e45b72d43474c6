"""The pages of each host: its site map's urls if it has any, else those reached from its first page, by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archloom.functions import urls as U
from archloom.sources.scratch import Scratch


def crawl(start: DataFrame, links: DataFrame, scratch: Scratch, *, most: int = 400) -> DataFrame:
    """(host, url, hop) of the urls reached from ``start`` (host, url) over ``links`` (host, url, target).

    A link counts within its host only, and only to what is a page. A host with ``most`` urls or more
    opens no further ones: that is tested between hops, so the last hop is whole. Each hop joins the new
    urls alone; a link that many pages share is one row before the join with what is known.
    """
    edges = scratch.keep(links.where("target is not null").where((U.host(F.col("target")) == F.col("host")) & U.is_page(F.col("target"))).distinct())
    fresh = scratch.keep(start.select("host", "url").distinct().withColumn("hop", F.lit(0)))
    seen, hop = fresh, 0
    while True:
        open_hosts = seen.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") < most).select("host")
        live = fresh.join(open_hosts, "host", "left_semi").select("host", "url")
        found = edges.join(live, ["host", "url"]).select("host", F.col("target").alias("url")).distinct()
        hop += 1
        fresh = scratch.keep(found.join(seen.select("host", "url"), ["host", "url"], "left_anti").withColumn("hop", F.lit(hop)))
        if fresh.isEmpty():
            return seen
        seen = scratch.keep(seen.unionByName(fresh))


def host_urls(mapped: DataFrame, crawled: DataFrame) -> DataFrame:
    """(host, url, via): the site map's urls (host, url) of hosts that have any, the crawl's of all others."""
    known = mapped.select("host", "url").distinct()
    rest = crawled.join(known.select("host").distinct(), "host", "left_anti").select("host", "url", F.lit("crawl").alias("via"))
    return known.withColumn("via", F.lit("map")).unionByName(rest)


def site_map_urls(maps: DataFrame) -> DataFrame:
    """(host, url) of the pages that site maps (host, xml) list: trimmed, in one spelling, on their own host only."""
    each = maps.select("host", F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>([^<]+)</loc>"), F.lit(1))).alias("loc"))
    urls = each.select("host", U.canonical(F.trim("loc")).alias("url")).where("url is not null")
    return urls.where((U.host(F.col("url")) == F.col("host")) & U.is_page(F.col("url"))).distinct()


def last_sources(named: DataFrame) -> DataFrame:
    """(name, url): the url that each document name stands for, the last by (page, pos) where there are more."""
    return named.groupBy("name").agg(F.max_by("url", F.struct("page", "pos", "url")).alias("url"))


def poster_of(images: DataFrame) -> DataFrame:
    """``images`` (page_id, pos, src, landing) with ``poster``: is this the first image of a landing page, or a repeat of it?"""
    first = F.first("src").over(Window.partitionBy("page_id").orderBy("pos", "src"))
    return images.withColumn("poster", F.coalesce(F.col("landing") & (F.col("src") == first), F.lit(False)))


def kept_images(images: DataFrame, bodies: DataFrame, described: DataFrame) -> DataFrame:
    """(page_id, name, poster, alt, waiting) of the images that the finished body, or the poster, names.

    ``images``: page_id, pos, src, landing, alt (the page's own, or empty) and captioned. ``described``: name,
    alt (written by hand; brackets and backslashes are escaped, a name without an entry has ''). An image
    waits for words if it has no entry, no own alt, no caption, and is no poster. Images are joined with
    their own page's body only.
    """
    name = F.substring_index("src", "/", -1)
    rows = poster_of(images).withColumn("name", name).join(bodies.select("page_id", "body"), "page_id", "left")
    rows = rows.where(F.col("poster") | F.coalesce(F.contains("body", "name"), F.lit(False)))
    rows = rows.groupBy("page_id", "name").agg(F.bool_or("poster").alias("poster"), F.max("alt").alias("own"), F.bool_or("captioned").alias("captioned"))
    rows = rows.join(described.groupBy("name").agg(F.min("alt").alias("said")), "name", "left")
    alt = F.regexp_replace(F.coalesce("said", F.lit("")), r"([\[\]\\])", r"\\$1")
    waiting = F.col("said").isNull() & (F.coalesce("own", F.lit("")) == "") & ~F.col("poster") & ~F.coalesce("captioned", F.lit(False))
    return rows.select("page_id", "name", "poster", alt.alias("alt"), waiting.alias("waiting"))
