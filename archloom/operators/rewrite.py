"""Bodies rewritten for their new place: links to routes, files and images to their copies, unknown ones to plain words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.functions import text as X
from archloom.functions import urls as U

PIECE = r'(?is)<a\b[^>]*>.*?</a>|<img\b[^>]*>'
HREF = r'(?i)\bhref="([^"]*)"'
SRC = r'(?i)\bsrc="([^"]*)"'


def absolute(href: Column, host: Column) -> Column:
    """A link as an absolute url: root-relative ones belong to ``host``; other relative ones, fragments and mail stay as they are."""
    return F.when(href.startswith("//"), F.concat(F.lit("http:"), href)).when(href.startswith("/"), F.concat(F.lit("http://"), host, href)).otherwise(href)


def link_targets(pages: DataFrame) -> DataFrame:
    """(page_id, ref, url, image) of the different references of each page (page_id, host, body); url is null where it can't be one."""
    pieces = pages.select("page_id", "host", F.explode(F.regexp_extract_all("body", F.lit(PIECE), F.lit(0))).alias("piece"))
    image = F.lower(F.substring("piece", 1, 4)) == "<img"
    ref = F.when(image, F.regexp_extract("piece", SRC, 1)).otherwise(F.regexp_extract("piece", HREF, 1))
    refs = pieces.select("page_id", "host", ref.alias("ref"), image.alias("image")).where("ref <> ''").distinct()
    return refs.select("page_id", "ref", U.canonical(absolute(F.col("ref"), F.col("host"))).alias("url"), "image")


def dispositions(targets: DataFrame, routes: DataFrame, media: DataFrame) -> DataFrame:
    """(page_id, ref, image, kind, to): page, document, image, kept or unresolved, and the new address.

    ``routes``: url (canonical), route. ``media``: url (canonical), key. The links that all pages share are one
    row a page here, and each different url is looked up once.
    """
    urls = targets.select("url").where("url is not null").distinct()
    known = urls.join(routes.groupBy("url").agg(F.min("route").alias("route")), "url", "left").join(media.groupBy("url").agg(F.min("key").alias("key")), "url", "left")
    hosts = routes.select(U.host(F.col("url")).alias("t_host")).distinct().withColumn("ours", F.lit(True))
    known = known.withColumn("t_host", U.host(F.col("url"))).join(hosts, "t_host", "left").drop("t_host")
    met = targets.join(known, "url", "left")
    kind = (
        F.when(F.col("image"), F.when(F.col("key").isNotNull(), "image").otherwise("unresolved"))
        .when(F.col("url").isNull(), F.when(F.col("ref").rlike("^(mailto:|tel:|#)"), "kept").otherwise("unresolved"))
        .when(U.is_document(F.col("url")), "document")
        .when(F.col("route").isNotNull(), "page")
        .when(F.col("ours"), "unresolved")
        .otherwise("kept")
    )
    anchor = F.regexp_extract("ref", "(#.*)$", 1)
    to = F.when(F.col("kind") == "page", F.concat(F.lit("/"), F.col("route"), anchor)).when(F.col("kind") == "image", F.concat(F.lit("/"), F.col("key"))).when(F.col("kind") == "document", F.concat(F.lit("/files/"), U.file_name(F.col("url")))).when(F.col("kind") == "kept", F.col("ref"))
    return met.withColumn("kind", kind).select("page_id", "ref", "image", "kind", to.alias("to"))


def rewrite_bodies(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, body) of the pages (page_id, host, body) with the addresses of ``found`` (as ``dispositions``).

    Anchors that lead nowhere become their words; images without a copy go. A link keeps its inner
    markup and loses its other attributes. Null bodies stay null. A page's addresses are one map, so
    they are as many as the page has different references.
    """
    known = found.where("to is not null").groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat(F.when(F.col("image"), "i").otherwise("a"), F.col("ref")).alias("k"), F.col("to")))).alias("to"))
    rows = pages.select("page_id", "body").join(known, "page_id", "left")
    empty = F.create_map().cast("map<string,string>")

    def new(piece: Column) -> Column:
        image = F.lower(F.substring(piece, 1, 4)) == "<img"
        ref = F.when(image, F.concat(F.lit("i"), F.regexp_extract(piece, SRC, 1))).otherwise(F.concat(F.lit("a"), F.regexp_extract(piece, HREF, 1)))
        to = F.try_element_at(F.coalesce("to", empty), ref)
        inner = F.regexp_extract(piece, r"(?is)^<a\b[^>]*>(.*)</a>$", 1)
        alt = F.regexp_extract(piece, r'(?i)\balt="([^"]*)"', 1)
        shown = F.when(to.isNull(), "").otherwise(F.concat(F.lit('<img src="'), to, F.lit('" alt="'), alt, F.lit('">')))
        return F.when(image, shown).when(to.isNull(), inner).otherwise(F.concat(F.lit('<a href="'), to, F.lit('">'), inner, F.lit("</a>")))

    pieces = F.regexp_extract_all("body", F.lit(PIECE), F.lit(0))
    gaps = F.split("body", PIECE, -1)
    body = X.let(gaps, lambda g: F.concat(F.get(g, 0), F.array_join(F.zip_with(pieces, F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda p, gap: F.concat(new(p), gap)), "")))
    return rows.select("page_id", body.alias("body"))
