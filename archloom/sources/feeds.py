"""Feeds: paged JSON of posts, photo posts and video listings, read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.functions.text import pictures_of
from archloom.sources.scratch import Scratch

POSTS = "id BIGINT, date TIMESTAMP, slug STRING, title STRUCT<rendered: STRING>, content STRUCT<rendered: STRING>, excerpt STRUCT<rendered: STRING>, categories ARRAY<BIGINT>, link STRING"
PICTURE = "STRUCT<src: STRING, width: INT, height: INT, alt: STRING, video: BOOLEAN>"
PHOTOS = f"items ARRAY<STRUCT<id: STRING, taken_at: BIGINT, caption: STRING, own: {PICTURE}, carousel: ARRAY<{PICTURE}>>>"


def read_posts(spark: SparkSession, folder: str) -> DataFrame:
    """All pages of a posts feed at once: one JSON array to a file."""
    return spark.read.schema(POSTS).option("multiLine", True).json(folder)


def read_photos(spark: SparkSession, folder: str) -> DataFrame:
    """Photo posts: permalink, time, trimmed caption, pictures (the carousel's, else the post's own)."""
    items = spark.read.schema(PHOTOS).option("multiLine", True).json(folder).select(F.explode("items").alias("x"))
    return items.select(F.col("x.id").alias("id"), F.timestamp_seconds("x.taken_at").alias("date"), F.trim(F.coalesce("x.caption", F.lit(""))).alias("caption"), pictures_of(F.col("x.carousel"), F.col("x.own")).alias("pictures"))


#: A feed's node: the count of views, a nested title, overlays of which one holds the length.
FEED_NODE = "k BIGINT, title STRUCT<text: STRING>, overlays ARRAY<STRUCT<badge: STRING>>"


def feed_columns(key: Column, taken: Column, node: Column) -> list[Column]:
    """id, permalink, date (of epoch seconds, UTC text), title, views and badge (the first overlay's that has one) of a feed node; absent ones are empty or 0."""
    badge = F.get(F.filter(node["overlays"], lambda o: F.coalesce(o["badge"], F.lit("")) != ""), 0)["badge"]
    return [
        key.cast("string").alias("id"),
        F.concat(F.lit("/p/"), key.cast("string"), F.lit("/")).alias("permalink"),
        F.date_format(F.timestamp_seconds(taken), "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.trim(F.coalesce(node["title"]["text"], F.lit(""))).alias("title"),
        F.coalesce(node["k"], F.lit(0)).alias("views"),
        F.coalesce(badge, F.lit("")).alias("badge"),
    ]


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, content, modified) of curated pages: one JSON object or array to a file."""
    rows = spark.read.schema("slug STRING, content STRUCT<rendered: STRING>, modified TIMESTAMP").option("multiLine", True).json(folder)
    return rows.select("slug", F.coalesce("content.rendered", F.lit("")).alias("content"), "modified")


def video_details(pages: DataFrame) -> DataFrame:
    """(id, published, description) of video pages (id, html): the upload date, and the text that the page's script holds as a JSON string."""
    raw = F.regexp_extract("html", r'"shortDescription":"((?:[^"\\]|\\.)*)"', 1)
    said = F.from_json(F.concat(F.lit('{"x":"'), raw, F.lit('"}')), "x STRING")["x"]
    return pages.select("id", F.nullif(F.regexp_extract("html", r'"uploadDate":"([^"]+)"', 1), F.lit("")).alias("published"), F.coalesce(F.trim(said), F.lit("")).alias("description"))


def write_feed(rows: DataFrame, folder: str, updated: str) -> None:
    """The rows as JSON lines, each with the time of the run."""
    rows.withColumn("updated", F.lit(updated)).write.mode("overwrite").json(folder)


#: As many levels of a text are opened in one pass; those below are written, and opened in the next.
LEVELS = 12


def find_nodes(pages: DataFrame, key: str, scratch: Scratch, *, order: str = "page", body: str = "json") -> DataFrame:
    """(id, pos, node): every object under ``key`` at any depth, once for each id: the last value, at the first place.

    ``pages``: a page number and its JSON text. Each round opens ``LEVELS`` levels of all values that are left and writes
    the nodes, so rounds are a twelfth of what texts are deep. ``pos`` is (page, path), the path being the places of the
    levels above and its own; a node comes before those inside it, and the fields of an object are in the order of their
    names. ``node`` is JSON text. Null and broken texts, nodes that aren't objects and nodes without ``id`` give nothing.
    """
    level = pages.select(F.col(order).cast("long").alias("page"), F.array().cast("array<int>").alias("path"), F.try_parse_json(body).alias("value"))
    found = None
    while True:
        opened = level.withColumn("id", F.lit(None).cast("string"))
        for _ in range(LEVELS):
            opened = _opened(opened, key)
        # the kind of a value costs a walk through all of it, so only the lowest ones are asked
        deeper = F.substring(F.schema_of_variant("value"), 1, 5).isin("OBJEC", "ARRAY")
        opened = scratch.keep(opened.where(F.when(F.col("id").isNull(), deeper).otherwise(True)))
        here = opened.where("id is not null")
        found = here if found is None else found.unionByName(here)
        level = opened.where("id is null").select("page", "path", "value")
        if level.isEmpty():
            break
    at = F.struct("page", "path")
    last = found.groupBy("id").agg(F.min(at).alias("pos"), F.max_by("value", at).alias("value"))
    return last.select("id", "pos", F.to_json("value").alias("node"))


def _opened(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (page, path, value, id) with what is directly in the values that have no id yet; the objects under ``key`` that have one come with it, and once more to be opened."""
    live = F.when(F.col("id").isNull(), F.col("value"))
    inside = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(live.outer()).toDF("at", "name", "inner"))
    own = F.when(F.col("name") == key, F.try_variant_get("inner", "$.id", "string"))
    inside = inside.where("id is not null or inner is not null").withColumn("own", own)
    path, value = (F.when(F.col("id").isNull(), new).otherwise(F.col(old)) for new, old in ((F.array_append("path", F.col("at")), "path"), (F.col("inner"), "value")))
    ids = F.when(F.col("own").isNotNull(), F.array(F.col("own"), F.lit(None))).otherwise(F.array("id"))
    return inside.select("page", path.alias("path"), value.alias("value"), F.explode(ids).alias("id"))
