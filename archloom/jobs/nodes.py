"""Structured data of pages, lists, runs and dispatches, and the works that a landing page shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archloom.functions import nodes as N
from archloom.functions import text as X
from archloom.jobs.tree import _SECTIONS, section_pages
from archloom.operators.sections import ordered_children
from archloom.sources.scratch import Scratch
from archloom.sources.tables import table

SITE = "https://example.org/"
#: As many of a year's newest posts give a picture.
STRIP = 6


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each page's list of children, a row each, with the list's length (D33): a list may have any length."""
    kids = ordered_children(section_pages(spark, sf_dir), Scratch(spark, "children"))
    node = N.list_item(F.col("place"), F.col("label"), F.concat(F.lit(SITE), "id"))
    return kids.select("parent", F.col("n").alias("n_items"), "place", X.json_ld(node).alias("ld"))


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs (D33): those that still wait have no first day and give no node; a last day only if it is after the first."""
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("last"))
    runs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    runs = runs.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    start = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    page = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit(SITE), "o_orderkey"))
    rows = runs.select("o_orderkey", F.concat("c_name", F.lit(" <i>"), "o_orderpriority").alias("title"), start.alias("start"), F.when(F.col("last") > start, F.col("last")).alias("last"), F.col("c_mktsegment").alias("place"), page.alias("page"))
    node = N.event(F.col("title"), F.col("start"), F.col("last"), F.col("place"), F.col("page"))
    return rows.where("start is not null").select("o_orderkey", X.json_ld(node).alias("ld"))


def article_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dispatches (D33): how their text begins, the words they are filed under, a picture where they have one."""
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit(SITE), F.col("doc_id").cast("string"))
    filed = F.filter(F.array(F.when(F.col("lang") != "en", F.col("lang")), F.when(F.col("n_chars") > 2000, "long")), lambda x: x.isNotNull())
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.col("n_chars").cast("int"))
    picture = F.when(F.col("n_chars") % 2 == 0, F.concat(url, F.lit(".jpg")))
    node = N.article(F.col("source"), F.substring("text", 1, 160), day, F.col("source"), url, filed, picture)
    return d.select("doc_id", X.json_ld(node).alias("ld"))


def landing_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated works only, landings only, with what the filter by decade shows beside each."""
    dated = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.year("o_orderdate").cast("long").alias("year"))
    landings = section_pages(spark, sf_dir).where(F.col("id").rlike("^customer[^/]*/[^/]+$")).select("id", F.substring_index("id", "/", -1).alias("name"))
    works = landings.join(dated, "name").select("id", "year", (F.floor(F.col("year") / 10) * 10).alias("decade"))
    shown = works.groupBy("decade").agg(F.count("*").alias("shown"))  # a row a decade
    return works.join(shown, "decade").select("id", "year", "decade", "shown")


def year_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per year one picture, the first, of each of the newest six posts that have any (K5)."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("x"))
    posts = table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    posts = posts.select(F.year("o_orderdate").cast("long").alias("year"), F.to_date("o_orderdate").alias("day"), "o_orderkey", F.col("x.l_partkey").alias("part"))
    newest = Window.partitionBy("year").orderBy(F.desc("day"), "o_orderkey")  # limited before its shuffle
    top = posts.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= STRIP)
    strip = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: F.concat(F.lit("p"), x["part"].cast("string"))), " ")
    return top.groupBy("year").agg(strip.alias("strip"))


def _optional(name: str, value: str) -> str:
    return f"coalesce(',\"{name}\":' || to_json({value})::VARCHAR, '')"


QUERIES = {f.__name__: f for f in (list_items, event_nodes, article_nodes, landing_works, year_strips)}
ORACLE_SQL = {
    "list_items": f"""WITH {_SECTIONS}, named AS (SELECT c.id, c.ord, regexp_replace(c.id, '/[^/]*$', '') AS parent, CASE WHEN contains(c.title, ': ') AND string_split(c.title, ': ')[1] LIKE '%' || p.title THEN substr(c.title, instr(c.title, ': ') + 2) ELSE c.title END AS label
  FROM pages_ c JOIN pages_ p ON p.id = regexp_replace(c.id, '/[^/]*$', '') AND contains(c.id, '/')),
k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ord, id) AS place, count(*) OVER (PARTITION BY parent) AS n_items FROM named)
SELECT parent, n_items, place, '{{"@type":"ListItem","position":' || place || ',"name":' || to_json(label)::VARCHAR || ',"url":"{SITE}' || id || '"}}' AS ld FROM k""",
    "event_nodes": f"""WITH r AS (SELECT o_orderkey, c_name || ' <i>' || o_orderpriority AS title, o_orderdate::DATE AS start, c_mktsegment AS place, CASE WHEN last > o_orderdate::DATE THEN last::VARCHAR END AS last, CASE WHEN c_mktsegment = 'BUILDING' THEN '{SITE}' || o_orderkey END AS page
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, max(l_shipdate)::DATE AS last FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')
SELECT o_orderkey, replace('{{"@type":"TheaterEvent","name":' || to_json(title)::VARCHAR || ',"startDate":"' || start || '"' || {_optional("endDate", "last")} || ',"location":{{"@type":"Place","name":' || to_json(place)::VARCHAR || '}}' || {_optional("url", "page")}
  || ',"workPerformed":{{"@type":"Play","name":' || to_json(title)::VARCHAR || '}}}}', '<', '\\u003c') AS ld FROM r""",
    "article_nodes": f"""WITH d AS (SELECT *, '{SITE}' || doc_id AS url, concat_ws(', ', CASE WHEN lang <> 'en' THEN lang END, CASE WHEN n_chars > 2000 THEN 'long' END) AS words, CASE WHEN n_chars % 2 = 0 THEN '{SITE}' || doc_id || '.jpg' END AS picture FROM documents)
SELECT doc_id, replace('{{"@type":"Article","@id":"' || url || '#article","headline":' || to_json(source)::VARCHAR || ',"description":' || to_json(left(text, 160))::VARCHAR || ',"datePublished":"' || (DATE '1990-01-01' + n_chars::INTEGER) || '","isBasedOn":' || to_json(source)::VARCHAR
  || ',"mainEntityOfPage":{{"@id":"' || url || '#webpage"}}' || {_optional("keywords", "nullif(words, '')")} || {_optional("image", "picture")} || '}}', '<', '\\u003c') AS ld FROM d""",
    "landing_works": """SELECT *, count(*) OVER (PARTITION BY decade) AS shown FROM (SELECT 'customer' || c_custkey || '/o' || o_orderkey AS id, year(o_orderdate)::BIGINT AS year, (year(o_orderdate) // 10 * 10)::BIGINT AS decade FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')""",
    "year_strips": f"""WITH p AS (SELECT year(o_orderdate)::BIGINT AS year, o_orderdate::DATE AS day, o_orderkey, part FROM orders JOIN (SELECT l_orderkey, min((l_linenumber, l_partkey))[2] AS part FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey)
SELECT year, string_agg('p' || part, ' ' ORDER BY place) AS strip FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY day DESC, o_orderkey) AS place FROM p) WHERE place <= {STRIP} GROUP BY year""",
}
