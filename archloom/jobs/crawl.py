"""Crawl jobs: the pages of each host, what is written and what isn't, images kept, and the run's report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.functions import urls as U
from archloom.jobs.extraction import BLOCKS_SQL, NOTICE
from archloom.operators import blocks as B
from archloom.operators import crawl as C
from archloom.operators.rewrite import absolute
from archloom.sources.scratch import Scratch
from archloom.sources.tables import table

#: Sections that other parts of the site write.
OWNED = ("fr",)


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, url, html): each page at its own url and at its short one, the first word of its heading on its host."""
    p = table(spark, sf_dir, "pages").where("url is not null").select("page_id", U.host(F.col("url")).alias("host"), U.canonical(F.col("url")).alias("url"), "html")
    word = F.regexp_extract("html", r"<h1>([^\s<&]+)", 1)
    short = p.where(word != "").withColumn("url", U.canonical(F.concat(F.lit("http://"), "host", F.lit("/"), word)))
    return p.unionByName(short)


def host_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The urls of each host by its anchors, from its first page on (A2, G2, G3); hosts whose names begin with a vowel have site maps, of their pages' urls."""
    served = _served(spark, sf_dir)
    href = F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1)))
    links = served.select("host", "url", href.alias("href")).select("host", "url", U.canonical(absolute(F.col("href"), F.col("host"))).alias("target"))
    own = table(spark, sf_dir, "pages").where("url is not null").select("page_id", U.host(F.col("url")).alias("host"), F.col("url").alias("raw"))
    start = own.groupBy("host").agg(F.min_by("raw", "page_id").alias("raw")).select("host", U.canonical(F.col("raw")).alias("url"))
    xml = F.concat(F.lit("<url><loc> "), F.replace("raw", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    maps = own.where(F.col("host").rlike("^[aeiou]")).select("host", xml.alias("xml"))
    return C.host_urls(C.site_map_urls(maps), C.crawl(start, links, Scratch(spark, "crawl")))


def page_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each page (F2, F6, F9): failed, owned by another part, empty with nothing below it, or written."""
    pages = table(spark, sf_dir, "pages")
    body = F.trim(F.regexp_replace(F.regexp_extract("html", "(?s)</h1>(.*?)</article>", 1), "<[^>]+>", ""))
    rows = pages.select("page_id", U.canonical(F.col("url")).alias("url"), F.coalesce(F.char_length(body), F.lit(0)).alias("n"))
    parents = rows.select(U.parent(F.col("url")).alias("url")).where("url is not null").distinct().withColumn("section", F.lit(True))
    fate = (
        F.when(F.col("url").isNull() | ~F.coalesce(U.is_internal(U.host(F.col("url")), ".com"), F.lit(False)), "failed")
        .when(F.coalesce(F.get(U.segments(F.col("url")), 0).isin(*OWNED), F.lit(False)), "owned")
        .when((F.col("n") < 200) & F.col("section").isNull(), "empty")
        .otherwise("written")
    )
    return rows.join(parents, "url", "left").select("page_id", fate.alias("fate"))


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page that each file name stands for."""
    named = table(spark, sf_dir, "pages").where("url is not null").select(U.file_name(U.path(F.col("url"))).alias("name"), "url", F.col("page_id").alias("page"), F.lit(0).alias("pos"))
    return C.last_sources(named)


def image_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of each order's page that its body names (A11, D34, F3, F4, F8): the lines are its images, those not returned are in the body."""
    item = table(spark, sf_dir, "lineitem")
    src = F.concat(F.lit("/media/"), F.col("l_suppkey").cast("string"), F.lit("/p"), F.col("l_partkey").cast("string"), F.lit(".jpg"))
    images = item.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("pos"), src.alias("src"), (F.col("l_linestatus") == "O").alias("landing"), F.when(F.col("l_tax") > 0.06, "own words").otherwise("").alias("alt"), (F.col("l_discount") > 0.08).alias("captioned"))
    bodies = item.where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.concat_ws("\n\n", F.collect_set(F.concat(F.lit("![]("), src, F.lit(")")))).alias("body"))
    said = table(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("name"), F.concat("p_name", F.lit(" ["), "p_brand", F.lit("]")).alias("alt"))
    return C.kept_images(images, bodies, said)


def crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals over all blocks of all pages (K2, B5): pages, blocks, headings, words, notices and navigation dropped."""
    blocks = B.page_blocks(table(spark, sf_dir, "pages"))
    text = F.coalesce("text", F.lit(""))
    credit = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(NOTICE)))
    nav = (F.col("type") == "p") & B.is_navigation(text)
    return blocks.agg(
        F.count_distinct("page_id").alias("pages"), F.count("*").alias("blocks"), F.count_if(F.col("type") == "h").alias("headings"),
        F.sum(F.char_length(text)).alias("chars"), F.sum(credit).alias("credits_dropped"), F.count_if(nav).alias("nav_dropped"),
    )


_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_DIR = "CASE WHEN {0} = '' THEN '/' WHEN {0} LIKE '%.%' OR {0} LIKE '%/' THEN {0} ELSE {0} || '/' END"
_PAGE = r"(NOT contains(split_part({0}, '/', -1), '.') OR regexp_matches(split_part({0}, '/', -1), '(?i)\.(html?|shtml)$'))"

QUERIES = {f.__name__: f for f in (host_pages, page_fates, document_sources, image_keep, crawl_report)}
ORACLE_SQL = {
    "host_pages": f"""WITH RECURSIVE p AS (SELECT page_id, {_HOST} AS host, {_DIR.format(_PATH)} AS path, html FROM pages WHERE url IS NOT NULL),
s AS (SELECT page_id, host, path, html FROM p UNION ALL SELECT page_id, host, {_DIR.format("'/' || w")}, html FROM (SELECT *, regexp_extract(html, '<h1>([^\\s<&]+)', 1) AS w FROM p) WHERE w <> ''),
l AS (SELECT DISTINCT host, path, {_DIR.format("regexp_extract(h, '^[^?#]*')")} AS target FROM (SELECT host, path, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS h FROM s) WHERE h LIKE '/%' AND h NOT LIKE '//%'),
e AS (SELECT * FROM l WHERE {_PAGE.format("target")}),
c AS (SELECT host, arg_min(path, page_id) AS path FROM p GROUP BY host UNION SELECT c.host, e.target FROM c JOIN e ON e.host = c.host AND e.path = c.path)
SELECT host, 'http://' || host || path AS url, 'crawl' AS via FROM c WHERE NOT regexp_matches(host, '^[aeiou]')
UNION ALL SELECT DISTINCT host, 'http://' || host || path, 'map' FROM p WHERE regexp_matches(host, '^[aeiou]') AND {_PAGE.format("path")}""",
    "page_fates": f"""WITH p AS (SELECT page_id, {_HOST} AS host, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS seg,
  length(trim(regexp_replace(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '<[^>]+>', '', 'g'))) AS n FROM pages),
k AS (SELECT DISTINCT host, seg[:-2] AS seg FROM p WHERE len(seg) > 0)
SELECT page_id, CASE WHEN host IS NULL OR host NOT LIKE '%.com' THEN 'failed' WHEN seg[1] = 'fr' THEN 'owned'
  WHEN coalesce(n, 0) < 200 AND NOT EXISTS (SELECT 1 FROM k WHERE k.host = p.host AND k.seg = p.seg) THEN 'empty' ELSE 'written' END AS fate FROM p""",
    "document_sources": f"""SELECT name, arg_max(url, page_id) AS url FROM (SELECT page_id, url, coalesce(nullif(lower(split_part({_PATH}, '/', -1)), ''), 'page') AS name FROM pages WHERE url IS NOT NULL) GROUP BY name""",
    "image_keep": """WITH i AS (SELECT l_orderkey AS page_id, l_linenumber AS pos, '/media/' || l_suppkey || '/p' || l_partkey || '.jpg' AS src, 'p' || l_partkey || '.jpg' AS name, l_linestatus = 'O' AS landing, l_tax > 0.06 AS own, l_discount > 0.08 AS captioned, l_returnflag FROM lineitem),
j AS (SELECT *, coalesce(landing AND src = first_value(src) OVER (PARTITION BY page_id ORDER BY pos, src), false) AS poster FROM i),
k AS (SELECT page_id, name, bool_or(poster) AS poster, bool_or(own) AS own, bool_or(captioned) AS captioned FROM j WHERE poster OR EXISTS (SELECT 1 FROM i b WHERE b.page_id = j.page_id AND b.l_returnflag <> 'R' AND contains(b.src, j.name)) GROUP BY page_id, name)
SELECT page_id, name, poster, coalesce(p_name || ' \\[' || p_brand || '\\]', '') AS alt, p_name IS NULL AND NOT own AND NOT poster AND NOT captioned AS waiting FROM k LEFT JOIN part ON p_size > 25 AND name = 'p' || p_partkey || '.jpg'""",
    "crawl_report": f"SELECT count(DISTINCT page_id) AS pages, count(*) AS blocks, count(*) FILTER (type = 'h') AS headings, sum(length(text))::BIGINT AS chars, sum(CASE WHEN regexp_matches(text, '(?i)(copyright|all rights reserved|do not reproduce)') THEN 1 ELSE 0 END)::BIGINT AS credits_dropped, 0::BIGINT AS nav_dropped FROM {BLOCKS_SQL}",
}
