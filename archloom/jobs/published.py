"""Published trees: documents and pages written as files, read back, checked and audited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.functions import urls as U
from archloom.jobs.audit import broken_links, internal_targets, served_path
from archloom.sources import documents as D
from archloom.sources.scratch import Scratch
from archloom.sources.tables import table
from archloom.sources.trees import read_tree, write_tree


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, page_id, url, html): a page for each place that is served, the first of those that share it; the id is host and path."""
    path = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").where("url is not null and page_id is not null")
    keyed = pages.select(F.concat(U.host(F.col("url")), served_path(path)).alias("id"), "page_id", "url", "html")
    first = keyed.groupBy("id").agg(F.min(F.struct("page_id", "url", "html")).alias("x"))
    return first.select("id", "x.*")


def published_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as markdown files and back (A9, A10, A13, B1, B2): front matter with a list, bodies letter by letter, what is kept and what goes to quarantine.

    The front matter is made so that rows fail each test: titles are the plain letters of a heading's first word, years
    are counted from the number in the url, and mobile sites name their source without a scheme.
    """
    u = F.col("url")
    seg = F.filter(F.split(U.path(u), "/"), lambda x: x != "")
    word = F.regexp_replace(F.regexp_extract("html", r"<h1>([^\s<]+)", 1), "[^A-Za-z\"&;]", "")
    source = F.when(U.host(u).startswith("m."), F.concat(U.host(u), U.path(u))).otherwise(u)
    year = F.regexp_extract(u, r"/([0-9]+)[^/]*/?$", 1).cast("int") + 1400
    fields = F.create_map(F.lit("title"), word, F.lit("source"), source, F.lit("year"), year.cast("string"))
    lists = F.create_map(F.lit("categories"), F.when(F.get(seg, 0) != "fr", F.array(F.get(seg, 0), F.concat(F.lit('the "'), F.get(seg, 0), F.lit('" \\ part')))))
    docs = _files(spark, sf_dir).select("id", fields.alias("fields"), lists.alias("lists"), F.regexp_extract("html", "(?s)<article>(.*)</article>", 1).alias("body"))
    scratch = Scratch(spark, "documents")
    folder = scratch.root + "/tree"
    write_tree(D.to_markdown(docs), folder, text="markdown")
    back = D.split_front(read_tree(spark, folder), F.concat(F.lit("tree/"), "id"), "tree")
    rows = back.select("id", F.md5("body").alias("body_md5"), D.front_field("title").alias("title"), D.front_field("source").alias("source"), D.front_field("year").cast("int").alias("year"), D.front_list("categories").alias("categories"))
    kept, quarantine = D.split_valid(D.validate(scratch.keep(rows)))  # files are read and parsed once
    both = kept.withColumn("errors", F.array().cast("array<string>")).withColumn("kept", F.lit(True)).unionByName(quarantine.withColumn("kept", F.lit(False)))
    return both.select("id", F.coalesce("title", F.lit("")).alias("title"), "source", F.col("year").cast("long").alias("year"), F.array_join("categories", "|").alias("categories"), F.array_join("errors", "; ").alias("errors"), "kept", "body_md5")


def tree_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken links of a built tree (A12, E19, K3): pages are written as files, and the audit reads nothing but these."""
    folder = Scratch(spark, "built").root + "/tree"
    write_tree(_files(spark, sf_dir), folder, text="html")
    built = read_tree(spark, folder)
    host = F.substring_index("id", "/", 1)
    targets = internal_targets(built.select(F.col("id").alias("page_id"), host.alias("host"), "value"), "value")
    served = built.select(host.alias("host"), F.expr("substr(id, length(substring_index(id, '/', 1)) + 1)").alias("path"))
    return broken_links(targets, served).withColumnRenamed("sample_pages", "sample_files")


_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
_SERVED = r"regexp_replace(regexp_replace(regexp_replace(url_decode({0}), '\.html$', ''), '/index$', ''), '/$', '')"
_PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
_FILES = f"f AS (SELECT {_HOST} AS host, {_SERVED.format(_PATH)} AS path, arg_min(url, page_id) AS url, arg_min(html, page_id) AS html FROM pages WHERE url IS NOT NULL GROUP BY ALL)"

QUERIES = {f.__name__: f for f in (published_documents, tree_audit)}
ORACLE_SQL = {
    "published_documents": f"""WITH {_FILES}, d AS (
  SELECT host || path AS id, regexp_replace(regexp_extract(html, '<h1>([^\\s<]+)', 1), '[^A-Za-z"&;]', '', 'g') AS title, CASE WHEN host LIKE 'm.%' THEN host || {_PATH} ELSE url END AS source,
    1400 + regexp_extract(url, '/([0-9]+)[^/]*/?$', 1)::BIGINT AS year, list_filter(string_split({_PATH}, '/'), lambda x: x <> '')[1] AS seg, md5(regexp_extract(html, '(?s)<article>(.*)</article>', 1)) AS body_md5 FROM f
), e AS (SELECT *, concat_ws('; ', CASE WHEN title = '' THEN 'title is empty' END, CASE WHEN host_less THEN 'source is no url' END, CASE WHEN year NOT BETWEEN 1950 AND 2100 THEN 'year is out of range' END) AS errors
  FROM (SELECT *, source NOT LIKE 'http%://%' AS host_less FROM d))
SELECT id, title, source, year, CASE WHEN seg = 'fr' THEN '' ELSE seg || '|the "' || seg || '" \\ part' END AS categories, errors, errors = '' AS kept, body_md5 FROM e""",
    "tree_audit": f"""WITH {_FILES}, r AS (SELECT host, host || path AS id, regexp_extract(unnest(regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1)), '^([^?#]*)', 1) AS target FROM f),
b AS (SELECT * FROM r WHERE target LIKE '/%' AND target NOT LIKE '//%' AND target <> '/' AND NOT EXISTS (SELECT 1 FROM f WHERE f.host = r.host AND f.path = {_SERVED.format("target")})),
few AS (SELECT host, target, id, row_number() OVER (PARTITION BY host, target ORDER BY id) AS n FROM (SELECT DISTINCT host, target, id FROM b))
SELECT host, target, count(*) AS refs, count(DISTINCT id) AS pages, sample_files FROM b JOIN (SELECT host, target, string_agg(id, ',' ORDER BY id) AS sample_files FROM few WHERE n <= 5 GROUP BY ALL) USING (host, target) GROUP BY ALL""",
}
