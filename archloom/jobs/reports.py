"""Report jobs: a run writes its tables, and says in one row what it did and in lists what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.functions import text as X
from archloom.functions import urls as U
from archloom.jobs import crawl, graph, rewriting
from archloom.operators.report import listed, read_exceptions, read_numbers, write_observed, write_report
from archloom.operators.rewrite import absolute
from archloom.sources.scratch import Scratch
from archloom.sources.tables import table

NUMBERS = ["pages", "written", "failed", "owned", "empty", "untitled", "refs", "unresolved", "documents", "images", "posters", "awaiting_alt", "hosts", "uncrawled", "dangling"]


def _run(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a run: its pages, references, images and hosts, each written in one pass that also counts them, and the report."""
    folder = Scratch(spark, "run").root
    fate = lambda name: F.count_if(F.col("fate") == name)
    own = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    title = X.visible(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1))
    pages = own.select("page_id", "url", F.trim(F.coalesce(title, F.lit(""))).alias("title")).join(crawl.page_fates(spark, sf_dir), "page_id")
    numbers = write_observed(
        pages, f"{folder}/pages", pages=F.count("*"), written=fate("written"), failed=fate("failed"), owned=fate("owned"), empty=fate("empty"),
        untitled=F.count_if((F.col("fate") == "written") & (F.col("title") == "")),
    )
    refs = rewriting.rewritten_references(spark, sf_dir).join(own.select("page_id", "url"), "page_id")
    to = absolute(F.col("ref"), U.host(F.col("url")))
    kind = lambda name: F.count_if(F.col("kind") == name)
    numbers |= write_observed(refs.select("page_id", "url", "kind", to.alias("to")), f"{folder}/refs", refs=F.count("*"), unresolved=kind("unresolved"), documents=kind("document"))
    numbers |= write_observed(crawl.image_keep(spark, sf_dir), f"{folder}/images", images=F.count("*"), posters=F.count_if("poster"), awaiting_alt=F.count_if("waiting"))
    unresolved = spark.read.parquet(f"{folder}/refs").where("kind = 'unresolved'")
    loose = unresolved.select(U.host(U.canonical(F.col("to"))).alias("host")).distinct().withColumn("loose", F.lit(True))
    hosts = graph.unvisited_hosts(spark, sf_dir).join(loose, "host", "left")
    hosts = hosts.select("host", "visited", (F.col("visited") & F.coalesce("loose", F.lit(False))).alias("dangling"))
    numbers |= write_observed(hosts, f"{folder}/hosts", hosts=F.count("*"), uncrawled=F.count_if(~F.col("visited")), dangling=F.count_if("dangling"))

    pages, images, hosts = (spark.read.parquet(f"{folder}/{name}") for name in ("pages", "images", "hosts"))
    lists = [
        listed(pages.where("fate = 'written' and title = ''"), "untitled", F.col("url")),
        listed(pages.where("fate = 'empty'"), "empty", F.col("url"), F.col("title")),
        listed(pages.where("fate = 'failed'"), "failed", F.col("url"), F.col("page_id")),
        listed(unresolved, "unresolved", F.col("url"), F.col("to")),
        listed(images.where("waiting"), "awaiting alt", F.col("page_id"), F.col("name")),
        listed(hosts.where("not visited"), "uncrawled", F.col("host")),
        listed(hosts.where("dangling"), "dangling", F.col("host")),
    ]
    exceptions = lists[0]
    for more in lists[1:]:
        exceptions = exceptions.unionByName(more)
    write_report(spark, f"{folder}/report", {name: numbers[name] for name in NUMBERS}, exceptions)
    return folder


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a run, read back from its report."""
    return read_numbers(spark, f"{_run(spark, sf_dir)}/report", NUMBERS)


def run_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of a run (K2, S1, S2): untitled, empty and failed pages, references that lead nowhere, images without words, hosts never visited or with loose ends."""
    return read_exceptions(spark, f"{_run(spark, sf_dir)}/report")


_HOST = "lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_WORDS = "regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"
for _name, _char in X.ENTITIES:
    _WORDS = f"replace({_WORDS}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"
_RUN = f"""pg AS (SELECT page_id, url, fate, trim({_WORDS}) AS title FROM pages JOIN ({crawl.ORACLE_SQL["page_fates"]}) USING (page_id)),
rf AS (SELECT url, kind, CASE WHEN ref LIKE '//%' THEN 'http:' || ref WHEN ref LIKE '/%' THEN 'http://' || {_HOST.format(u="url")} || ref ELSE ref END AS what FROM ({rewriting.ORACLE_SQL["rewritten_references"]}) JOIN pages USING (page_id)),
im AS ({crawl.ORACLE_SQL["image_keep"]}),
ho AS (SELECT host, visited, visited AND host IN (SELECT {_HOST.format(u="what")} FROM rf WHERE kind = 'unresolved') AS dangling FROM ({graph.ORACLE_SQL["unvisited_hosts"]}))"""

QUERIES = {f.__name__: f for f in (run_report, run_exceptions)}
ORACLE_SQL = {
    "run_report": f"""WITH {_RUN}
SELECT * FROM (SELECT count(*) AS pages, count(*) FILTER (fate = 'written') AS written, count(*) FILTER (fate = 'failed') AS failed, count(*) FILTER (fate = 'owned') AS owned, count(*) FILTER (fate = 'empty') AS empty, count(*) FILTER (fate = 'written' AND title = '') AS untitled FROM pg),
  (SELECT count(*) AS refs, count(*) FILTER (kind = 'unresolved') AS unresolved, count(*) FILTER (kind = 'document') AS documents FROM rf),
  (SELECT count(*) AS images, count(*) FILTER (poster) AS posters, count(*) FILTER (waiting) AS awaiting_alt FROM im),
  (SELECT count(*) AS hosts, count(*) FILTER (NOT visited) AS uncrawled, count(*) FILTER (dangling) AS dangling FROM ho)""",
    "run_exceptions": f"""WITH {_RUN}
SELECT 'untitled' AS list, url AS at, '' AS what FROM pg WHERE fate = 'written' AND title = ''
UNION ALL SELECT 'empty', url, title FROM pg WHERE fate = 'empty'
UNION ALL SELECT 'failed', coalesce(url, ''), page_id::VARCHAR FROM pg WHERE fate = 'failed'
UNION ALL SELECT 'unresolved', url, what FROM rf WHERE kind = 'unresolved'
UNION ALL SELECT 'awaiting alt', page_id::VARCHAR, name FROM im WHERE waiting
UNION ALL SELECT 'uncrawled', host, '' FROM ho WHERE NOT visited
UNION ALL SELECT 'dangling', host, '' FROM ho WHERE dangling""",
}
