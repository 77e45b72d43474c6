"""Link-integrity audit: which internal links of the served pages lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archloom.sources.scratch import Scratch
from archloom.sources.tables import table


def internal_targets(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with one row for each internal ``href`` or ``src``: its position and target.

    Internal is what starts with one ``/``; the target ends at ``?`` or ``#``; the root is left out.
    """
    refs = F.regexp_extract_all(html, F.lit('(?:href|src)="([^"]+)"'), F.lit(1))
    out = pages.select(*[c for c in pages.columns if c != html], F.posexplode(refs).alias("pos", "ref"))
    out = out.withColumn("target", F.regexp_extract("ref", "^([^?#]*)", 1)).drop("ref")
    return out.where("target like '/%' and target not like '//%' and target <> '/'")


def site(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1))


def served_path(path: F.Column) -> F.Column:
    """A path as it is served: percent-decoded, without ``.html``, ``/index`` or a last ``/``."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "\\.html$", ""), "/index$", ""), "/$", "")


def broken_links(targets: DataFrame, served: DataFrame, samples: int = 5) -> DataFrame:
    """(host, target, refs, pages, sample_pages) of the targets that no page of their host serves.

    ``targets``: page_id, host, pos, target. ``served``: host, path. References are summed for each page
    before the join, and pages are scanned once: what is broken is written. Counts combine before the shuffle,
    and of a target's pages each task passes on only its ``samples`` smallest ids, so a broken link in
    the navigation of all pages is no large group.
    """
    scratch = Scratch(targets.sparkSession, "audit")
    refs = targets.groupBy("host", "target", "page_id").agg(F.count("*").alias("n")).withColumn("path", served_path(F.col("target")))
    broken = scratch.keep(refs.join(served.select("host", "path").distinct(), ["host", "path"], "left_anti"))
    counts = broken.groupBy("host", "target").agg(F.sum("n").alias("refs"), F.count("*").alias("pages"))
    place = F.row_number().over(Window.partitionBy("host", "target").orderBy("page_id"))
    first = broken.select("host", "target", "page_id").withColumn("place", place).where(F.col("place") <= samples)
    few = first.groupBy("host", "target").agg(F.array_sort(F.collect_list("page_id")).alias("few"))
    return counts.join(few, ["host", "target"]).select("host", "target", "refs", "pages", F.array_join(F.transform("few", lambda x: x.cast("string")), ",").alias("sample_pages"))


def link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken links of each host with their references and first pages."""
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return broken_links(internal_targets(pages.select("page_id", site().alias("host"), "html")), pages.select(site().alias("host"), served_path(path).alias("path")))


def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the audit (K2, K3): pages, internal references, and those that lead nowhere, for each host and in all (no host)."""
    pages = table(spark, sf_dir, "pages").select("page_id", site().alias("host"), "html", F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    refs = internal_targets(pages.select("host", "html")).groupBy("host", "target").agg(F.count("*").alias("n"))
    served = pages.select("host", served_path(F.col("path")).alias("path")).distinct().withColumn("there", F.lit(True))
    met = refs.withColumn("path", served_path(F.col("target"))).join(served, ["host", "path"], "left")
    by_host = met.groupBy("host").agg(F.sum("n").alias("refs"), F.sum(F.when(F.col("there").isNull(), F.col("n")).otherwise(0)).alias("broken"), F.count("*").alias("targets"))
    count = pages.groupBy("host").agg(F.count("*").alias("pages"))
    both = count.join(by_host, "host", "left")
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return both.rollup("host").agg(F.sum("pages").alias("pages"), zero("targets"), zero("refs"), zero("broken"))


_REFS = r"""refs AS (
  SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, unnest(regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1)) AS ref FROM pages
), targets AS (
  SELECT page_id, host, regexp_extract(ref, '^([^?#]*)', 1) AS target FROM refs
), kept AS (
  SELECT page_id, host, target, regexp_replace(regexp_replace(regexp_replace(url_decode(target), '\.html$', ''), '/index$', ''), '/$', '') AS path FROM targets
  WHERE target LIKE '/%' AND target NOT LIKE '//%' AND target <> '/'
), served AS (
  SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, regexp_replace(regexp_replace(regexp_replace(url_decode(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '\.html$', ''), '/index$', ''), '/$', '') AS path FROM pages
), broken AS (
  SELECT * FROM kept WHERE NOT EXISTS (SELECT 1 FROM served WHERE served.host = kept.host AND served.path = kept.path)
)"""
QUERIES = {"link_audit": link_audit, "audit_totals": audit_totals}
ORACLE_SQL = {
    "link_audit": f"""
WITH {_REFS}, few AS (
  SELECT host, target, page_id, row_number() OVER (PARTITION BY host, target ORDER BY page_id) AS n FROM (SELECT DISTINCT host, target, page_id FROM broken)
)
SELECT host, target, refs, pages, sample_pages
FROM (SELECT host, target, count(*) AS refs, count(DISTINCT page_id) AS pages FROM broken GROUP BY ALL)
JOIN (SELECT host, target, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS sample_pages FROM few WHERE n <= 5 GROUP BY ALL) USING (host, target)
""",
    "audit_totals": f"""
WITH {_REFS}, p AS (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, count(*) AS pages FROM pages GROUP BY ALL),
k AS (SELECT host, count(DISTINCT target) AS targets, count(*) AS refs FROM kept GROUP BY host), b AS (SELECT host, count(*) AS broken FROM broken GROUP BY host)
SELECT host, sum(pages)::BIGINT AS pages, coalesce(sum(targets), 0)::BIGINT AS targets, coalesce(sum(refs), 0)::BIGINT AS refs, coalesce(sum(broken), 0)::BIGINT AS broken
FROM p LEFT JOIN k USING (host) LEFT JOIN b USING (host) GROUP BY ROLLUP (host)
""",
}
