"""Jobs that rewrite bodies: what each reference becomes, and the bodies that result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.functions import urls as U
from archloom.operators import rewrite as W
from archloom.sources.scratch import Scratch
from archloom.sources.tables import table


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, body): each page from its navigation on, without what follows the article."""
    body = F.regexp_extract("html", "(?s)<body>(.*)</article>", 1)
    return table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"), body.alias("body"))


def _dispositions(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """What the references of the pages become. References and routes are read from the pages once and written, as each lookup asks for them again."""
    targets = scratch.keep(W.link_targets(_bodies(spark, sf_dir)))
    routes, media = _known(spark, sf_dir, targets)
    return W.dispositions(targets, scratch.keep(routes), media)


def _known(spark: SparkSession, sf_dir: str, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes of the pages (their host's name, then their segments), also by what their titles' first words are; and no images' copies but jpg and png."""
    pages = table(spark, sf_dir, "pages")
    place = F.concat_ws("/", F.translate(U.host(F.col("url")), ".", "-"), F.array_join(U.segments(F.col("url")), "/"))
    own = pages.select(U.canonical(F.col("url")).alias("url"), place.alias("route"))
    # the short address of a page on its host: the first word of its heading
    word = F.regexp_extract("html", r"<h1>([^\s<&]+)", 1)
    short = pages.where(word != "").select(U.canonical(F.concat(F.lit("http://"), U.host(F.col("url")), F.lit("/"), word)).alias("url"), place.alias("route"))
    refs = targets.where("image and url is not null").select("url").distinct()
    media = refs.where(F.col("url").rlike(r"(?i)\.(jpe?g|png)$")).select("url", U.media_key(F.col("url")).alias("key"))
    return own.unionByName(short).where("url is not null"), media


def rewritten_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's different references and what they become."""
    return _dispositions(spark, sf_dir, Scratch(spark, "references")).select("page_id", "ref", "image", "kind", F.col("to").alias("address"))


def rewritten_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with links to routes, images to copies and unknown ones as plain words."""
    scratch = Scratch(spark, "rewrite")
    out = W.rewrite_bodies(_bodies(spark, sf_dir), scratch.keep(_dispositions(spark, sf_dir, scratch)))
    links = F.size(F.regexp_extract_all("body", F.lit('<a href="'), F.lit(0)))
    return out.select("page_id", F.md5("body").alias("body_md5"), F.char_length("body").cast("long").alias("n_chars"), links.cast("long").alias("n_links"))


_HOST = "lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "coalesce(nullif(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"


def _canon(u: str) -> str:
    p, h = _PATH.format(u=u), _HOST.format(u=u)
    return f"CASE WHEN regexp_matches({u}, '^https?://[^/?#]') THEN 'http://' || {h} || CASE WHEN {p} NOT LIKE '%.%' AND {p} NOT LIKE '%/' THEN {p} || '/' ELSE {p} END END"


_SQL = rf"""b AS (SELECT page_id, url, {_HOST.format(u="url")} AS host, html, regexp_extract(html, '(?s)<body>(.*)</article>', 1) AS body FROM pages),
pieces AS (SELECT page_id, host, unnest(regexp_extract_all(body, '{W.PIECE}')) AS piece FROM b),
refs AS (SELECT DISTINCT page_id, host, lower(left(piece, 4)) = '<img' AS image, CASE WHEN lower(left(piece, 4)) = '<img' THEN regexp_extract(piece, '{W.SRC}', 1) ELSE regexp_extract(piece, '{W.HREF}', 1) END AS ref FROM pieces),
targets AS (SELECT page_id, ref, image, {_canon("a")} AS url FROM (SELECT *, CASE WHEN ref LIKE '//%' THEN 'http:' || ref WHEN ref LIKE '/%' THEN 'http://' || host || ref ELSE ref END AS a FROM refs WHERE ref <> '')),
places AS (SELECT {_canon("url")} AS url, host, html, concat_ws('/', replace(host, '.', '-'), array_to_string(CASE WHEN seg[-1] NOT LIKE '%.%' OR len(seg) = 0 THEN seg WHEN regexp_matches(seg[-1], '(?i)^(index|default)\.') THEN seg[:-2] ELSE list_append(seg[:-2], regexp_replace(seg[-1], '\.[^.]+$', '')) END, '/')) AS route
  FROM (SELECT *, list_filter(string_split({_PATH.format(u="url")}, '/'), lambda x: x <> '') AS seg FROM b)),
routes AS (SELECT url, min(route) AS route FROM (SELECT url, route FROM places UNION ALL SELECT {_canon("s")}, route FROM (SELECT route, 'http://' || host || '/' || regexp_extract(html, '<h1>([^\s<&]+)', 1) AS s, regexp_extract(html, '<h1>([^\s<&]+)', 1) AS word FROM places) WHERE word <> '') WHERE url IS NOT NULL GROUP BY url),
hosts AS (SELECT DISTINCT {_HOST.format(u="url")} AS h FROM routes),
kinds AS (SELECT t.*, route, CASE WHEN image THEN 'unresolved' WHEN t.url IS NULL THEN CASE WHEN regexp_matches(ref, '^(mailto:|tel:|#)') THEN 'kept' ELSE 'unresolved' END WHEN regexp_matches(t.url, '(?i)\.(pdf|docx?|rtf|zip)$') THEN 'document'
  WHEN route IS NOT NULL THEN 'page' WHEN {_HOST.format(u="t.url")} IN (SELECT h FROM hosts) THEN 'unresolved' ELSE 'kept' END AS kind FROM targets t LEFT JOIN routes r ON t.url = r.url),
found AS (SELECT page_id, ref, image, kind, CASE kind WHEN 'page' THEN '/' || route || regexp_extract(ref, '(#.*)$', 1) WHEN 'kept' THEN ref END AS address FROM kinds)"""
QUERIES = {f.__name__: f for f in (rewritten_references, rewritten_bodies)}
ORACLE_SQL = {
    "rewritten_references": f"WITH {_SQL} SELECT * FROM found",
    "rewritten_bodies": rf"""WITH {_SQL}, m AS (SELECT page_id, map_from_entries(list({{'k': ref, 'v': address}})) AS m FROM found WHERE address IS NOT NULL AND NOT image GROUP BY page_id),
s AS (SELECT page_id, m, string_split_regex(body, '{W.PIECE}') AS gaps, regexp_extract_all(body, '{W.PIECE}') AS p FROM b LEFT JOIN m USING (page_id)),
n AS (SELECT page_id, gaps[1] || coalesce(array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN lower(left(p[i], 4)) = '<img' THEN '' WHEN m[regexp_extract(p[i], '{W.HREF}', 1)] IS NULL THEN regexp_extract(p[i], '(?is)^<a\b[^>]*>(.*)</a>$', 1)
  ELSE '<a href="' || m[regexp_extract(p[i], '{W.HREF}', 1)] || '">' || regexp_extract(p[i], '(?is)^<a\b[^>]*>(.*)</a>$', 1) || '</a>' END || gaps[i + 1]), ''), '') AS body FROM s)
SELECT page_id, md5(body) AS body_md5, length(body)::BIGINT AS n_chars, len(regexp_extract_all(body, '<a href="'))::BIGINT AS n_links FROM n""",
}
