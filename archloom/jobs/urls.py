"""URL jobs over ``pages``: spellings, shapes, names, and the links of each page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.functions import urls as U
from archloom.sources.tables import table

DOMAIN = "example.com"
#: Hosts that stand for others, by subdomain, and the route prefixes of sections.
ALIASES = {"m": "www", "blog": "www"}
SECTIONS = {"www": "", "news": "news", "library": "research"}


def url_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical url, host, subdomain and the tests of a url's shape."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        U.canonical(u).alias("canonical"),
        U.host(u).alias("host"),
        U.subdomain(U.host(u), DOMAIN).alias("sub"),
        U.is_internal(U.host(u), DOMAIN).alias("internal"),
        U.is_page(u).alias("is_page"),
        U.is_document(u).alias("is_document"),
    )


def url_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, parent directory, depth and file flag."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(U.segments(u), "/").alias("segments"), U.parent(u).alias("parent"), U.depth(u).cast("long").alias("depth"), U.is_file(u).alias("is_file"))


def host_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host folded onto the one it stands for: the first label's alias, by a broadcast lookup."""
    pages = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"), F.col("url"))
    values = ", ".join(f"('{a}', '{b}')" for a, b in ALIASES.items())
    alias = spark.sql(f"SELECT * FROM VALUES {values} AS t(label, folded)")
    out = pages.withColumn("label", F.substring_index("host", ".", 1)).join(F.broadcast(alias), "label", "left")  # as long as ALIASES
    folded = F.when(F.col("folded").isNotNull(), F.concat("folded", F.lit("."), F.substr("host", F.char_length("label") + 2)))
    return out.select("page_id", F.coalesce(folded, F.col("host")).alias("host"), U.canonical(F.col("url"), folded).alias("canonical"))


def route_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that names a host's route prefix: section, play by its slug, else none; and the facet of the path's head."""
    u = F.col("url")
    sub = F.substring_index(U.host(u), ".", 1)
    head = F.coalesce(F.get(U.segments(u), 0), F.lit(""))
    section = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    facet = F.create_map(*[F.lit(x) for kv in {"en": "English", "fr": "French"}.items() for x in kv])
    prefix = F.coalesce(F.try_element_at(section, sub), F.when(sub.startswith("th"), F.concat(F.lit("plays/"), U.slugify(sub))))
    return table(spark, sf_dir, "pages").select("page_id", prefix.alias("prefix"), F.coalesce(F.try_element_at(facet, head), F.lit("The Archive")).alias("facet"), F.coalesce(prefix.rlike("^plays/[^/]+$"), F.lit(False)).alias("is_play"))


def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File name and media key made from each url."""
    bare = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", U.file_name(bare).alias("file_name"), U.media_key(F.col("url")).alias("media_key"))


def text_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slug of each document's first line."""
    return table(spark, sf_dir, "documents").select("doc_id", U.slugify(F.substring_index("text", "\n", 1)).alias("slug"))


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor with its place, text and target as seen from the page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'(<a href="[^"]*">[^<]*)</a>'), F.lit(1))).alias("pos", "a"))
    href = F.regexp_extract("a", 'href="([^"]*)"', 1)
    absolute = U.resolve(href, F.col("url"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("a", ">([^<]*)$", 1).alias("text"), U.canonical(absolute).alias("target"))


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's links, written in eight ways as relative references, as seen from the page (C1): distinct and with their count."""
    refs = table(spark, sf_dir, "pages").select("url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    bare = F.substr("href", F.lit(2))
    ways = [F.col("href"), bare, F.concat(F.lit(".."), F.col("href")), F.concat(F.lit("./x/../../"), bare, F.lit("/.")), F.concat(F.lit("?q="), bare), F.concat(F.lit("#"), bare), F.concat(F.lit("//other.org/a/../../"), bare), F.concat(F.lit("mailto:"), bare)]
    each = refs.select("url", F.posexplode(F.array(*ways)).alias("way", "ref"))
    return each.select(F.col("way").cast("long").alias("way"), U.resolve(F.col("ref"), F.col("url")).alias("target")).groupBy("way", "target").agg(F.count("*").alias("n"))


_CANON = """CASE WHEN regexp_matches(url, '^https?://[^/?#]+') THEN 'http://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) ||
  CASE WHEN p NOT LIKE '%.%' AND p NOT LIKE '%/' THEN p || '/' ELSE p END END"""
_P = "(SELECT *, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS p, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h FROM pages)"
_PARTS = f"(SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS parts FROM {_P})"
_SEG = """CASE WHEN len(parts) = 0 OR NOT contains(parts[-1], '.') THEN parts
  WHEN regexp_matches(parts[-1], '(?i)^(index|default)\\.') THEN parts[1:-2] ELSE list_append(parts[1:-2], regexp_replace(parts[-1], '\\.[^.]+$', '')) END"""


def slug_sql(x: str) -> str:
    s = f"regexp_replace(strip_accents({x}), '[''‘’\"“”]', '', 'g')"
    s = f"regexp_replace(regexp_replace(replace(lower({s}), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
    return f"CASE WHEN {s} = '' THEN 'page' ELSE left({s}, 70) END"


QUERIES = {f.__name__: f for f in (url_spelling, url_segments, host_alias, route_prefix, url_names, text_slugs, page_anchors, resolved_links)}
ORACLE_SQL = {
    "url_spelling": f"""
SELECT page_id, {_CANON} AS canonical, h AS host, replace(h, '.{DOMAIN}', '') AS sub, h LIKE '%{DOMAIN}' AS internal,
  NOT regexp_matches(p, '(^|/)contact-form(-\\d+)?/') AND (NOT contains(string_split(p, '/')[-1], '.') OR regexp_matches(string_split(p, '/')[-1], '(?i)\\.(html?|shtml)$')) AS is_page,
  regexp_matches(url, '(?i)\\.(pdf|docx?|rtf|zip)$') AS is_document
FROM {_P}""",
    "url_segments": f"""
SELECT page_id, array_to_string(seg, '/') AS segments, CASE WHEN len(parts) > 0 THEN 'http://' || h || '/' || array_to_string(list_transform(parts[1:-2], lambda x: x || '/'), '') END AS parent,
  len(seg)::BIGINT AS depth, contains(string_split(p, '/')[-1], '.') AS is_file
FROM (SELECT *, {_SEG} AS seg FROM {_PARTS})""",
    "host_alias": f"""
SELECT page_id, folded AS host, 'http://' || folded || CASE WHEN p NOT LIKE '%.%' AND p NOT LIKE '%/' THEN p || '/' ELSE p END AS canonical
FROM (SELECT *, regexp_replace(h, '^(m|blog)\\.', 'www.') AS folded FROM {_P})""",
    "route_prefix": f"""
SELECT page_id, prefix, CASE coalesce(seg[1], '') WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE 'The Archive' END AS facet, coalesce(regexp_matches(prefix, '^plays/[^/]+$'), false) AS is_play
FROM (SELECT *, CASE sub WHEN 'www' THEN '' WHEN 'news' THEN 'news' WHEN 'library' THEN 'research' ELSE CASE WHEN sub LIKE 'th%' THEN 'plays/' || ({slug_sql("sub")}) END END AS prefix
  FROM (SELECT *, string_split(h, '.')[1] AS sub, {_SEG} AS seg FROM {_PARTS}))""",
    "url_names": f"""
SELECT page_id, ({slug_sql("CASE WHEN regexp_matches(b, '^.+\\.') THEN regexp_replace(b, '\\.[^.]*$', '') ELSE b END")}) || CASE WHEN regexp_matches(b, '^.+\\.') THEN lower(regexp_extract(b, '(\\.[^.]*)$', 1)) ELSE '' END AS file_name,
  'news/undated/' || ({slug_sql("regexp_replace(l, '\\.[A-Za-z0-9]+$', '')")}) || CASE WHEN regexp_extract(l, '(\\.[A-Za-z0-9]+)$', 1) = '' THEN '.jpg' ELSE lower(regexp_extract(l, '(\\.[A-Za-z0-9]+)$', 1)) END AS media_key
FROM (SELECT *, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] AS b, string_split(p, '/')[-1] AS l FROM {_P})""",
    "text_slugs": f"SELECT doc_id, {slug_sql('string_split(text, chr(10))[1]')} AS slug FROM documents",
    "resolved_links": r"""
WITH r AS (
  SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages
), w AS (
  SELECT url, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS way, unnest([href, href[2:], '..' || href, './x/../../' || href[2:] || '/.', '?q=' || href[2:], '#' || href[2:], '//other.org/a/../../' || href[2:], 'mailto:' || href[2:]]) AS ref,
    regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS q FROM r
), c AS (
  SELECT *, CASE way WHEN 0 THEN ref WHEN 6 THEN regexp_replace(ref, '^//other.org', '') WHEN 4 THEN p WHEN 5 THEN p ELSE regexp_extract(p, '^.*/', 0) || ref END AS path FROM w
), d AS (
  SELECT *, list_reduce(list_concat([[]::VARCHAR[]], list_transform(string_split(path, '/')[2:], lambda x: [x])), lambda a, x: CASE WHEN x[1] = '..' THEN a[1:-2] WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END) AS kept FROM c
), e AS (
  SELECT *, '/' || array_to_string(CASE WHEN string_split(path, '/')[-1] IN ('.', '..') THEN list_append(kept, '') ELSE kept END, '/') AS clean FROM d
)
SELECT way, CASE WHEN way = 7 THEN ref WHEN way = 6 THEN scheme || '://other.org' || clean WHEN way = 4 THEN origin || clean || ref WHEN way = 5 THEN origin || clean || q || ref ELSE origin || clean END AS target, count(*) AS n
FROM e GROUP BY ALL""",
    "page_anchors": r"""
WITH a AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '(<a href="[^"]*">[^<]*)</a>', 1)) AS a, generate_subscripts(regexp_extract_all(html, '(<a href="[^"]*">[^<]*)</a>', 1), 1) - 1 AS pos FROM pages
), b AS (
  SELECT *, regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM a
), c AS (
  SELECT *, regexp_extract(CASE WHEN href LIKE '/%' THEN 'http://x' || href ELSE href END, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM b
)
SELECT page_id, pos::BIGINT AS pos, regexp_extract(a, '>([^<]*)$', 1) AS text,
  'http://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || CASE WHEN p NOT LIKE '%.%' AND p NOT LIKE '%/' THEN p || '/' ELSE p END AS target
FROM c""",
}
