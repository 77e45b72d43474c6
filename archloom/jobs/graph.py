"""Graph jobs: closure of hosts, routes of a tree, what each link leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.functions import text as X
from archloom.functions import urls as U
from archloom.jobs.urls import ORACLE_SQL as URL_SQL
from archloom.jobs.urls import page_anchors
from archloom.jobs.tree import parent_id, place_pages
from archloom.operators.graph import build_routes, routes_of_urls
from archloom.operators.graph import host_closure as closure
from archloom.operators.ranking import numbered
from archloom.sources.scratch import Scratch
from archloom.sources.tables import table


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"))


def host_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, page, place, label): links between hosts; host pairs once, with the place and text of their first link.

    A link of one word leads to the host of the first page whose heading begins with that word, if that is another host.
    Links are brought to one row for each host and word before the join, so a word that all pages link to is no large group.
    """
    pages = table(spark, sf_dir, "pages").where("url is not null").select("page_id", U.host(F.col("url")).alias("host"), "html")
    word = F.regexp_extract("html", r"<h1>([^\s<&]+)", 1)
    homes = pages.select(word.alias("word"), "page_id", "host").where("word <> ''").groupBy("word").agg(F.min_by("host", F.struct("page_id", "host")).alias("dst"))
    anchors = pages.select("page_id", "host", F.posexplode(F.regexp_extract_all("html", F.lit(r'(<a href="/[^"/?#]+">[^<]*)</a>'), F.lit(1))).alias("place", "a"))
    each = anchors.select(F.col("host").alias("src"), F.regexp_extract("a", 'href="/([^"]*)"', 1).alias("word"), F.struct("page_id", F.col("place").cast("long").alias("place"), F.regexp_extract("a", ">([^<]*)$", 1).alias("label")).alias("x"))
    first = each.groupBy("src", "word").agg(F.min("x").alias("x"))
    pairs = first.join(homes, "word").where("src <> dst").groupBy("src", "dst").agg(F.min("x").alias("x"))
    return pairs.select("src", "dst", F.col("x.page_id").alias("page"), "x.place", "x.label")


def _start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mobile sites, which the crawl begins with."""
    return _hosts(spark, sf_dir).where("host like 'm.%'").select("host").distinct()


def _links(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    return scratch.keep(host_edges(spark, sf_dir)).select("src", "dst", F.struct("page", "place").alias("pos"), "label")


def host_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts reached from the mobile sites, by hop (G1), each host with its own prefix: ``host_claims`` is the crawl with prefixes by label."""
    scratch = Scratch(spark, "closure")
    return _closure(spark, sf_dir, _links(spark, sf_dir, scratch), scratch)


def _closure(spark: SparkSession, sf_dir: str, links: DataFrame, scratch: Scratch) -> DataFrame:
    prefixes = _hosts(spark, sf_dir).select("host").distinct().withColumn("prefix", F.concat(F.lit("plays/"), F.translate("host", ".", "-")))
    out = closure(links, _start(spark, sf_dir), prefixes, scratch)
    return out.select("host", F.col("hop").cast("long").alias("hop"), "status")


#: Link texts that name nothing.
STOP_WORDS = ("the", "of", "in", "de", "un", "is", "was")


def host_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl of hosts in its order (G1, G4, K1): a host's shelf is the first two letters of the text of the first link to it; hosts without a usable text (stop words say nothing), and those whose shelf is taken, aren't followed."""
    letters = lambda text: F.regexp_extract(U.slugify(text), "^[a-z]{2}", 0)
    named = lambda text: F.when(X.usable_label(text, (*X.EMPTY_WORDS, *STOP_WORDS)) & (letters(text) != ""), F.concat(F.lit("plays/"), letters(text)))
    start = _start(spark, sf_dir)
    scratch = Scratch(spark, "claims")
    out = closure(_links(spark, sf_dir, scratch), start, start.withColumn("prefix", F.concat(F.lit("sites/"), F.translate("host", ".", "-"))), scratch, named)
    return out.select("host", F.col("hop").cast("long").alias("hop"), "place", "label", "prefix", "status")


def host_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page that names each subdomain, and the order of the names (G7, K1): smallest (page) by partial aggregation."""
    h = _hosts(spark, sf_dir).withColumn("sub", F.substring_index("host", ".", 1))
    first = h.groupBy("sub").agg(F.min(F.struct("page_id", "host")).alias("x"))
    rows = first.select("sub", F.col("x.host").alias("host"), F.col("x.page_id").alias("page_id"))
    return numbered(rows, Scratch(spark, "catalogue"), "page_id", "sub").withColumnRenamed("n", "place")


def stand_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that no page is served at and that hold just one page: that page stands in."""
    u = F.col("url")
    p = table(spark, sf_dir, "pages").select(U.canonical(u).alias("url"), U.parent(u).alias("dir")).distinct()
    missing = p.join(p.select(F.col("url").alias("dir")).distinct(), "dir", "left_anti").where("dir is not null")
    return missing.groupBy("dir").agg(F.count("*").alias("n"), F.min("url").alias("url")).where("n = 1").select("dir", "url")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of the place tree."""
    pages = place_pages(spark, sf_dir)
    with_parent = pages.select("id", "title", "ord", parent_id(F.col("id")).alias("parent"))
    return build_routes(with_parent, Scratch(spark, "routes")).select("id", "route", F.col("depth").cast("long").alias("depth"))


def first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first link to each url calls it (K1): the least (page, place) of its usable texts, by partial aggregation."""
    links = page_anchors(spark, sf_dir).where(X.usable_label(F.col("text")) & F.col("target").isNotNull())
    first = links.groupBy("target").agg(F.min(F.struct("page_id", "pos", "text")).alias("x"))
    return first.select(F.col("target").alias("url"), F.trim("x.text").alias("label"))


def url_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of the pages' own urls (G5): ancestors that nobody crawled, stand-ins, and hosts that share a prefix."""
    heading = F.trim(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1))
    read = table(spark, sf_dir, "pages").select(U.canonical(F.col("url")).alias("url"), F.struct("page_id", X.visible(heading).alias("title")).alias("x")).where("url is not null")
    pages = read.groupBy("url").agg(F.min("x").alias("x")).select("url", "x.title", F.col("x.page_id").alias("ord"))
    hosts = pages.select(U.host(F.col("url")).alias("host")).distinct()
    prefixes = hosts.withColumn("prefix", F.when(F.col("host").startswith("www."), "").otherwise(F.concat(F.lit("plays/"), U.slugify(F.regexp_replace("host", r"^(m|blog)\.|\.example\.\w+$", "")))))
    return routes_of_urls(pages, first_labels(spark, sf_dir), prefixes, Scratch(spark, "url-routes")).select("url", "route", F.col("depth").cast("long").alias("depth"))


def link_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each distinct link target becomes, with its references (J1, K3): kept, document, route of a page, host's prefix, else unresolved.

    References are summed to distinct targets before the joins, so the links that all pages share cost one row.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    refs = pages.select(U.host(F.col("url")).alias("host"), href.alias("href")).groupBy("host", "href").agg(F.count("*").alias("refs"))
    absolute = F.when(F.col("href").startswith("/"), F.concat(F.lit("http://"), F.col("host"), F.col("href"))).otherwise(F.col("href"))
    refs = refs.withColumn("target", U.canonical(absolute))
    served = pages.select(U.canonical(F.col("url")).alias("target")).distinct().withColumn("page", F.lit(True))
    known = pages.select(U.host(F.col("url")).alias("t_host")).distinct().withColumn("prefix", F.concat(F.lit("/plays/"), F.translate("t_host", ".", "-")))
    out = refs.join(served, "target", "left").withColumn("t_host", U.host(F.col("target"))).join(known, "t_host", "left")
    kind = F.when(F.col("href").rlike("^(mailto|tel):"), "kept").when(U.is_document(F.col("target")), "document").when(F.col("page"), "page").when(F.col("prefix").isNotNull(), "prefix").otherwise("unresolved")
    return out.select("href", "refs", kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("targets"), F.sum("refs").alias("refs"))


def unvisited_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that are linked to, and whether the crawl from the mobile sites visited them."""
    scratch = Scratch(spark, "unvisited")
    links = _links(spark, sf_dir, scratch)
    linked = links.select(F.col("dst").alias("host")).distinct()
    visited = _closure(spark, sf_dir, links, scratch).where("status = 'crawled'").select("host", F.lit(True).alias("visited"))
    return linked.join(visited, "host", "left").select("host", F.coalesce("visited", F.lit(False)).alias("visited"))


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, and labels without a document."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    a = d.join(lab, "doc_id", "left_anti").withColumn("missing", F.lit("label"))
    return a.unionByName(lab.join(d, "doc_id", "left_anti").withColumn("missing", F.lit("document")))


def labelled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their label's quality as order, 9999 where there is none."""
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return table(spark, sf_dir, "documents").select("doc_id").join(lab, "doc_id", "left").select("doc_id", F.coalesce("q", F.lit(9999)).cast("long").alias("ord"))


def category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in an array to names, order kept, unknown ones dropped (J6): by a lookup of fixed size."""
    ids = F.array(F.col("c_nationkey"), F.col("c_nationkey") + 13, F.col("c_nationkey") + 1)
    each = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(ids).alias("pos", "n_nationkey"))
    named = each.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return named.groupBy("c_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n_name"))), lambda x: x["n_name"]), ",").alias("names"))


_H = "h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages)"
_E = """w AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, html, regexp_extract(html, '<h1>([^\\s<&]+)', 1) AS word FROM pages),
m AS (SELECT word, arg_min(host, (page_id, host)) AS dst FROM w WHERE word <> '' GROUP BY word),
n AS (SELECT page_id, host AS src, unnest(regexp_extract_all(html, '(<a href="/[^"/?#]+">[^<]*)</a>', 1)) AS a, generate_subscripts(regexp_extract_all(html, '(<a href="/[^"/?#]+">[^<]*)</a>', 1), 1) - 1 AS place FROM w),
e AS (SELECT src, dst, arg_min((page_id, place, regexp_extract(a, '>([^<]*)$', 1)), (page_id, place)) AS x FROM n JOIN m ON m.word = regexp_extract(a, 'href="/([^"]*)"', 1) WHERE src <> dst GROUP BY ALL)"""
_REACHED = "r AS (SELECT DISTINCT host, 0::BIGINT AS hop FROM h WHERE host LIKE 'm.%' UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.host WHERE r.hop < 60)"
_PATH = "CASE WHEN regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1) END"


def _canon(u: str) -> str:
    p = _PATH.format(u=u)
    return f"('http://' || lower(regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1)) || CASE WHEN {p} NOT LIKE '%.%' AND {p} NOT LIKE '%/' THEN {p} || '/' ELSE {p} END)"


QUERIES = {f.__name__: f for f in (host_edges, host_closure, host_claims, host_catalogue, stand_ins, routes, first_labels, url_routes, link_disposition, unvisited_hosts, unlabelled, labelled_order, category_names)}
ORACLE_SQL = {
    "host_edges": f"WITH {_E} SELECT src, dst, x[1] AS page, x[2]::BIGINT AS place, x[3] AS label FROM e",
    "host_closure": f"WITH RECURSIVE {_H}, {_E}, {_REACHED} SELECT host, min(hop) AS hop, 'crawled' AS status FROM r GROUP BY host",
    "host_catalogue": f"""WITH {_H}, f AS (SELECT string_split(host, '.')[1] AS sub, min(page_id) AS page_id, arg_min(host, page_id) AS host FROM h GROUP BY ALL)
SELECT sub, host, page_id, row_number() OVER (ORDER BY page_id, sub) AS place FROM f""",
    "stand_ins": f"""WITH p AS (SELECT DISTINCT {_canon('url')} AS url, 'http://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || regexp_replace(regexp_replace({_PATH.format(u='url')}, '/$', ''), '[^/]*$', '') AS dir FROM pages)
SELECT dir, min(url) AS url FROM p WHERE dir NOT IN (SELECT url FROM p) GROUP BY dir HAVING count(*) = 1""",
    "first_labels": """SELECT target AS url, arg_min(trim(text), (page_id, pos)) AS label FROM (""" + URL_SQL["page_anchors"] + """)
WHERE trim(text) <> '' AND length(trim(text)) <= 60 AND NOT regexp_matches(trim(text), '(?i)^(here|click|button|this|more|link)\\b') GROUP BY target""",
    "routes": """WITH s AS (
  SELECT lower(r_name) AS id, regexp_replace(regexp_replace(lower(r_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, NULL AS parent, 0::BIGINT AS depth FROM region
  UNION ALL SELECT lower(r_name) || '/' || lower(n_name), regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), lower(r_name), 1 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT lower(r_name) || '/' || lower(n_name) || '/c' || c_custkey, regexp_replace(regexp_replace(lower(n_name || ': ' || c_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), lower(r_name) || '/' || lower(n_name), 2
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)
SELECT c.id, CASE c.depth WHEN 0 THEN c.slug WHEN 1 THEN p.slug || '/' || c.slug ELSE g.slug || '/' || p.slug || '/' || c.slug END AS route, c.depth FROM s c LEFT JOIN s p ON p.id = c.parent LEFT JOIN s g ON g.id = p.parent""",
    "link_disposition": f"""WITH r AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
g AS (SELECT host, href, count(*) AS refs, CASE WHEN href LIKE '/%' THEN 'http://' || host || href ELSE href END AS u FROM r GROUP BY ALL),
t AS (SELECT *, {_canon('u')} AS target FROM g), served AS (SELECT DISTINCT {_canon('url')} AS target FROM pages), hosts AS (SELECT DISTINCT host AS t_host FROM r)
SELECT kind, count(*) AS targets, sum(refs)::BIGINT AS refs FROM (
  SELECT refs, CASE WHEN regexp_matches(href, '^(mailto|tel):') THEN 'kept' WHEN regexp_matches(target, '(?i)\\.(pdf|docx?|rtf|zip)$') THEN 'document' WHEN target IN (SELECT target FROM served) THEN 'page'
    WHEN lower(regexp_extract(target, '^[a-z]+://([^/?#]*)', 1)) IN (SELECT t_host FROM hosts) THEN 'prefix' ELSE 'unresolved' END AS kind FROM t) GROUP BY kind""",
    "unvisited_hosts": f"WITH RECURSIVE {_H}, {_E}, {_REACHED} SELECT DISTINCT dst AS host, dst IN (SELECT host FROM r) AS visited FROM e",
    "unlabelled": "SELECT doc_id, 'label' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'document' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "labelled_order": "SELECT doc_id, coalesce(q, 9999)::BIGINT AS ord FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)",
    "category_names": "SELECT c_custkey, string_agg(n_name, ',' ORDER BY pos) AS names FROM (SELECT c_custkey, unnest([c_nationkey, c_nationkey + 13, c_nationkey + 1]) AS k, unnest([0, 1, 2]) AS pos FROM customer) JOIN nation ON n_nationkey = k GROUP BY c_custkey",
}
