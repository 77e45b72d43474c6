"""Curated pages: listings, chronologies, casts, names of vague links, captions and pictures of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archloom.functions import text as X
from archloom.functions import urls as U
from archloom.operators import lines as L
from archloom.sources.tables import table


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's curated page as listing rows (E11), with the page of each title (J5) and its poster."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_size") % 6
    markup = (
        F.when(k == 0, F.concat(F.lit("<p><strong>"), "p_type", F.lit("</strong></p>")))
        .when(k == 1, F.concat(F.lit("<p><b>"), "p_name", F.lit(" and what else the season has to show by "), "p_brand", F.lit("</b></p>")))
        .when(k == 2, F.concat(F.lit("<p>About <b>"), "p_name", F.lit("</b> &amp; more</p>")))
        .when(k == 3, F.concat(F.lit("<p>◦ <strong>"), "p_name", F.lit("</strong> on tour</p>")))
        .otherwise(F.concat(F.lit("<p>◦ <strong>"), "p_name", F.lit("</strong> at the "), "p_brand", F.lit(" ("), "p_type", F.lit(')<br/>See <a href="/x/'), F.col("p_partkey").cast("string"), F.lit('">here</a></p>')))
    )
    rows = L.listing_rows(part.select(F.col("p_brand").alias("page_id"), F.col("p_partkey").alias("pos"), markup.alias("markup")))
    pages = part.where("p_size > 20").select(F.initcap("p_name").alias("title"), F.concat(F.lit("plays/"), U.slugify(F.col("p_name"))).alias("route"))
    posters = part.where("p_size > 40").select(F.concat(F.lit("plays/"), U.slugify(F.col("p_name"))).alias("route"), F.concat("p_brand", F.lit(".jpg")).alias("poster"))
    return L.listing_targets(rows, pages, posters)


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronologies in each customer's page of orders (E12), with runs, labels and lines that go on."""
    day = F.to_date("o_orderdate")
    dated = F.concat(F.lit("**"), F.dayofmonth(day).cast("string"), F.date_format(day, " MMMM yyyy"), F.lit("**"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), "o_orderpriority")).otherwise(""))
    k = F.col("o_orderkey") % 7
    text = (
        F.when(k == 4, F.concat(dated, F.lit("\n○ Event "), "o_orderpriority", F.lit("\n.. and on")))
        .when(k == 5, F.concat(F.lit("Prose "), "o_orderpriority"))
        .when(k == 6, F.concat(F.lit("Before\n**As "), "o_orderstatus", F.lit("**\nBelow it\n"), dated, F.lit("\n.. wrapped\n**○** Marked\n**○ B**old")))
        .otherwise(dated)
    )
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = L.timeline_rows(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), pos.alias("pos"), text.alias("text")))
    return rows.select("page_id", F.col("run").cast("long").alias("run"), F.col("entry").cast("long").alias("entry"), "kind", "label", F.col("year").cast("long").alias("year"), F.array_join("events", "|").alias("events"))


def cast_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cast tables with their credits (E16): some pages credit a director above, some hold a line that is no row."""
    k = F.col("p_partkey") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("**Director** "), "p_brand", F.lit("\n**Role** **Actor**\n**Anna** "), "p_name", F.lit("\n**Ben** "), "p_type"))
        .when(k == 1, F.concat(F.lit("**Team** **Score**\n**"), "p_brand", F.lit("** "), F.col("p_size").cast("string")))
        .when(k == 2, F.concat(F.lit("By "), "p_name", F.lit("\n**Role** **Actors**\n**Anna** "), "p_brand"))
        .when(k == 3, F.concat(F.lit("**Role** **Actor**\n"), "p_name"))
        .otherwise(F.concat(F.lit("**"), "p_name", F.lit("** **Actor**")))
    )
    rows = L.cast_tables(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit(0).alias("pos"), text.alias("text")))
    said = lambda c: F.array_join(F.transform(c, lambda v: F.concat(v["label"], F.lit("="), v["value"])), ";")
    return rows.select("page_id", "caption", F.array_join("columns", "|").alias("columns"), said(F.col("credits")).alias("credits"), said(F.col("rows")).alias("entries"))


def vague_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for a link at the end of each whole text (D20), and the text with that link labelled."""
    shown = F.when(F.col("doc_id") % 3 == 0, "here").when(F.col("doc_id") % 3 == 1, "Click here.").otherwise("the text")
    clean = F.translate("text", "<>&", "")
    markup = F.concat(F.lit("<p>"), clean, F.lit(' <a href="/x">'), shown, F.lit("</a></p>"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.link_name(clean, shown).alias("name"), X.label_links(markup).alias("m"))
    return rows.select("doc_id", "name", F.md5("m").alias("labelled"))


def post_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each text as a post's caption, its last line of tags apart."""
    tags = F.concat(F.lit("\n\n#"), F.coalesce("lang", F.lit("x")), F.lit(" @"), F.coalesce("source", F.lit("x")))
    said = F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.when(F.col("doc_id") % 2 == 0, tags).otherwise(""))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.caption(said).alias("c"))
    return rows.select("doc_id", F.size("c.lines").cast("long").alias("n_lines"), F.col("c.tags").alias("tags"))


def post_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each post's pictures in order: those of its carousel, else its own."""
    pic = lambda src, alt, video: F.struct(src.alias("src"), alt.alias("alt"), video.alias("video"))
    none = F.lit(None).cast("string")
    own = pic(F.concat("p_brand", F.lit(".jpg")), F.when(F.col("p_size") > 25, F.col("p_name")), F.when(F.col("p_size") > 40, True))
    more = F.array(pic(F.lit("a.jpg"), none, F.lit(None).cast("boolean")), pic(F.lit("b.mp4"), F.col("p_type"), F.lit(True)))
    children = F.when(F.col("p_partkey") % 3 == 0, more).when(F.col("p_partkey") % 3 == 1, F.slice(more, 1, 0))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(X.pictures_of(children, own)).alias("pos", "p"))
    return rows.select("p_partkey", F.col("pos").cast("long").alias("pos"), "p.src", "p.alt", "p.video")


QUERIES = {f.__name__: f for f in (listing_pages, timelines, cast_tables, vague_links, post_captions, post_pictures)}
_VAGUE_SQL = r"'(?i)^(click\s+)?(here|this(\s+page)?|link|more|read\s+more)[.,:;)]*$'"
_TAIL_SQL = r"regexp_extract(translate(array_to_string(list_filter(string_split(array_to_string(s[-{0}:], ' '), ' '), lambda w: w <> '')[-10:], ' '), '()[]', ''), '[\pL\pN].*$')"
ORACLE_SQL = {
    "listing_pages": r"""WITH m AS (SELECT p_brand AS page_id, p_partkey AS pos, CASE p_size % 6 WHEN 0 THEN '<p><strong>' || p_type || '</strong></p>' WHEN 1 THEN '<p><b>' || p_name || ' and what else the season has to show by ' || p_brand || '</b></p>'
  WHEN 2 THEN '<p>About <b>' || p_name || '</b> &amp; more</p>' WHEN 3 THEN '<p>◦ <strong>' || p_name || '</strong> on tour</p>' ELSE '<p>◦ <strong>' || p_name || '</strong> at the ' || p_brand || ' (' || p_type || ')<br/>See <a href="/x/' || p_partkey || '">here</a></p>' END AS x FROM part),
r AS (SELECT page_id, pos, x, replace(regexp_replace(replace(x, '<br/>', chr(10)), '<[^>]+>', '', 'g'), '&amp;', '&') AS raw, regexp_extract(x, '<(?:strong|b)>([^<]*)<', 1) AS bold FROM m),
k AS (SELECT *, CASE WHEN raw LIKE '◦%' THEN 'item' WHEN bold = raw AND length(raw) < 40 THEN 'heading' WHEN bold = raw THEN 'dropped' ELSE 'intro' END AS kind FROM r),
h AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN raw END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS under, kind = 'item' AS i FROM k),
o AS (SELECT page_id, pos, kind, CASE WHEN i THEN under END AS heading, CASE WHEN i THEN bold END AS title,
  CASE WHEN i THEN coalesce('The ' || nullif(regexp_extract(raw, ' at the ([^(]*) \(', 1), ''), nullif(regexp_extract(raw, ' on tour$', 0)[2:], '')) END AS venue, CASE WHEN i THEN regexp_extract(raw, '\(([^()]*)\)', 1) END AS dates,
  CASE WHEN i THEN split_part(raw, chr(10), 2) END AS detail, nullif(regexp_extract(x, 'href="([^"]*)"', 1), '') AS href FROM h WHERE kind IN ('item', 'intro')),
p AS (SELECT lower(p_name) AS n, min('plays/' || replace(lower(p_name), ' ', '-')) AS route, min(CASE WHEN p_size > 40 THEN p_brand || '.jpg' END) AS poster FROM part WHERE p_size > 20 GROUP BY 1)
SELECT o.*, route, poster FROM o LEFT JOIN p ON n = lower(title)""",
    "timelines": r"""WITH d AS (SELECT o_custkey AS page_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderkey % 7 AS k, o_orderstatus AS st, o_orderpriority AS pr,
  '**' || day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) || '**' || CASE WHEN o_orderstatus = 'F' THEN ' ' || o_orderpriority ELSE '' END AS dated FROM orders),
t AS (SELECT page_id, pos, string_split(CASE k WHEN 4 THEN dated || chr(10) || '○ Event ' || pr || chr(10) || '.. and on' WHEN 5 THEN 'Prose ' || pr
  WHEN 6 THEN 'Before' || chr(10) || '**As ' || st || '**' || chr(10) || 'Below it' || chr(10) || dated || chr(10) || '.. wrapped' || chr(10) || '**○** Marked' || chr(10) || '**○ B**old' ELSE dated END, chr(10)) AS x FROM d),
l AS (SELECT page_id, pos, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM t),
c AS (SELECT *, CASE WHEN regexp_matches(line, '^\*\*\d+ [A-Z][a-z]+ \d{4}\*\*') THEN 'date' WHEN regexp_matches(line, '^\*\*As .\*\*$') THEN 'label' WHEN line LIKE '..%' THEN 'wrap' ELSE 'event' END AS kind FROM l),
b AS (SELECT *, trim(CASE kind WHEN 'date' THEN regexp_replace(line, '^\*\*[^*]+\*\*', '') WHEN 'label' THEN replace(line, '*', '') WHEN 'wrap' THEN substr(line, 3) ELSE replace(replace(replace(line, '**○** ', ''), '**○ ', '**'), '○ ', '') END) AS body,
  count(*) FILTER (kind = 'date') OVER (PARTITION BY page_id) AS n, max((kind = 'date')::INT) OVER (PARTITION BY page_id, pos) AS live FROM c),
g AS (SELECT *, pos - lag(pos, 1, -9) OVER (PARTITION BY page_id ORDER BY pos, i) > 1 AS gap FROM b WHERE n >= 6 AND live = 1),
r AS (SELECT *, sum(gap::INT) OVER (PARTITION BY page_id ORDER BY pos, i) AS run FROM g),
e AS (SELECT *, count(*) FILTER (kind IN ('date', 'label')) OVER (PARTITION BY page_id, run ORDER BY pos, i) AS entry FROM r),
s AS (SELECT *, CASE WHEN first_value(kind) OVER (PARTITION BY page_id, run, entry ORDER BY pos, i) = 'date' THEN 'date' WHEN kind = 'label' THEN 'label' ELSE 'prose' END AS shown FROM e),
w AS (SELECT *, shown <> 'date' OR (kind <> 'wrap' AND body <> '') OR (kind = 'wrap' AND count(*) FILTER (body <> '') OVER (PARTITION BY page_id, run, entry, shown ORDER BY pos, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0) AS starts FROM s),
v AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY page_id, run, entry, shown ORDER BY pos, i) AS event FROM w),
a AS (SELECT page_id, run, entry, shown, event, string_agg(body, ' ' ORDER BY pos, i) AS said, max(CASE WHEN kind = 'date' THEN regexp_extract(line, '^\*\*([^*]+)\*\*', 1) END) AS label FROM v GROUP BY ALL)
SELECT page_id, run::BIGINT AS run, entry, shown AS kind, max(label) AS label, max(right(label, 4)::BIGINT) AS year, coalesce(string_agg(trim(said), '|' ORDER BY event) FILTER (event > 0), '') AS events FROM a GROUP BY page_id, run, entry, shown""",
    "cast_tables": r"""WITH t AS (SELECT p_partkey AS page_id, string_split(CASE p_partkey % 5 WHEN 0 THEN '**Director** ' || p_brand || chr(10) || '**Role** **Actor**' || chr(10) || '**Anna** ' || p_name || chr(10) || '**Ben** ' || p_type
  WHEN 1 THEN '**Team** **Score**' || chr(10) || '**' || p_brand || '** ' || p_size WHEN 2 THEN 'By ' || p_name || chr(10) || '**Role** **Actors**' || chr(10) || '**Anna** ' || p_brand WHEN 3 THEN '**Role** **Actor**' || chr(10) || p_name ELSE '**' || p_name || '** **Actor**' END, chr(10)) AS x FROM part),
a AS (SELECT *, list_position(list_transform(x, lambda v: regexp_matches(v, '^\*\*[^*]+\*\* \*\*[^*]+\*\*$')), true) AS k FROM t),
b AS (SELECT *, regexp_extract_all(x[k], '\*\*([^*]+)\*\*', 1) AS c, x[:k - 1] AS up, x[k + 1:] AS down FROM a WHERE k > 0 AND k < len(x))
SELECT page_id, CASE WHEN lower(c[2]) SIMILAR TO 'actors?.*' THEN 'Cast' END AS caption, array_to_string(c, '|') AS columns,
  array_to_string(list_transform(up, lambda v: regexp_replace(v, '^\*\*([^*]+)\*\* ', '\1=')), ';') AS credits, array_to_string(list_transform(down, lambda v: regexp_replace(v, '^\*\*([^*]+)\*\* ', '\1=')), ';') AS entries
FROM b WHERE len(list_filter(list_concat(up, down), lambda v: NOT regexp_matches(v, '^\*\*[^*]+\*\* .'))) = 0""",
    "vague_links": f"""WITH d AS (SELECT doc_id, translate(text, '<>&', '') AS t, CASE doc_id % 3 WHEN 0 THEN 'here' WHEN 1 THEN 'Click here.' ELSE 'the text' END AS own FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, string_split(regexp_replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS s FROM d),
n AS (SELECT *, CASE WHEN NOT regexp_matches(own, {_VAGUE_SQL}) THEN own ELSE coalesce(nullif({_TAIL_SQL.format(1)}, '') || ' ' || own, CASE WHEN len(s) > 1 THEN nullif({_TAIL_SQL.format(2)}, '') || ' ' || own END, '') END AS name FROM s)
SELECT doc_id, name, md5('<p>' || t || ' <a href="/x"' || CASE WHEN doc_id % 3 < 2 AND name <> '' THEN ' aria-label="' || replace(replace(name, '"', '&quot;'), '''', '&#x27;') || '"' ELSE '' END || '>' || own || '</a></p>') AS labelled FROM n""",
    "post_captions": """SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda v: trim(v) <> '')) AS n_lines, CASE WHEN doc_id % 2 = 0 AND len(list_filter(string_split(text, chr(10)), lambda v: trim(v) <> '')) > 0 THEN '#' || coalesce(lang, 'x') || ' @' || coalesce(source, 'x') ELSE '' END AS tags FROM documents WHERE text IS NOT NULL""",
    "post_pictures": """SELECT p_partkey, 0::BIGINT AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'a.jpg' ELSE p_brand || '.jpg' END AS src, CASE WHEN p_partkey % 3 <> 0 AND p_size > 25 THEN p_name ELSE '' END AS alt, p_partkey % 3 <> 0 AND p_size > 40 AS video FROM part
UNION ALL SELECT p_partkey, 1, 'b.mp4', p_type, true FROM part WHERE p_partkey % 3 = 0""",
}
