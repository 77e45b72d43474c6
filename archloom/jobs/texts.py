"""Text jobs: the scalar functions over the given tables, or over lines that Spark makes from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archloom.functions import text as X
from archloom.operators.lines import with_dates
from archloom.sources.tables import table


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of each page's article (D1, D2) and its comparable form."""
    body = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)
    shown = X.visible(body)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(shown).alias("text_md5"), F.char_length(shown).cast("long").alias("n"), F.md5(X.normal(shown)).alias("normal_md5"))


def word_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each page before and after tags go, and the share that is kept."""
    words = lambda s: F.size(F.filter(F.split(s, r"[\s]+"), lambda x: x != ""))
    source = F.regexp_replace("html", "<[^>]+>", " ")
    kept = F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1), "<[^>]+>", " ")
    rows = table(spark, sf_dir, "pages").select("page_id", words(source).alias("source_words"), words(kept).alias("kept_words"))
    return rows.select("page_id", F.col("source_words").cast("long").alias("source_words"), F.col("kept_words").cast("long").alias("kept_words"), F.round(F.col("kept_words") / F.nullif("source_words", F.lit(0)), 4).alias("share"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title from heading, label or nothing; year in parentheses; is the text usable as a label; excerpt."""
    heading = F.concat(F.substring_index("text", ".", 1), F.lit(" ("), (1900 + F.col("doc_id") % 120).cast("string"), F.lit(")"))
    override = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Fixed "), F.col("doc_id").cast("string"))).otherwise("")
    first = F.substring_index("text", " ", 1)
    return table(spark, sf_dir, "documents").select("doc_id", X.page_title(override, heading, F.col("lang")).alias("title"), X.title_year(heading).cast("long").alias("year"), X.usable_label(first).alias("usable"), X.excerpt(F.concat(F.substring_index("text", "\n", 1), F.lit(" […] Continue reading more"))).alias("excerpt"))


def markdown_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped, plain and link-only forms of the whole text."""
    line = F.regexp_replace("text", " ", "  ")
    md = F.concat(F.lit("![alt](/a.png) ["), F.translate(line, "[]()", ""), F.lit("](/x) *b* https://e.org/p."))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.escape_md(line)).alias("escaped"), F.md5(X.plain(md)).alias("plain"), X.link_text_length(md).cast("long").alias("link_chars"), F.md5(X.linked(md)).alias("linked"), F.md5(X.link_markdown(md)).alias("anchored"), F.md5(X.description(md, F.col("lang"))).alias("described"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronology lines from orders: dates written four ways, and some lines that are none."""
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 8
    long = F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.date_format(day, "MMMM"), F.lit(" "), F.year(day).cast("string"))
    label = (
        F.when(k == 0, F.concat(F.lit("○ "), long, F.lit(":")))
        .when(k == 1, F.year(day).cast("string"))
        .when(k == 2, F.concat(F.year(day).cast("string"), F.lit("-"), (F.year(day) + 3).cast("string"), F.lit(":")))
        .when(k == 3, F.concat(F.lit("• Mid-"), F.date_format(day, "MMMM"), F.lit(" "), F.year(day).cast("string")))
        .when(k == 4, F.concat(F.lit("late "), F.year(day).cast("string"), F.lit(" / early "), (F.year(day) + 1).cast("string")))
        .when(k == 5, F.concat(F.year(day).cast("string"), F.lit(" (a cast list)")))
        .when(k == 6, F.col("o_orderstatus"))
        .otherwise(long)
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", label.alias("raw"))


def chronology_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date labels, their years and what is left beside a year band."""
    rows = with_dates(_dated(spark, sf_dir), "raw")
    return rows.select("o_orderkey", F.col("d.label").alias("label"), F.col("d.year").cast("long").alias("year"), X.when_of(F.col("d.label"), F.col("d.year")).alias("shown"))


def chronology_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each customer's chronology (E12): a date opens an entry, other lines belong to it; only where six lines are dated."""
    rows = with_dates(_dated(spark, sf_dir), "raw")
    line = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    dated = F.col("d").isNotNull()
    rows = rows.withColumn("n", F.count_if(dated).over(Window.partitionBy("o_custkey"))).where("n >= 6")
    rows = rows.withColumn("entry", F.sum(dated.cast("int")).over(line)).where("entry > 0")
    return rows.groupBy("o_custkey", "entry").agg(F.max("d.label").alias("label"), F.max("d.year").cast("long").alias("year"), F.count_if(~dated).alias("events")).withColumn("entry", F.col("entry").cast("long"))


def listing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written as text and read back as dates (D11): several forms, years left out in some, runs over New Year too."""
    a = F.to_date("o_orderdate")
    b = F.date_add(a, (F.col("o_orderkey") % 60).cast("int"))
    say = lambda d, fmt: F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), F.date_format(d, fmt))
    k = F.col("o_orderkey") % 5
    when = (
        F.when(k == 0, F.concat(say(a, "MMMM"), F.lit(" – "), say(b, "MMMM yyyy")))
        .when(k == 1, F.concat(F.lit("Until "), say(b, "MMMM yyyy")))
        .when(k == 2, F.concat(F.lit("From "), say(a, "MMM yyyy")))
        .when(k == 3, F.concat(say(a, "MMMM yyyy"), F.lit(", 7.30pm")))
        .otherwise("Streaming")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", X.run_dates(when, F.lit("1998-06-15").cast("date")).alias("r"))
    return rows.select("o_orderkey", F.col("r.from").cast("string").alias("from_day"), F.col("r.to").cast("string").alias("to_day"))


def listing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulleted lines split into title, venue and dates, and the date of posting."""
    title = F.initcap("p_name")
    lead = F.concat(F.lit("◦ "), title, F.lit(" at the "), F.col("p_brand"), F.lit(" ("), F.col("p_type"), F.lit(")"))
    stamp = F.concat(F.when(F.col("p_partkey") % 3 == 0, "updated ").otherwise(""), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"), F.lit("/06/26"))
    rows = table(spark, sf_dir, "part").select("p_partkey", X.listing_line(lead, F.concat(F.lit("◦ "), title)).alias("l"), X.posted(stamp).alias("s"))
    return rows.select("p_partkey", "l.title", F.col("l.where").alias("venue"), F.col("l.when").alias("dates"), F.col("s.posted").cast("string").alias("posted"), F.col("s.revised").alias("revised"))


def heading_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading levels of each conversation, from the length of its turns, re-ranked by nesting."""
    level = (F.char_length("text") % 6 + 1).cast("int")
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and text is not null").select("conv_id", F.struct("turn", level.alias("l"), F.xxhash64("text").alias("h")).alias("x"))
    both = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]).alias("levels"))
    return both.select("conv_id", F.array_join("levels", ",").alias("levels"), F.array_join(X.rerank(F.col("levels")), ",").alias("ranked"))


def carried_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's last turn carried to the turns below it (W8), and each turn's first line as paragraphs."""
    line = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null")
    head = F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(line)
    return rows.select("conv_id", "turn", head.alias("under"), F.size(X.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


def post_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each post from a priority list, venue before the comma, pictures' shapes."""
    cats = F.array(F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, "Interview").otherwise("News"), F.when(F.col("p_partkey") % 4 == 0, "Video").otherwise("Other"))
    w = (F.col("p_partkey") % 7 + 1).cast("int")
    pics = F.array(F.struct(w.alias("width"), F.lit(4).alias("height"), F.lit("a").alias("src")), F.struct(F.lit(5).alias("width"), w.alias("height"), F.lit("b").alias("src")))
    facts = F.create_map(F.lit("Venue"), F.concat("p_name", F.lit(", "), F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", X.kind_of(cats).alias("kind"), X.short_venue(X.first_fact(facts, "World Premiere Venue", "Venue")).alias("venue"), X.tallest_shape(pics).alias("shape"), X.largest(pics)["src"].alias("largest"))


def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page node with its breadcrumb list as safe JSON."""
    crumbs = F.transform(F.array(F.lit("Home"), F.col("lang"), F.concat(F.lit("<"), F.col("source"))), lambda x, i: F.struct(F.lit("ListItem").alias("type"), (i + 1).alias("position"), x.alias("name")))
    node = F.struct(F.lit("WebPage").alias("type"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"), F.struct(F.lit("BreadcrumbList").alias("type"), crumbs.alias("items")).alias("breadcrumb"))
    return table(spark, sf_dir, "documents").select("doc_id", X.json_ld(node).alias("ld"))


_ART = r"regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_DEC = "x"
for _a, _b in X.ENTITIES:
    _DEC = f"replace({_DEC}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
_VIS = r"regexp_replace(" + _DEC.replace("(x,", rf"(regexp_replace({_ART}, '<[^>]+>', '', 'g'),", 1) + r", '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_HEAD = "string_split(text, '.')[1]"
_LINE = "regexp_replace(text, ' ', '  ', 'g')"
_MD = f"('![alt](/a.png) [' || translate({_LINE}, '[]()', '') || '](/x) *b* https://e.org/p.')"
_RAW = """(SELECT *, o_orderdate::DATE AS d, CASE o_orderkey % 8 WHEN 0 THEN '○ ' || day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) || ':' WHEN 1 THEN year(o_orderdate)::VARCHAR
  WHEN 2 THEN year(o_orderdate) || '-' || (year(o_orderdate) + 3) || ':' WHEN 3 THEN '• Mid-' || monthname(o_orderdate) || ' ' || year(o_orderdate) WHEN 4 THEN 'late ' || year(o_orderdate) || ' / early ' || (year(o_orderdate) + 1)
  WHEN 5 THEN year(o_orderdate) || ' (a cast list)' WHEN 6 THEN o_orderstatus ELSE day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) END AS raw FROM orders)"""
_LAB = """(SELECT *, CASE o_orderkey % 8 WHEN 0 THEN rtrim(substr(raw, 3), ':') WHEN 2 THEN year(o_orderdate) || ' – ' || (year(o_orderdate) + 3) WHEN 3 THEN 'Mid ' || substr(raw, 7) WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE raw END AS label FROM """ + _RAW + ")"
QUERIES = {f.__name__: f for f in (visible_text, word_retention, titles, markdown_runs, chronology_labels, chronology_events, listing_dates, listing_lines, heading_ranks, carried_headings, post_kinds, structured_data)}
ORACLE_SQL = {
    "visible_text": f"SELECT page_id, md5(v) AS text_md5, length(v)::BIGINT AS n, md5(trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g'))) AS normal_md5 FROM (SELECT page_id, {_VIS} AS v FROM pages)",
    "word_retention": f"SELECT page_id, s AS source_words, k AS kept_words, round(k::DOUBLE / nullif(s, 0), 4) AS share FROM (SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[^\\s]+'))::BIGINT AS s, len(regexp_extract_all(regexp_replace({_ART}, '<[^>]+>', ' ', 'g'), '[^\\s]+'))::BIGINT AS k FROM pages)",
    "titles": f"""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Fixed ' || doc_id ELSE coalesce(nullif(trim(regexp_replace({_HEAD}, '^[A-Z]\\w+: ', '')), ''), lang) END AS title, (1900 + doc_id % 120)::BIGINT AS year,
  trim(f) <> '' AND length(trim(f)) <= 60 AND NOT regexp_matches(trim(f), '(?i)^(here|click|button|this|more|link)\\b') AS usable, trim(string_split(text, chr(10))[1] || ' …') AS excerpt FROM (SELECT *, string_split(text, ' ')[1] AS f FROM documents)""",
    "markdown_runs": f"""SELECT doc_id, md5(regexp_replace(regexp_replace({_LINE}, '\\s+', ' ', 'g'), '([\\\\*_\\[\\]`])', '\\\\\\1', 'g')) AS escaped, md5(trim(regexp_replace(regexp_replace({_MD}, '[\\\\*]', '', 'g'), '\\s+', ' ', 'g'))) AS plain,
  length(translate({_LINE}, '[]()', ''))::BIGINT AS link_chars,
  md5(regexp_replace(replace(replace(replace({_MD}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(https?://)([^\\s<]+[^\\s<.,;:!?)])', '<a href="\\1\\2">\\2</a>', 'g')) AS linked,
  md5(regexp_replace({_MD}, '\\[([^\\]]+)\\]\\(([^)]+)\\)', '<a href="\\2">\\1</a>', 'g')) AS anchored,
  md5(coalesce(nullif(left(trim(regexp_replace(regexp_replace({_MD}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_\\\\]', '', 'g')), 200), ''), lang || ' in the archive.')) AS described FROM documents""",
    "chronology_labels": f"""SELECT o_orderkey, label, CASE WHEN label IS NOT NULL THEN year(o_orderdate) END::BIGINT AS year,
  CASE WHEN label = year(o_orderdate)::VARCHAR THEN '' WHEN o_orderkey % 8 IN (0, 3, 7) THEN rtrim(left(label, length(label) - 4)) ELSE label END AS shown FROM {_LAB}""",
    "chronology_events": f"""WITH a AS (SELECT *, count(label) OVER (PARTITION BY o_custkey) AS n, count(label) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS entry FROM {_LAB})
SELECT o_custkey, entry, max(label) AS label, max(CASE WHEN label IS NOT NULL THEN year(o_orderdate) END)::BIGINT AS year, count(*) FILTER (label IS NULL) AS events FROM a WHERE n >= 6 AND entry > 0 GROUP BY o_custkey, entry""",
    "listing_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 2, 3) THEN a END::VARCHAR AS from_day, CASE o_orderkey % 5 WHEN 0 THEN b WHEN 1 THEN b WHEN 3 THEN a END::VARCHAR AS to_day
FROM (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 60)::INTEGER AS b FROM orders)""",
    "listing_lines": """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title, 'The ' || p_brand AS venue, p_type AS dates,
  '2026-06-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS posted, p_partkey % 3 = 0 AS revised FROM part""",
    "heading_ranks": """WITH RECURSIVE l AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, (length(text) % 6 + 1)::INT AS l FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL
), r AS (
  SELECT conv_id, 0::BIGINT AS i, []::INT[] AS open, 0::BIGINT AS rank FROM (SELECT DISTINCT conv_id FROM l)
  UNION ALL SELECT r.conv_id, l.i, list_append(list_filter(r.open, lambda x: x < l.l), l.l), least(len(list_filter(r.open, lambda x: x < l.l)) + 2, 6)::BIGINT FROM r JOIN l ON l.conv_id = r.conv_id AND l.i = r.i + 1
)
SELECT conv_id, (SELECT string_agg(l.l::VARCHAR, ',' ORDER BY l.i) FROM l WHERE l.conv_id = r.conv_id) AS levels, string_agg(rank::VARCHAR, ',' ORDER BY i) AS ranked FROM r WHERE i > 0 GROUP BY conv_id""",
    "carried_headings": """SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS under,
  len(list_filter(regexp_split_to_array(text, '\\n{2,}'), lambda x: trim(x) <> ''))::BIGINT AS paragraphs FROM conversations WHERE conv_id IS NOT NULL""",
    "post_kinds": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Video' WHEN p_partkey % 3 = 0 THEN 'Interview' END AS kind, trim(string_split(p_name, ',')[1]) AS venue, round(least((p_partkey % 7 + 1) / 4.0::DOUBLE, 5.0::DOUBLE / (p_partkey % 7 + 1)), 4) AS shape,
  CASE WHEN p_partkey % 7 + 1 >= 5 THEN 'a' ELSE 'b' END AS largest FROM part""",
    "structured_data": """SELECT doc_id, replace('{"type":"WebPage","url":"https://example.org/' || doc_id || '","breadcrumb":{"type":"BreadcrumbList","items":[{"type":"ListItem","position":1,"name":"Home"},{"type":"ListItem","position":2,"name":"' || lang || '"},{"type":"ListItem","position":3,"name":"<' || source || '"}]}}', '<', '\\u003c') AS ld FROM documents""",
}
