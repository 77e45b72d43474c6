"""Catalogue jobs: orders, bands, neighbours, tallies per year, boards of dated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archloom.functions import text as X
from archloom.operators.ranking import numbered
from archloom.sources.scratch import Scratch
from archloom.sources.tables import table

DAY = "1998-06-15"
#: Years without an entry from which on a gap is shown.
GAP_YEARS = 5


def shelf_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand by shelf key, each with the next on its shelf."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lower(X.sort_key(F.concat(F.lit("The "), "p_name"))).alias("shelf"))
    # one order over all shelves, by ranges: a shelf may hold a third of all rows
    scratch = Scratch(spark, "shelf")
    rows = scratch.keep(numbered(rows, scratch, "p_brand", "shelf", "p_partkey"))
    first = rows.groupBy("p_brand").agg(F.min("n").alias("first"))
    after = rows.select((F.col("n") - 1).alias("n"), F.col("p_brand").alias("next_brand"), F.col("p_partkey").alias("next_key"))
    next_key = F.when(F.col("next_brand").eqNullSafe(F.col("p_brand")), F.col("next_key"))
    placed = rows.join(after, "n", "left").select("p_partkey", "p_brand", "shelf", "n", next_key.alias("next_key"))
    same = F.col("p_brand").eqNullSafe(F.col("of_brand"))
    return placed.join(first.withColumnRenamed("p_brand", "of_brand"), same).select("p_partkey", "p_brand", "shelf", (F.col("n") - F.col("first") + 1).alias("place"), "next_key")


def collated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in catalogue order (M1, M2): by the year of their order, undated last, then by title as readers sort it.

    A title is a text's first line, up to 60 characters, in the order of the UNICODE collation: marks and case count
    only between titles that are else equal. Nulls are empty titles; equal titles go by id.
    """
    dated = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_orderkey").alias("doc_id")).agg(F.year(F.min("o_orderdate")).cast("long").alias("year"))
    title = F.substring(F.trim(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)), 1, 60)
    docs = table(spark, sf_dir, "documents").select("doc_id", title.alias("title")).join(dated, "doc_id", "left")
    keyed = docs.withColumn("undated", F.col("year").isNull()).withColumn("shelf", F.collate("title", "UNICODE"))
    return numbered(keyed, Scratch(spark, "collated"), "undated", "year", "shelf", "doc_id").select("doc_id", "year", "title", F.col("n").alias("place"))


def newest_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six newest orders of each year (M3, M4)."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")).withColumn("year", F.year("day"))
    newest = Window.partitionBy("year").orderBy(F.desc("day"), "o_orderkey")
    return rows.withColumn("place", F.row_number().over(newest)).where("place <= 6").select("o_orderkey", F.col("year").cast("long").alias("year"), F.col("place").cast("long").alias("place"))


def per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per year and in all (K4): the total row has no year."""
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))
    return rows.rollup("year").agg(F.count("*").alias("n")).select(F.col("year").cast("long").alias("year"), "n")


def year_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per year: orders, lines, first and last month."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    both = orders.join(lines, "o_orderkey", "left")
    return both.groupBy(F.year("day").cast("long").alias("year")).agg(F.count("*").alias("posts"), F.sum(F.coalesce("lines", F.lit(0))).alias("pictures"), F.month(F.min("day")).cast("long").alias("first_month"), F.month(F.max("day")).cast("long").alias("last_month"))


def decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by decade."""
    return table(spark, sf_dir, "orders").groupBy(X.decade(F.year("o_orderdate")).cast("long").alias("decade")).agg(F.count("*").alias("n"))


def year_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's years of orders with the newer and older one."""
    years = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("year")).distinct()
    line = Window.partitionBy("o_custkey").orderBy("year")
    return years.select("o_custkey", "year", F.lag("year").over(line).alias("older"), F.lead("year").over(line).alias("newer"))


def year_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one year in each customer's orders by key, gaps of ``GAP_YEARS`` or more, anchors, first-of-date flags."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("day"))
    line = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = rows.withColumn("before", F.lag("year").over(line))
    rows = rows.withColumn("band", F.sum(F.when(F.col("before").isNull() | (F.col("before") != F.col("year")), 1).otherwise(0)).over(line))
    head = F.row_number().over(Window.partitionBy("o_custkey", "band").orderBy("o_orderkey")) == 1
    rows = rows.withColumn("head", head)
    nth = F.sum(F.col("head").cast("int")).over(Window.partitionBy("o_custkey", "year").orderBy("o_orderkey"))
    anchor = F.concat(F.lit("y"), F.col("year").cast("string"), F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(""))
    shown = F.row_number().over(Window.partitionBy("o_custkey", "day").orderBy("o_orderkey")) == 1
    gap = F.when(F.col("head") & (F.abs(F.col("year") - F.col("before")) >= GAP_YEARS), F.abs(F.col("year") - F.col("before")))
    return rows.select("o_custkey", "o_orderkey", F.col("band").cast("long").alias("band"), gap.cast("long").alias("gap"), anchor.alias("anchor"), shown.alias("date_shown"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated runs: from the order's day for as many days as its key leaves by 90; some ends open."""
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, F.when(k % 7 == 0, F.lit(None).cast("date")).otherwise(day).alias("start"), F.when(k % 5 == 0, F.lit(None).cast("date")).otherwise(F.date_add(day, (k % 90).cast("int"))).alias("end"))


def run_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and progress of each run on a day."""
    d = F.lit(DAY).cast("date")
    return _runs(spark, sf_dir).select("o_orderkey", X.run_status(F.col("start"), F.col("end"), d).alias("status"), X.run_progress(F.col("start"), F.col("end"), d).cast("long").alias("progress"))


def closing_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All open runs by closing date, open ends last, and all coming runs by opening date, each with its place among those of its month (M5)."""
    rows = _runs(spark, sf_dir)
    status = X.run_status(F.col("start"), F.col("end"), F.lit(DAY).cast("date"))
    rows = rows.select("o_orderkey", status.alias("status"), "start", "end").where(F.col("status").isin("now", "soon"))
    day = F.when(F.col("status") == "now", F.col("end")).otherwise(F.col("start"))
    rows = rows.select("o_orderkey", "status", day.alias("day"), F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("open")).alias("month"))
    place = F.row_number().over(Window.partitionBy("status", "month").orderBy("day", "o_orderkey"))
    return rows.select("o_orderkey", "status", "month", F.col("day").cast("string").alias("day"), place.cast("long").alias("place"))


def running_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs are open on each month's first day: each run once for each month it covers, no range join."""
    rows = _runs(spark, sf_dir).where("start is not null and `end` is not null")
    from_day = F.when(F.dayofmonth("start") == 1, F.col("start")).otherwise(F.trunc(F.add_months("start", 1), "month"))
    return rows.where(from_day <= F.col("end")).select(F.explode(F.sequence(from_day, F.col("end"), F.expr("interval 1 month"))).alias("day")).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("open_runs"))


def distinct_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once for each user, kind and day; the first in time stays."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    same = Window.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id")
    return rows.withColumn("n", F.row_number().over(same)).where("n = 1").select("event_id", "user_id", "event_type")


def hours_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length texts made from values, read back as seconds, per kind and in hours."""
    v = F.floor(F.abs("value")).cast("long")
    length = F.concat((v / 60).cast("long").cast("string"), F.lit(":"), F.lpad((v % 60).cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "events").where("value is not null").select("event_type", X.seconds(length).cast("long").alias("s"))
    return rows.groupBy("event_type").agg(F.sum("s").alias("seconds"), F.round(F.sum("s") / 3600).cast("long").alias("hours"))


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of a brand numbered where they repeat: the second unlike part of one name gets -2."""
    rows = table(spark, sf_dir, "part").select("p_brand", F.substring_index("p_name", " ", 1).alias("name"), "p_partkey")
    n = F.row_number().over(Window.partitionBy("p_brand", "name").orderBy("p_partkey"))
    return rows.select("p_partkey", F.when(n > 1, F.concat("name", F.lit("-"), n.cast("string"))).otherwise(F.col("name")).alias("key"))


_RUNS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END AS s, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate::DATE + (o_orderkey % 90)::INTEGER END AS e FROM orders)"
_NOW = f"coalesce(e, DATE '9999-12-31') >= DATE '{DAY}' AND coalesce(s, DATE '0001-01-01') <= DATE '{DAY}'"
QUERIES = {f.__name__: f for f in (shelf_order, collated_titles, newest_per_year, per_year, year_sheet, decades, year_neighbours, year_bands, run_board, closing_first, running_calendar, distinct_listings, hours_total, name_keys)}
ORACLE_SQL = {
    "collated_titles": """WITH d AS (SELECT o_orderkey AS doc_id, min(year(o_orderdate))::BIGINT AS year FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderkey),
t AS (SELECT doc_id, year, left(trim(split_part(coalesce(text, ''), chr(10), 1), ' '), 60) AS title FROM documents LEFT JOIN d USING (doc_id))
SELECT doc_id, year, title, row_number() OVER (ORDER BY year NULLS LAST, icu_sort_key(title, 'und'), doc_id) AS place FROM t""",
    "shelf_order": "SELECT p_partkey, p_brand, shelf, row_number() OVER w AS place, lead(p_partkey) OVER w AS next_key FROM (SELECT p_partkey, p_brand, lower(regexp_replace('The ' || p_name, '(?i)^(the|a|an)\\s+', '')) AS shelf FROM part) WINDOW w AS (PARTITION BY p_brand ORDER BY shelf, p_partkey)",
    "newest_per_year": "SELECT o_orderkey, year, place FROM (SELECT o_orderkey, year(o_orderdate)::BIGINT AS year, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate::DATE DESC, o_orderkey) AS place FROM orders) WHERE place <= 6",
    "per_year": "SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders GROUP BY ROLLUP (year(o_orderdate))",
    "year_sheet": "SELECT year(day)::BIGINT AS year, count(*) AS posts, sum(coalesce(lines, 0))::BIGINT AS pictures, month(min(day))::BIGINT AS first_month, month(max(day))::BIGINT AS last_month FROM (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders) LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS lines FROM lineitem GROUP BY ALL) USING (o_orderkey) GROUP BY year(day)",
    "decades": "SELECT (year(o_orderdate) // 10 * 10)::BIGINT AS decade, count(*) AS n FROM orders GROUP BY ALL",
    "year_neighbours": "SELECT o_custkey, year, lag(year) OVER w AS older, lead(year) OVER w AS newer FROM (SELECT DISTINCT o_custkey, year(o_orderdate)::BIGINT AS year FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY year)",
    "year_bands": """
WITH a AS (
  SELECT o_custkey, o_orderkey, year(o_orderdate) AS y, o_orderdate::DATE AS day, lag(year(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders
), c AS (
  SELECT *, (b IS NULL OR b <> y) AS head, sum((b IS NULL OR b <> y)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS band FROM a
), d AS (
  SELECT *, sum(head::INT) OVER (PARTITION BY o_custkey, y ORDER BY o_orderkey) AS nth FROM c
)
SELECT o_custkey, o_orderkey, band::BIGINT AS band, CASE WHEN head AND abs(y - b) >= 5 THEN abs(y - b) END::BIGINT AS gap,
  'y' || y || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS anchor, row_number() OVER (PARTITION BY o_custkey, day ORDER BY o_orderkey) = 1 AS date_shown
FROM d""",
    "run_board": f"SELECT o_orderkey, CASE WHEN s IS NULL AND e IS NULL THEN 'any' WHEN {_NOW} THEN 'now' WHEN s > DATE '{DAY}' THEN 'soon' ELSE 'closed' END AS status, CASE WHEN e - s > 0 THEN least(100, greatest(0, round(100.0::DOUBLE * (DATE '{DAY}' - s) / (e - s))::INT)) END::BIGINT AS progress FROM {_RUNS}",
    "closing_first": f"""SELECT *, row_number() OVER (PARTITION BY status, month ORDER BY day, o_orderkey) AS place FROM (
  SELECT o_orderkey, status, coalesce(strftime(d, '%Y-%m'), 'open') AS month, d::VARCHAR AS day FROM (
    SELECT o_orderkey, CASE WHEN {_NOW} THEN 'now' ELSE 'soon' END AS status, CASE WHEN {_NOW} THEN e ELSE s END AS d FROM {_RUNS} WHERE (s IS NOT NULL OR e IS NOT NULL) AND ({_NOW} OR s > DATE '{DAY}')))""",
    "running_calendar": f"""
WITH m AS (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2005-12-01', INTERVAL 1 MONTH))::DATE AS day)
SELECT day::VARCHAR AS day, count(*) AS open_runs FROM m JOIN {_RUNS} ON day BETWEEN s AND e GROUP BY day""",
    "distinct_listings": "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
    "hours_total": "SELECT event_type, sum(floor(abs(value))::BIGINT)::BIGINT AS seconds, round(sum(floor(abs(value))::BIGINT) / 3600)::BIGINT AS hours FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "name_keys": "SELECT p_partkey, CASE WHEN n > 1 THEN name || '-' || n ELSE name END AS key FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS name, row_number() OVER (PARTITION BY p_brand, string_split(p_name, ' ')[1] ORDER BY p_partkey) AS n FROM part)",
}
