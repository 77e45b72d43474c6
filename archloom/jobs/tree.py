"""Tree jobs: a path is an id; parents, trails, sections and child lists by equi-joins on path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.operators import sections as S
from archloom.operators.sections import RAIL_MAX, parent_id, prints_own_index
from archloom.sources.scratch import Scratch
from archloom.sources.tables import table


def ancestors(path: Column) -> Column:
    """Every proper prefix of a path at a ``/``, the farthest first."""
    parts = F.split(path, "/")
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def place_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, ord): regions, their nations and the nations' customers as pages of one tree."""
    region = table(spark, sf_dir, "region").select(F.lower("r_name").alias("id"), F.col("r_name").alias("title"), F.col("r_regionkey").cast("long").alias("ord"), "r_regionkey")
    nation = table(spark, sf_dir, "nation").join(region.select("r_regionkey", F.col("id").alias("up")), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nation.select(F.concat("up", F.lit("/"), F.lower("n_name")).alias("id"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("long").alias("ord"), "n_nationkey")
    customer = table(spark, sf_dir, "customer").join(nation.select("n_nationkey", F.col("id").alias("up"), F.col("title").alias("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    customer = customer.select(F.concat("up", F.lit("/c"), F.col("c_custkey").cast("string")).alias("id"), F.concat("nation", F.lit(": "), "c_name").alias("title"), F.col("c_custkey").cast("long").alias("ord"))
    return region.select("id", "title", "ord").unionByName(nation.select("id", "title", "ord")).unionByName(customer)


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, ord): the places, and customers as heads of their orders, below which are their lines."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    head = F.concat(F.lit("customer"), F.col("c_custkey").cast("string"))
    order = F.concat(head, F.lit("/o"), F.col("o_orderkey").cast("string"))
    customers = table(spark, sf_dir, "customer").select(head.alias("id"), F.col("c_name").alias("title"), F.col("c_custkey").cast("long").alias("ord"))
    orders = o.select(order.alias("id"), F.concat("c_name", F.lit(": "), "o_orderpriority").alias("title"), F.col("o_orderkey").cast("long").alias("ord"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    lines = lines.join(o.select("o_orderkey", order.alias("order")), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select(F.concat("order", F.lit("/l"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("Part "), F.col("part").cast("string")).alias("title"), F.col("l_linenumber").cast("long").alias("ord"))
    return place_pages(spark, sf_dir).unionByName(customers).unionByName(orders).unionByName(lines)


def child_lists(pages: DataFrame) -> DataFrame:
    """(parent, n, labels, own_index): children in order, named by what sets them apart; whether the parent prints its own index.

    A long list is never nested elsewhere, so only the ``RAIL_MAX`` + 1 first labels are held.
    """
    from pyspark.sql import Window

    from archloom.functions.text import list_label

    c = pages.select("title", "ord", "id", parent_id(F.col("id")).alias("parent")).where("parent is not null")
    named = c.join(pages.select(F.col("id").alias("parent"), F.col("title").alias("parent_title")), "parent", "left")
    named = named.withColumn("label", list_label(F.col("title"), F.col("parent_title"), F.lit("")))
    counts = named.groupBy("parent").agg(F.count("*").alias("n"), F.max(F.char_length("label")).alias("longest"))
    first = named.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy("ord", "id"))).where(F.col("place") <= RAIL_MAX)
    lists = first.groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), "|").alias("labels"))
    return counts.join(lists, "parent").select("parent", "n", "labels", prints_own_index(F.col("n"), F.col("longest")).alias("own_index"))


def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, J11, D17, F7, K14."""
    return child_lists(place_pages(spark, sf_dir))


def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles of a page's existing ancestors, the nearest last (J10): ancestors are exploded, so the join is on equality."""
    pages = place_pages(spark, sf_dir)
    up = pages.select("id", F.posexplode(ancestors(F.col("id"))).alias("pos", "up"))
    found = up.join(pages.select(F.col("id").alias("up"), F.col("title").alias("up_title")), "up")
    trails = found.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "up_title"))), lambda x: x["up_title"]), " > ").alias("trail"))
    return pages.select("id").join(trails, "id", "left").select("id", F.coalesce("trail", F.lit("")).alias("trail"))


def with_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that have anything below them (J9, F2), by a semi-join on exploded ancestors."""
    pages = place_pages(spark, sf_dir)
    above = pages.select(F.explode(ancestors(F.col("id"))).alias("id")).distinct()
    return pages.join(above, "id", "left_semi").select("id", "title")


def section_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page shows beside it (J12): its section, and the group that opens inside it if it is short enough."""
    pages = place_pages(spark, sf_dir)
    lists = child_lists(pages)
    root = F.substring_index("id", "/", 1)
    p = pages.select("id", root.alias("root"), parent_id(F.col("id")).alias("parent"))
    p = p.join(lists.select(F.col("parent").alias("root"), F.col("n").alias("section_size")), "root", "left")
    p = p.join(lists.select(F.col("parent").alias("id"), F.col("n").alias("own_n"), F.col("labels").alias("own_labels"), F.col("own_index").alias("own_idx")), "id", "left")
    p = p.join(lists.select("parent", F.col("n").alias("up_n"), F.col("labels").alias("up_labels")), "parent", "left")
    nested = (
        F.when(F.col("id") == F.col("root"), "")
        .when(F.col("own_n") > 0, F.when(F.col("own_idx"), "").otherwise(F.col("own_labels")))
        .when((F.col("parent") != F.col("root")) & (F.col("up_n") <= RAIL_MAX), F.col("up_labels"))
        .otherwise("")
    )
    anchor = F.substring_index("id", "/", -1)
    return p.select("id", "root", F.coalesce("section_size", F.lit(0)).alias("section_size"), nested.alias("nested"), anchor.alias("anchor"))


def child_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child of every parent in its place, however many there are."""
    return S.ordered_children(section_pages(spark, sf_dir), Scratch(spark, "children")).select("parent", "place", "id", "label")


def section_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stops of each section, where they are found, and what they list themselves."""
    stops = S.section_stops(section_pages(spark, sf_dir), Scratch(spark, "sections"))
    under = F.array_join(F.transform("under", lambda u: F.concat(u["id"], F.lit("="), u["label"])), "|")
    return stops.select("root", "place", "id", "label", "merged", "target", under.alias("under"))


_PAGES = """pages_ AS (
  SELECT lower(r_name) AS id, r_name AS title, r_regionkey::BIGINT AS ord FROM region
  UNION ALL SELECT lower(r_name) || '/' || lower(n_name), n_name, n_nationkey::BIGINT FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT lower(r_name) || '/' || lower(n_name) || '/c' || c_custkey, n_name || ': ' || c_name, c_custkey::BIGINT FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
_LISTS = """named AS (
  SELECT c.id, c.ord, p.id AS parent, CASE WHEN p.title IS NOT NULL AND contains(c.title, ': ') AND string_split(c.title, ': ')[1] LIKE '%' || p.title THEN substr(c.title, instr(c.title, ': ') + 2) ELSE c.title END AS label
  FROM pages_ c JOIN pages_ p ON p.id = regexp_replace(c.id, '/[^/]*$', '') AND contains(c.id, '/')
), lists AS (
  SELECT parent, count(*) AS n, string_agg(label, '|' ORDER BY ord, id) FILTER (place <= 20) AS labels, count(*) > 20 OR (count(*) > 6 AND max(length(label)) <= 5) AS own_index
  FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ord, id) AS place FROM named) GROUP BY parent
)"""
_SECTIONS = _PAGES.replace("pages_ AS", "few AS") + """, o AS (SELECT 'customer' || c_custkey || '/o' || o_orderkey AS id, o_orderkey, c_name || ': ' || o_orderpriority AS title FROM orders JOIN customer ON o_custkey = c_custkey),
pages_ AS (SELECT * FROM few UNION ALL SELECT 'customer' || c_custkey, c_name, c_custkey::BIGINT FROM customer UNION ALL SELECT id, title, o_orderkey::BIGINT FROM o
  UNION ALL SELECT id || '/l' || l_linenumber, 'Part ' || min(l_partkey), l_linenumber::BIGINT FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY id, l_linenumber)"""
QUERIES = {f.__name__: f for f in (tree_children, breadcrumbs, with_descendants, section_lists, child_places, section_stops)}
ORACLE_SQL = {
    "tree_children": f"WITH {_PAGES}, {_LISTS} SELECT parent, n, labels, own_index FROM lists",
    "child_places": f"WITH {_SECTIONS}, {_LISTS} SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY ord, id) AS place, id, label FROM named",
    "section_stops": f"""WITH {_SECTIONS}, {_LISTS},
kids AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ord, id) AS place FROM named), u AS (SELECT parent, string_agg(id || '=' || label, '|' ORDER BY place) AS under FROM kids GROUP BY parent HAVING count(*) <= 20)
SELECT k.parent AS root, place, k.id, label, NOT own_index AS merged, CASE WHEN own_index THEN k.id ELSE k.parent || '#' || string_split(k.id, '/')[-1] END AS target, CASE WHEN own_index THEN '' ELSE coalesce(under, '') END AS under
FROM kids k JOIN lists l ON l.parent = k.parent LEFT JOIN u ON u.parent = k.id WHERE NOT contains(k.parent, '/')""",
    "breadcrumbs": f"WITH {_PAGES} SELECT c.id, coalesce(string_agg(p.title, ' > ' ORDER BY length(p.id)), '') AS trail FROM pages_ c LEFT JOIN pages_ p ON c.id LIKE p.id || '/%' GROUP BY c.id",
    "with_descendants": f"WITH {_PAGES} SELECT id, title FROM pages_ p WHERE EXISTS (SELECT 1 FROM pages_ c WHERE c.id LIKE p.id || '/%')",
    "section_lists": f"""WITH {_PAGES}, {_LISTS}
SELECT q.id, q.root, coalesce(s.n, 0) AS section_size, CASE WHEN q.id = q.root THEN '' WHEN o.n > 0 THEN CASE WHEN o.own_index THEN '' ELSE o.labels END
  WHEN q.parent <> q.root AND u.n <= 20 THEN u.labels ELSE '' END AS nested, string_split(q.id, '/')[-1] AS anchor
FROM (SELECT id, string_split(id, '/')[1] AS root, CASE WHEN contains(id, '/') THEN regexp_replace(id, '/[^/]*$', '') END AS parent FROM pages_) q
  LEFT JOIN lists s ON s.parent = q.root LEFT JOIN lists o ON o.parent = q.id LEFT JOIN lists u ON u.parent = q.parent""",
}
