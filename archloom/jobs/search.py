"""Full-text search as a batch job: postings, BM25 for a set of queries, re-rank, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archloom.sources.tables import table

K1, B = 1.2, 0.75
HITS = 120
QUERIES_ASKED = (("q1", "the of"), ("q2", "que de la"), ("q3", "der die und"), ("q4", "attion"))


def tokens(text: str) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One searchable corpus of documents and benchmark items (S3): id, title, section, body."""
    title = F.substring_index("text", ".", 1)
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("id"), title.alias("title"), F.col("lang").alias("section"), F.col("text").alias("body"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("plays/"), F.col("item_id").cast("string")).alias("id"), title.alias("title"), F.lit("works").alias("section"), F.col("text").alias("body"))
    return docs.unionByName(items)


def asked(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{q}', '{t}')" for q, t in QUERIES_ASKED)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(query, words)")


def postings(pages: DataFrame) -> DataFrame:
    """The inverted index (term, id, tf, size). Size rides along, so that ranking needs no further join."""
    t = pages.select("id", tokens("body").alias("t")).withColumn("size", F.size("t"))
    return t.select("id", "size", F.explode("t").alias("term")).groupBy("term", "id", "size").agg(F.count("*").alias("tf"))


def bm25(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, score) of all matching documents. The query terms are few and are met before anything is shuffled."""
    terms = queries.select("query", F.explode(F.array_distinct(tokens("words"))).alias("term"))
    t = pages.select("id", tokens("body").alias("t")).select("id", F.size("t").alias("size"), "t")
    totals = t.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
    hits = t.select("id", "size", F.explode("t").alias("term")).join(F.broadcast(terms.select("term").distinct()), "term")  # as many rows as the queries have words
    tf = hits.groupBy("term", "id", "size").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = df.crossJoin(F.broadcast(totals)).select("term", idf.alias("idf"), "mean").join(terms, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return tf.join(F.broadcast(weighed), "term").groupBy("query", "id").agg(F.round(F.sum(part), 6).alias("score"))


def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and occurrences of every term."""
    return postings(corpus(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 120 documents of each query by relevance."""
    ranked = bm25(corpus(spark, sf_dir), asked(spark))
    place = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return ranked.withColumn("place", F.row_number().over(place)).where(F.col("place") <= HITS).select("query", "id", "score", F.col("place").cast("long").alias("place"))


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as shown: equal titles of a section once (K11), re-ranked by title and kind (T3), works that are named on top (T4)."""
    pages = corpus(spark, sf_dir)
    hits = search_scores(spark, sf_dir).join(pages.select("id", "title", "section"), "id").join(asked(spark), "query")
    same = Window.partitionBy("query", "section", "title").orderBy("place")
    hits = hits.withColumn("n", F.row_number().over(same)).where("n = 1")
    title = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    named = F.when(title == F.col("words"), 3).when(title.startswith(F.col("words")), 2).when(title.contains(F.col("words")), 1).otherwise(0)
    work = F.col("id").startswith("plays/")
    rank = named * 2 + work.cast("int")
    shown = Window.partitionBy("query").orderBy(F.desc("rank"), "place")
    out = hits.withColumn("rank", rank).withColumn("shown", F.row_number().over(shown))
    return out.select("query", "id", F.col("rank").cast("long").alias("rank"), F.col("shown").cast("long").alias("shown"), (work & (F.col("rank") >= 3)).alias("showcase"))


def search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches per section of each query, whatever section is chosen; none where fewer than two have any (K8, T5)."""
    found = bm25(corpus(spark, sf_dir), asked(spark)).join(corpus(spark, sf_dir).select("id", "section"), "id")
    counts = found.groupBy("query", "section").agg(F.count("*").alias("n"))
    return counts.withColumn("sections", F.count("*").over(Window.partitionBy("query"))).where("sections > 1").select("query", "section", "n")


_CORPUS = """corpus AS (
  SELECT 'doc/' || doc_id AS id, string_split(text, '.')[1] AS title, lang AS section, text AS body FROM documents
  UNION ALL SELECT 'plays/' || item_id, string_split(text, '.')[1], 'works', text FROM benchmark
), tok AS (SELECT id, regexp_extract_all(lower(body), '[a-z0-9]+') AS t FROM corpus)"""
_ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{t}')" for q, t in QUERIES_ASKED) + ") v(query, words))"
_BM25 = f"""{_CORPUS}, {_ASKED}, terms AS (SELECT DISTINCT query, unnest(string_split(words, ' ')) AS term FROM asked),
tf AS (SELECT term, id, size, count(*) AS tf FROM (SELECT id, len(t) AS size, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), totals AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM tok),
scores AS (
  SELECT query, id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * size / mean))), 6) AS score
  FROM tf JOIN df USING (term) JOIN terms USING (term), totals GROUP BY query, id
), placed AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM scores)"""
QUERIES = {f.__name__: f for f in (postings_stats, search_scores, search_page, search_facets)}
ORACLE_SQL = {
    "postings_stats": f"WITH {_CORPUS} SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY term",
    "search_scores": f"WITH {_BM25} SELECT * FROM placed WHERE place <= {HITS}",
    "search_page": f"""WITH {_BM25}, h AS (
  SELECT query, id, place, words, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY query, section, title ORDER BY place) AS n
  FROM placed JOIN corpus USING (id) JOIN asked USING (query) WHERE place <= {HITS}
), r AS (SELECT query, id, place, (CASE WHEN t = words THEN 3 WHEN starts_with(t, words) THEN 2 WHEN contains(t, words) THEN 1 ELSE 0 END * 2 + (id LIKE 'plays/%')::INT)::BIGINT AS rank FROM h WHERE n = 1)
SELECT query, id, rank, row_number() OVER (PARTITION BY query ORDER BY rank DESC, place) AS shown, id LIKE 'plays/%' AND rank >= 3 AS showcase FROM r""",
    "search_facets": f"WITH {_BM25}, c AS (SELECT query, section, count(*) AS n FROM scores JOIN corpus USING (id) GROUP BY ALL) SELECT query, section, n FROM (SELECT *, count(*) OVER (PARTITION BY query) AS k FROM c) WHERE k > 1",
}
