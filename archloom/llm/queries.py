"""The registered queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archloom.llm import exact_dedup, line_dedup, line_quality, secret_scan, source_audit
from archloom.llm.jaccard_join import jaccard_classes
from archloom.llm.url_rules import judge_urls
from archloom.llm.line_dedup import dedup_lines
from archloom.llm.lm import lm_scores
from archloom.llm.mixing import mix_to_targets
from archloom.llm.pieces import encode_and_check
from archloom.llm.token_counts import token_counts
from archloom.llm.vantage import nearest
from archloom.llm.whitening import whiten
from archloom.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES["op1_jaccard_join"] = op1_jaccard_join


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


QUERIES["op3_line_quality"] = op3_line_quality
ORACLE_SQL["op3_line_quality"] = line_quality.SQL


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


QUERIES["op9_secret_scan"] = op9_secret_scan
ORACLE_SQL["op9_secret_scan"] = secret_scan.SQL


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES["op10_url_rules"] = op10_url_rules


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES["op4_token_counts"] = op4_token_counts


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_check(table(spark, sf_dir, "documents"))


QUERIES["op2_pieces"] = op2_pieces


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


QUERIES["op8_line_dedup"] = op8_line_dedup
ORACLE_SQL["op8_line_dedup"] = line_dedup.SQL


def op7_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES["op7_vantage"] = op7_vantage
ORACLE_SQL["op7_vantage"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
), q AS (
  SELECT * FROM v WHERE vec_id % 50 = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM q JOIN v ON q.vec_id <> v.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


QUERIES["op5_mixing"] = op5_mixing


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES["op6_lm"] = op6_lm


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


QUERIES["op11_source_audit"] = op11_source_audit
ORACLE_SQL["op11_source_audit"] = source_audit.SQL


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


QUERIES["op12_exact_dedup"] = op12_exact_dedup
ORACLE_SQL["op12_exact_dedup"] = exact_dedup.SQL


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES["op13_whitening"] = op13_whitening
