"""From documents to encoded training text, in stages that each read what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each stage's rows and reads them again, so that a lost executor costs
one stage at most.

Every stage takes nulls in any column, empty and very long texts, rows that repeat and empty tables, and
ignores further columns. Texts that are null, empty or of fewer than 20 words are rejected by the first
stage. Rows with equal id and text are one document: the Jaccard stage leaves one of them. Rows without
an id are judged like others, but are nobody's near copies. Without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.llm.columns import has_word
from archloom.llm.jaccard_join import keep_first
from archloom.llm.line_dedup import dedup_lines
from archloom.llm.line_quality import judge
from archloom.llm.mixing import mix_to_targets
from archloom.llm.pieces import encode_and_check
from archloom.sources.scratch import Scratch
from archloom.sources.tables import table

#: Multiples of the expected tokens of each domain; what toxic documents hold of the others is made up for.
TARGETS = {"good": 1.0, "poor": 1.0, "toxic": 0.0}
#: A document that is more likely clean than not keeps a copy, however unsure it is.
LEAST = 1.0
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents`` from an operator's (doc_id, clean_text, row)."""
    return df.select("doc_id", F.col("clean_text").alias("text"), "row.lang", "row.source", F.char_length("clean_text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that are too frequent at their source."""
    return _documents(judge(docs, with_text=True, carry=("lang", "source")).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, and with them the documents that hold nothing else."""
    return _documents(dedup_lines(docs, carry=("lang", "source")).where(has_word(F.col("clean_text"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id."""
    return keep_first(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix gives it copies: those that are most likely toxic go, a few stand twice."""
    mixed = mix_to_targets(docs, table(spark, sf_dir, "labels"), targets=TARGETS, least=LEAST).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text, its best segmentations' scores, and whether decoding gives the text back."""
    return encode_and_check(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_duplicates),
    ("mixing", mixing),
    ("pieces", encoding),
]

#: SQL expresses neither the signatures' candidates nor the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
