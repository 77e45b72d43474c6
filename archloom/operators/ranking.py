"""Places in an order over a whole table, without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archloom.sources.scratch import Scratch


def numbered(rows: DataFrame, scratch: Scratch, *order: str) -> DataFrame:
    """``rows`` with ``n``, their place from 1 in the order of the columns ``order``, which should hold a key.

    The rows are dealt by ranges of the order and written; each range counts from where those before it
    end, so the side that is broadcast has a row a partition. Nulls come first.
    """
    dealt = scratch.keep(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    earlier = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(before), "_part").withColumn("n", F.col("_before") + inside).drop("_part", "_before")
