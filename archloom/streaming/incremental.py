"""Incremental forms: only what is new is worked on, and what was done before stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of ``work`` whose key no row of ``done`` has. Null keys are work still to do."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def stream_new_pages(pages: DataFrame, folder: str, checkpoint: str, *, host: str = "host"):
    """A query that adds each batch of a page stream to the table in ``folder``, by host, without the urls it holds already.

    The stream's checkpoint and the anti-join make a repeated batch harmless. Call ``processAllAvailable``
    or ``awaitTermination`` on the result.
    """

    def add(batch: DataFrame, number: int) -> None:
        del number
        fresh = batch.dropDuplicates(["url"])
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = not_done(fresh, spark.read.parquet(folder).select("url"), "url")
        fresh.write.mode("append").partitionBy(host).parquet(folder)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def host_counts(pages: DataFrame, *, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Pages per host and window of arrival (``seen``), for a stream or a table; later rows than ``late`` are left out of a stream."""
    if pages.isStreaming:
        pages = pages.withWatermark("seen", late)
    return pages.groupBy(F.window("seen", window), "host").agg(F.count("*").alias("pages"))
