"""Published trees: one file for each key, written and read by tasks; a table of the files is the tree's listing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are read before they are passed on.
BATCH = 4 << 20


def folder_name(key: Column) -> Column:
    """A key as the name of a file: as it is, but where file systems would refuse its length, its start and its hash."""
    fits = F.octet_length(F.url_encode(key)) <= 200
    return F.when(fits, key).otherwise(F.concat(F.substring(key, 1, 16), F.lit("~"), F.sha2(key, 256)))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))


def write_tree(rows: DataFrame, folder: str, *, key: str = "id", text: str = "text") -> None:
    """The texts of ``rows``, each in a file of its key below ``folder``/files; null texts are empty files.

    Each attempt of a task has its own folder there, and Spark commits the listing (``folder``/listing), which names the
    files that count: neither the driver nor a commit touches single files. ``folder`` is on a file system that pyarrow
    opens (local or mounted, HDFS, S3, GCS). Keys must be unique and not null. Written anew, a tree replaces what was there.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        mine = f"files/{uuid.uuid4().hex}"
        store.create_dir(f"{root}/{mine}", recursive=True)
        for batch in batches:
            ids, names, texts = (c.to_pylist() for c in batch.columns)
            paths = [f"{mine}/{name}.txt" for name in names]
            for path, value in zip(paths, texts, strict=True):
                with store.open_output_stream(f"{root}/{path}") as out:
                    out.write(value)
            yield pa.RecordBatch.from_pydict({"id": ids, "path": paths})

    jvm = rows.sparkSession._jvm
    old = jvm.org.apache.hadoop.fs.Path(folder)
    old.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(old, True)
    name = folder_name(F.col(key))
    named = rows.select(name.alias("id"), F.url_encode(name).alias("name"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("value"))
    named.repartition("id").mapInArrow(put, "id string, path string").write.parquet(f"{folder.rstrip('/')}/listing")


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(id, value): the files of a tree as they were given to ``write_tree``, whole."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            ids, values, size = [], [], 0
            for name, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{root}/{path}") as file:
                    value = file.read()
                ids.append(name)
                values.append(value)
                size += len(value)
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(values, pa.binary())], ["id", "value"])
                    ids, values, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(values, pa.binary())], ["id", "value"])

    listing = spark.read.schema("id string, path string").parquet(f"{folder.rstrip('/')}/listing")
    return listing.mapInArrow(get, "id string, value binary").select("id", F.col("value").cast("string").alias("value"))
