"""Exact dedup through a sharded cuckoo-filter index of live digests.

A text's SHA-256 names its shard and, by its first eight bytes, its key. A shard has a cuckoo filter of its
live keys and, by key, the content of its live texts. A key that the filter doesn't hold is new without a
look at any content; a hit is verified against the texts that are stored under that key, letter by letter, so
neither fingerprints nor digests that agree by chance join texts. Overflows widen the filter from the stored keys.

Rows are pre-aggregated before the shuffle: equal texts of one Arrow batch are compared there and leave one
row, so a text with a third of all rows reaches its shard once a batch. The number of shards grows with the
bytes, so a shard's texts (``SHARD_BYTES``) fit a task's memory whatever the size of the table.

Defined results: a null text is an empty text, and empty texts are copies of each other. A null id is smaller
than any other; ``keep_id`` is null only where all ids of a text are. Of rows that are equal in id and text
one stays. Every input row gives one row; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.llm.cuckoo import LiveKeys
from archloom.sources.scratch import Scratch, shared_folder

#: Bytes of text and number of rows of a shard, about.
SHARD_BYTES = 32 << 20
SHARD_ROWS = 50_000

_NEW = "digest binary, top_id long, n long, text binary"
_FOUND = "kind string, shard long, digest binary, top_id long, n long, text binary, slots binary, keys binary, hits long, false_hits long, resized long"
FILTER, CONTENT, NEW, GONE = 0, 1, 2, 3


def _distinct_in_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of a batch, with its number of rows and largest id."""
    for batch in batches:
        text = batch.column("text").cast(pa.binary()).fill_null(b"").dictionary_encode()
        code = text.indices.to_numpy()
        texts = text.dictionary
        ids = batch.column("doc_id")
        rows = pa.table({"code": pa.array(code), "id": ids}).group_by("code", use_threads=False).aggregate([("id", "max"), ("id", "count", pa.compute.CountOptions(mode="all"))])
        order = rows.column("code").combine_chunks()
        texts = texts.take(order)
        digests = [hashlib.sha256(t.as_buffer()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(digests, pa.binary()), rows.column("id_max").combine_chunks().cast(pa.int64()), rows.column("id_count").combine_chunks().cast(pa.int64()), texts], ["digest", "top_id", "n", "text"]
        )


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.dtype(">u8")).astype(np.uint64)


class _Shard:
    """The live keys of one shard and, by key, what is known of its texts."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.live = LiveKeys()
        self.content: dict[int, list[list]] = {}
        self.hits = self.false_hits = 0

    def take(self, kind: int, rows: pa.RecordBatch) -> None:
        if kind == FILTER:
            self.live = LiveKeys(rows.column("slots")[0].as_py(), rows.column("keys")[0].as_py())
            return
        digests = rows.column("digest").to_pylist()
        keys = _keys(digests)
        if kind == GONE:
            self.live.delete(keys)
            return
        texts, tops, counts = (rows.column(c).to_pylist() for c in ("text", "top_id", "n"))
        if kind == CONTENT:
            for row in zip(keys.tolist(), digests, tops, counts, texts, strict=True):
                self.content.setdefault(row[0], []).append([*row[1:], False])
            return
        maybe = self.live.filter.holds(keys)
        again = np.ones(len(keys), bool)
        again[np.unique(keys, return_index=True)[1]] = False
        fresh = ~(maybe | again)
        self.live.insert(keys[fresh])
        for i in np.flatnonzero(fresh).tolist():
            self.content[int(keys[i])] = [[digests[i], tops[i], counts[i], texts[i], True]]
        for i in np.flatnonzero(~fresh).tolist():
            self._verify(keys[i : i + 1], digests[i], tops[i], counts[i], texts[i])

    def _verify(self, key: np.ndarray, digest: bytes, top: int | None, n: int, text: bytes) -> None:
        """A hit joins the stored text that is the same; without one the text is new."""
        self.hits += 1
        bucket = self.content.setdefault(int(key[0]), [])
        for stored in bucket:
            if stored[3] == text:
                stored[1] = top if stored[1] is None else stored[1] if top is None else max(stored[1], top)
                stored[2] += n
                return
        self.false_hits += 1
        self.live.insert(key, again=bool(bucket))
        bucket.append([digest, top, n, text, True])

    def found(self, whole: bool) -> pa.RecordBatch:
        """A row for each text (with its content if it is new and ``whole``), and one with the filter."""
        rows = [entry for bucket in self.content.values() for entry in bucket]
        out = [{"kind": "new" if e[4] else "old", "shard": self.number, "digest": e[0], "top_id": e[1], "n": e[2], "text": e[3] if whole and e[4] else None} for e in rows]
        state = {"slots": self.live.filter.packed(), "keys": self.live.stored().tobytes()} if whole else {}
        out.append({"kind": "filter", "shard": self.number, "hits": self.hits, "false_hits": self.false_hits, "resized": self.live.resized, **state})
        return pa.RecordBatch.from_pylist(out, _SCHEMA)


_SCHEMA = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for c, k in (x.split() for x in _FOUND.split(", "))])


def _run_shards(whole: bool):
    """The task over rows sorted by shard and kind: a shard at a time, its batches as they come."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Shard | None = None
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            if not len(shard):
                continue
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]), True])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if now is None or now.number != int(shard[lo]):
                    if now is not None:
                        yield now.found(whole)
                    now = _Shard(int(shard[lo]))
                now.take(int(kind[lo]), batch.slice(lo, hi - lo))
        if now is not None:
            yield now.found(whole)

    return run


def _shard(shards: int):
    """The shard of a digest: bits that the key and its fingerprint don't hold."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 9, 7)), 16, 10).cast("long"), F.lit(shards))


def _distinct_texts(docs: DataFrame, shards: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_distinct_in_batch, _NEW).withColumn("shard", _shard(shards)).withColumn("kind", F.lit(NEW))


def shards_for(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    return max(1, -(-(size[0] or 0) // SHARD_BYTES), -(-size[1] // SHARD_ROWS))


def _through_shards(rows: DataFrame, whole: bool) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_run_shards(whole), _FOUND)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, times): equal rows counted together before the shuffle."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest")).groupBy("doc_id", "digest").agg(F.count("*").alias("times"))


def _judged(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each document. Only texts with copies are joined; a join that one text's rows skew is split by Spark."""
    copies = groups.where("n > 1").select("digest", "top_id", "n")
    joined = rows.join(copies, "digest", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top_id"))
    judged = joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_copy")
    )
    return judged.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): of equal texts the row with the largest id stays."""
    found = _through_shards(_distinct_texts(docs, shards or shards_for(docs)), whole=False)
    return _judged(_rows(docs), found.where("kind <> 'filter'"))


class LiveIndex:
    """An index kept in a shared folder, to which batches of documents are added and from which ids are taken.

    ``filters`` has a row a shard: the filter's slots and the keys that it can be widened from. ``content`` has
    the live texts and ``rows`` the (doc_id, digest, times) of all live rows. Each change writes a new generation
    and leaves the one before as it is, so a job that dies leaves a whole index. An insertion reads the filters,
    and the content of keys that hit; texts that miss cost no read of content.
    """

    def __init__(self, spark: SparkSession, shards: int, folder: str | None = None) -> None:
        self.spark, self.shards = spark, shards
        self.scratch = Scratch(spark, "live-index") if folder is None else None
        self.folder = folder or f"{shared_folder(spark)}/live"
        self._writes = 0
        self.filters: DataFrame | None = None
        self.content: DataFrame | None = None
        self.rows: DataFrame | None = None

    def _keep(self, df: DataFrame) -> DataFrame:
        if self.scratch:
            return self.scratch.keep(df)
        self._writes += 1
        path = f"{self.folder}/{self._writes}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _as(self, kind: int, df: DataFrame | None) -> DataFrame:
        have = df.columns
        made = ((c, t) for c, t in (x.split() for x in _NEW.split(", ") + ["slots binary", "keys binary"]))
        return df.select("shard", F.lit(kind).alias("kind"), *[(F.col(c) if c in have else F.lit(None).cast(t)).alias(c) for c, t in made])

    def _hits(self, new: DataFrame) -> DataFrame:
        """The digests of ``new`` that the filters may hold."""
        both = self._as(FILTER, self.filters).unionByName(self._as(NEW, new.select("shard", "digest")))

        def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, live = None, LiveKeys()
            for batch in batches:
                shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
                cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]), True]) if len(shard) else np.zeros(1, int)
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    part = batch.slice(lo, hi - lo)
                    if kind[lo] == FILTER:
                        at, live = int(shard[lo]), LiveKeys(part.column("slots")[0].as_py())
                    elif at == int(shard[lo]):
                        digests = part.column("digest")
                        hit = live.filter.holds(_keys(digests.to_pylist()))
                        yield pa.RecordBatch.from_arrays([digests.filter(pa.array(hit))], ["digest"])

        return both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(probe, "digest binary").distinct()

    def insert(self, docs: DataFrame) -> DataFrame:
        """Adds a batch; gives (digest, known): for each text of it whether the index held it before."""
        new = self._keep(_distinct_texts(docs, self.shards))
        todo = self._as(NEW, new)
        if self.filters is not None:
            key = F.substring("digest", 1, 8)
            held = self.content.withColumn("_key", key).join(self._hits(new).select(key.alias("_key")).distinct(), "_key", "left_semi").drop("_key")
            todo = todo.unionByName(self._as(FILTER, self.filters)).unionByName(self._as(CONTENT, held.withColumn("n", F.lit(0).cast("long"))))
        found = self._keep(_through_shards(todo, whole=True))
        filters, fresh = found.where("kind = 'filter'").select("shard", "slots", "keys"), found.where("kind = 'new'").select("shard", "digest", "text")
        rows = _rows(docs)
        self.content = self._keep(fresh if self.content is None else self.content.unionByName(fresh))
        self.rows = self._keep(rows if self.rows is None else self.rows.unionByName(rows).groupBy("doc_id", "digest").agg(F.sum("times").alias("times")))
        self.filters = filters
        return found.where("kind <> 'filter' AND n > 0").select("digest", (F.col("kind") == "old").alias("known"))

    def delete(self, ids: DataFrame) -> None:
        """Takes the rows with these ids out; a text without a row left leaves the filter and the content."""
        if self.rows is None:
            return
        rows = self._keep(self.rows.join(ids.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_anti"))
        gone = self._keep(self.content.join(rows, "digest", "left_anti").select("shard", "digest"))
        todo = self._as(FILTER, self.filters).unionByName(self._as(GONE, gone))
        self.filters = self._keep(_through_shards(todo, whole=True).select("shard", "slots", "keys"))
        self.content = self._keep(self.content.join(gone.select("digest"), "digest", "left_anti"))
        self.rows = rows

    def groups(self) -> DataFrame:
        """What ``dedup`` gives, for the rows that are live."""
        sizes = self.rows.groupBy("digest").agg(F.max("doc_id").alias("top_id"), F.sum("times").alias("n"))
        return _judged(self.rows, sizes)


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
