"""How far the sources of a language differ in the words they use, pair by pair and from the language as a whole.

Counts are made per task before the shuffle. The kept terms of a language are numbered; a group's counts are
packed into a row for each ``CHUNK`` of terms. Groups stand in blocks of ``BLOCK``: each row goes to the tiles
(block by block) of its group, and a tile computes its pairs' submatrix chunk after chunk. A tile covers a slab
of ``SLAB`` successive chunks, so that few groups over many terms are many tasks too; Spark adds the slabs.

A tile looks at the terms that one of its groups has. What terms without a count add is the same for each of
them, so it is added once, times all V terms of the language, and taken off for the terms looked at: exact, as
all is in whole numbers.

Defined results: null text, lang and source are empty strings. Rows that repeat count again. A language without
kept terms has pairs of value 0, one of a single source no pairs. An empty table gives no rows. Further columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archloom.operators.ranking import numbered
from archloom.sources.scratch import Scratch

LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
CHUNK = 4096
SLAB = 16
BLOCK = 16
#: Terms that a counting task holds before it passes them on.
HELD = 200_000

#: Bytes of terms, with A-Z lower-cased: ASCII letters and all of what isn't ASCII; the others part terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_ANY_BYTES = pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)


def _text(values: list[bytes | None]) -> pa.Array:
    return pc.cast(pa.array(values, pa.binary()), options=_ANY_BYTES)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, documents) of what a task reads; a row with null term says that the group occurs."""
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    fresh = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            terms = [None, *counts]
            same = [_text([x]) for x in (lang, source)]
            codes = pa.array(np.zeros(len(terms), np.int32))
            names = [pa.DictionaryArray.from_arrays(codes, x).dictionary_decode() for x in same]
            yield pa.RecordBatch.from_arrays([*names, _text(terms), pa.array([0, *counts.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, counts)], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        columns = [batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "source", "text")]
        for lang, source, text in zip(*columns, strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            terms = text.translate(_TERM_BYTES).split()
            before = len(counts)
            counts.update(terms)
            docs.update(set(terms))
            fresh += len(counts) - before
            if fresh > HELD:
                yield from passed_on()
                fresh = 0
    yield from passed_on()


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), by long division in three steps of 1,000, so that longs suffice."""
    rest, out = count + 2, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Tile:
    """Pairs between two blocks of groups of a language, over one slab of its terms."""

    def __init__(self, key: tuple, block: int) -> None:
        self.key, self.block = key, block
        self.lang, self.a, self.b, self.slab = key
        self.names: list[list[str]] = [[], []]
        self.totals: list[list[int]] = [[], []]
        self.places: list[dict[int, int]] = [{}, {}]
        self.terms = 0
        self.first = False
        self.sums: np.ndarray | None = None

    def groups(self, rows: Iterable[dict]) -> None:
        for r in rows:
            self.terms, self.first = r["v"], r["first"]
            for side, block in enumerate((self.a, self.b)):
                if r["g"] // self.block == block:
                    self.places[side][r["g"]] = len(self.names[side])
                    self.names[side].append(r["source"])
                    self.totals[side].append(r["total"] + 2 * r["v"])

    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals of both sides and what a term without a count adds to each pair."""
        t, u = (np.array(x, np.int64)[:, None] for x in self.totals)
        p, q = _share(np.zeros_like(t), t), _share(np.zeros_like(u), u)
        return t, u, _apart(p, q.T)

    def chunk(self, rows: list[dict]) -> None:
        """Adds the terms of one chunk that some group of the tile has."""
        used = np.unique(np.concatenate([np.asarray(r["at"], np.int64) for r in rows]))
        counts = [np.zeros((len(n), len(used)), np.int64) for n in self.names]
        for r in rows:
            for side in (0, 1):
                if r["g"] in self.places[side]:
                    counts[side][self.places[side][r["g"]], np.searchsorted(used, r["at"])] = r["n"]
        t, u, flat = self._flat()
        p, q = _share(counts[0], t), _share(counts[1], u)
        if self.sums is None:
            self.sums = np.zeros(flat.shape, np.int64)
        for i in range(len(p)):
            self.sums[i] += _apart(p[i], q).sum(axis=1)
        self.sums -= flat * len(used)

    def pairs(self) -> pa.RecordBatch:
        shape = (len(self.names[0]), len(self.names[1]))
        sums = np.zeros(shape, np.int64) if self.sums is None else self.sums
        if self.first and self.terms:
            sums = sums + self._flat()[2] * self.terms
        i, j = np.nonzero(np.ones(shape, bool) if self.a != self.b else np.triu(np.ones(shape, bool), 1))
        left, right = (pa.array(self.names[s], pa.string()).take(pa.array(x)) for s, x in ((0, i), (1, j)))
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(i), pa.string()), left, right, pa.array(sums[i, j])], ["lang", "source", "item", "value"])


def _tiles(batches: Iterable[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile and chunk; a tile's groups come first, as chunk -1."""
    tile: _Tile | None = None
    chunk, held = -1, []

    def close() -> None:
        if held:
            tile.groups(held) if chunk < 0 else tile.chunk(held)
            held.clear()

    for batch in batches:
        for row in batch.to_pylist():
            key = (row["lang"], row["a"], row["b"], row["slab"])
            if tile is None or key != tile.key:
                if tile is not None:
                    close()
                    yield tile.pairs()
                tile, chunk = _Tile(key, block), row["chunk"]
            elif row["chunk"] != chunk:
                close()
                chunk = row["chunk"]
            held.append(row)
    if tile is not None:
        close()
        yield tile.pairs()


def _to_tiles(rows: DataFrame, size: int) -> DataFrame:
    """Each row once for every tile that its group's block is a side of."""
    block = F.floor(F.col("g") / size)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("_other")
    return rows.select("*", block.alias("_block"), other).withColumn("a", F.least("_block", "_other")).withColumn("b", F.greatest("_block", "_other")).drop("_block", "_other", "blocks")


def _exact_share(count: Column, total: Column, terms: Column) -> Column:
    """As ``_share``, in columns."""
    wide = "decimal(20,0)"
    return (F.call_function("div", F.lit(SCALE).cast(wide) * (count + 2).cast(wide), (total + 2 * terms).cast(wide)) + 1).cast("long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` against the other sources, part ``term`` against the language."""
    scratch = Scratch(docs.sparkSession, "source-audit")
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = scratch.keep(read.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    terms = scratch.keep(numbered(kept, scratch, "lang", "term").withColumn("at", F.col("n") - 1).drop("n"))
    used = scratch.keep(counted.where("term IS NOT NULL").drop("docs").join(terms, ["lang", "term"]))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"), F.min("at").alias("_least"), F.max("at").alias("_most"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v"])
    groups = scratch.keep(numbered(groups, scratch, "lang", "source").withColumnRenamed("n", "_place"))
    starts = groups.groupBy("lang").agg(F.min("_place").alias("_start"), F.ceil(F.count("*") / block).alias("blocks"))
    groups = groups.join(starts, "lang").withColumn("g", F.col("_place") - F.col("_start"))

    slab = CHUNK * SLAB
    slabs = F.when(F.col("v") > 0, F.sequence(F.floor(F.col("_least") / slab), F.floor(F.col("_most") / slab))).otherwise(F.array(F.lit(0).cast("long")))
    nothing = [F.lit(None).cast("array<long>").alias(c) for c in ("at", "n")]
    heads = groups.select("lang", "source", "g", "blocks", "total", "v", F.posexplode(slabs).alias("_nth", "slab")).select("*", (F.col("_nth") == 0).alias("first"), F.lit(-1).cast("long").alias("chunk"), *nothing).drop("_nth")
    packed = used.groupBy("lang", "source", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.collect_list(F.struct("at", "n")).alias("_terms"))
    packed = packed.join(groups.select("lang", "source", "g", "blocks"), ["lang", "source"])
    rows = packed.select(
        "lang", F.lit(None).cast("string").alias("source"), "g", "blocks", *[F.lit(None).cast("long").alias(c) for c in ("total", "v")], F.floor(F.col("chunk") / SLAB).alias("slab"), F.lit(None).cast("boolean").alias("first"),
        "chunk", F.col("_terms.at").alias("at"), F.col("_terms.n").alias("n"),
    )
    tile = ["lang", "a", "b", "slab"]
    dealt = _to_tiles(heads.unionByName(rows), block).repartition(*tile).sortWithinPartitions(*tile, "chunk")
    half = dealt.mapInArrow(lambda batches: _tiles(batches, block), "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("_way")
    pairs = half.select("lang", "value", ways).select("lang", "_way.source", F.lit("pair").alias("part"), "_way.item", "value")

    own = used.join(totals, ["lang", "source"]).join(langs.select("lang", "v", "lang_total"), "lang")
    p, q = _exact_share(F.col("n"), F.col("total"), F.col("v")), _exact_share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    apart = F.expr("((p - q) * (p - q)) div (p + q)")
    more = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "part", "item", apart.alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), l AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), s AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
