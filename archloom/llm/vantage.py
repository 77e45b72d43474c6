"""Approximate nearest neighbours: vantage-point trees in shards, and shards that a query leaves out by the same inequality.

Vectors are scaled to length one, so that the largest cosine is the least distance and the triangle
inequality holds. Shards are the cells of a bounded set of pivots. A query searches its own cell first;
with its k-th best distance it then visits those cells only that may hold something as near. Within a
shard a vantage-point tree leaves out sides in the same way. ``factor`` relaxes both: with best distance t
a side or cell is searched only where it may hold something within t / factor. Factor 1 gives exact results.

Trees find candidates by products of blocks of vectors, whose last bits depend on the block. So all rows
within ``MARGIN`` of the k-th are kept, and the cosine of the given vectors, computed row by row, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archloom.sources.scratch import Scratch

LEAF = 64
#: Distances are computed in double precision; this much slack keeps rounding from pruning a tie.
SLACK = 1e-7
#: Cosines that differ by less may be in another order once they are computed exactly.
MARGIN = 1e-12
#: No more pivots than this are ever drawn and sent to the tasks.
MAX_PIVOTS = 2048


class VantageTree:
    """Nodes over the rows of ``x`` (unit vectors); each inner node has a vantage point, a radius and two sides."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x = x
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(x)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        if len(rows) <= leaf:
            self.nodes.append((rows,))
            return len(self.nodes) - 1
        # the vantage point: of a few rows, that with the widest spread of distances
        tries = rows[:: max(1, len(rows) // 8)][:8]
        probe = rows[:: max(1, len(rows) // 256)]
        dist = _distances(self.x[tries], self.x[probe])
        vp = tries[int(np.argmax(dist.std(axis=1)))]
        rest = rows[rows != vp]
        d = _distances(self.x[vp][None], self.x[rest])[0]
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2
        near, far = rest[order[:half]], rest[order[half:]]
        radii = (float(d[order[half - 1]]), float(d[order[half]]))
        place = len(self.nodes)
        self.nodes.append(())
        self.nodes[place] = (np.array([vp]), radii, self._build(near, leaf), self._build(far, leaf))
        return place

    def search(self, q: np.ndarray, k: int, factor: float, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows that may be among the ``k`` nearest of a query; ``start``: a cosine that the k-th reaches anyhow."""
        best = np.full((len(q), k), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(self.root, np.arange(len(q)), None)]
        while todo:
            node, who, bound = todo.pop()
            if bound is not None:
                limit = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(np.maximum(best[who, -1], start[who]), -1)))
                who = who[bound <= limit / factor + SLACK]
                if not len(who):
                    continue
            held = self.nodes[node]
            cos = q[who] @ self.x[held[0]].T
            best[who] = -np.sort(-np.concatenate([best[who], cos], axis=1), axis=1)[:, :k]
            a, b = np.nonzero(cos >= np.maximum(best[who, -1], start[who])[:, None] - MARGIN)
            found.append((who[a], held[0][b], cos[a, b]))
            if len(held) == 1:
                continue
            _, (inner, outer), near, far = held
            d = np.sqrt(np.maximum(0, 2 - 2 * (q[who] @ self.x[held[0][0]])))
            inside = d <= (inner + outer) / 2
            to_near, to_far = np.maximum(0, d - inner), np.maximum(0, outer - d)
            # last in, first out: each query's likelier side is searched first, and narrows the other
            todo.append((far, who[inside], to_far[inside]))
            todo.append((near, who[~inside], to_near[~inside]))
            todo.append((far, who[~inside], to_far[~inside]))
            todo.append((near, who[inside], to_near[inside]))
            todo = [t for t in todo if len(t[1])]
        a, b, cos = (np.concatenate(x) for x in zip(*found, strict=True))
        stay = cos >= np.maximum(best[a, -1], start[a]) - MARGIN
        return a[stay], b[stay]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors in double precision, as given and of length one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x, x / np.linalg.norm(x, axis=1)[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors have equal cosines wherever they stand."""
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


class Pivots:
    """The cells of a few unit vectors, by length of vector: ``number`` names each pivot's cell."""

    def __init__(self, vectors: list[np.ndarray]) -> None:
        self.x, self.number = {}, {}
        for dims in sorted({len(v) for v in vectors}):
            at = [i for i, v in enumerate(vectors) if len(v) == dims]
            x = np.stack([vectors[i] for i in at]).astype(np.float64)
            self.x[dims], self.number[dims] = x / np.linalg.norm(x, axis=1)[:, None], np.array(at)

    def distances(self, batch: pa.Array) -> Iterator[tuple[np.ndarray, int, np.ndarray | None]]:
        """(rows, dims, distances to that length's pivots or None) for the rows of each length."""
        sizes = pa.compute.list_value_length(batch).to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dims)
            held = self.x.get(dims)
            yield rows, dims, None if held is None else _distances(_unit(batch.take(pa.array(rows)))[1], held)


def _assign(shared):
    """Each row's cell, the nearest pivot's, and its distance; cell -dims where no pivot has that length."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                cell, away = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                for rows, dims, d in shared.value.distances(batch.column(batch.schema.get_field_index("v"))):
                    if d is None:
                        cell[rows], away[rows] = -dims, 2.0
                    else:
                        nearest = d.argmin(axis=1)
                        cell[rows], away[rows] = shared.value.number[dims][nearest], d[np.arange(len(rows)), nearest]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return assign


def _other_cells(shared, radii: dict[int, float], factor: float):
    """(query, cell) for the cells other than its own that may hold something as near as the query's k-th."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                query, own, kth = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("qk", "cell", "kth"))
                reach = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(np.nan_to_num(kth, nan=-1.0), -1))) / factor + SLACK
                reach[np.isnan(kth)] = np.inf
                out = []
                for rows, dims, d in shared.value.distances(batch.column(batch.schema.get_field_index("v"))):
                    if d is None:
                        continue
                    number = shared.value.number[dims]
                    radius = np.array([radii.get(int(c), -1.0) for c in number])
                    near = (d - radius[None, :] <= reach[rows][:, None]) & (radius >= 0)[None, :] & (number[None, :] != own[rows][:, None])
                    a, b = np.nonzero(near)
                    out.append((rows[a], number[b]))
                if out:
                    a, cells = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.record_batch([pa.array(query[a]), pa.array(cells)], names=["qk", "cell"])

    return visit


def _searcher(k: int, factor: float, block: int):
    """Over rows sorted by (shard, ask): a shard's vectors come first, then the queries that visit it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            shards, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(asks) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if shards[lo] != shard:
                    shard, held, tree = shards[lo], [], None
                if not asks[lo]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if tree is None:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    ids = rows.column(2).to_numpy()
                    raw, x = _unit(rows.column(4).combine_chunks())
                    tree = VantageTree(x)
                for at in range(0, hi - lo, block):
                    some = part.slice(at, block)
                    q_raw, q = _unit(some.column(4))
                    kth = np.nan_to_num(some.column(3).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                    a, r = tree.search(q, k, factor, kth)
                    score = cosines(q_raw[a], raw[r])
                    order = np.lexsort((ids[r], -score, a))
                    a, r, score = a[order], r[order], score[order]
                    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
                    top = rank < k
                    yield pa.record_batch([pa.array(some.column(2).to_numpy()[a[top]]), pa.array(ids[r[top]]), pa.array(score[top])], names=["qk", "id", "score"])

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("qk").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, shard_rows: int = 4096, factor: float = 1.0, block: int = 256, most_rows: int = 65536) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row whose id is divisible by ``every``.

    Every row is indexed: in the cell of its nearest pivot, of which there is one for each ``shard_rows``
    rows, ``MAX_PIVOTS`` at most (those of least id hash); a cell of more than ``most_rows`` rows is cut in
    shards by hash. Of equal vectors only the k + 1 of least id can be among the nearest of any, and equal
    queries are searched once, so a very common vector is no hot shard. score: the cosine of the given
    vectors in double precision; ties go to the smaller id. Vectors that are null, zero, empty or hold
    null or non-finite components take no part, nor do rows without an id; vectors meet those of their
    own length only. Of rows with one id the smallest vector counts. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "vantage")
    v = F.col("v")
    as_given = vectors.schema[vector_col].dataType.simpleString() in ("array<float>", "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(vector_col) if as_given else F.col(vector_col).cast("array<double>")).alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    rows = scratch.keep(rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("vk", F.xxhash64("v")))
    pivots = max(1, min(MAX_PIVOTS, -(-rows.count() // shard_rows)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()  # MAX_PIVOTS vectors at most
    shared = vectors.sparkSession.sparkContext.broadcast(Pivots([np.array(r.v) for r in drawn]))
    vector = rows.schema["v"].dataType.simpleString()

    # of equal vectors the k + 1 of least id
    copy = F.row_number().over(Window.partitionBy("vk", "v").orderBy("id"))
    some = rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")
    index = scratch.keep(some.mapInArrow(_assign(shared), f"id long, v {vector}, vk long, cell long, away double"))
    cells = index.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    cells = scratch.keep(cells.withColumn("parts", F.ceil(F.col("n") / most_rows)))  # a row for each pivot or length
    shard = F.xxhash64("cell", F.pmod(F.xxhash64("id"), "parts"))
    held = index.join(cells.select("cell", "parts"), "cell").select(shard.alias("shard"), F.lit(0).alias("ask"), "id", F.lit(None).cast("double").alias("kth"), "v")

    asked = rows.where(F.col("id") % every == 0)
    once = asked.groupBy("vk", "v").agg(F.min("id").alias("qk"))
    queries = scratch.keep(once.select(F.col("qk").alias("id"), "v", "vk").mapInArrow(_assign(shared), f"id long, v {vector}, vk long, cell long, away double").withColumnRenamed("id", "qk"))

    def search(visits: DataFrame) -> DataFrame:
        """``visits``: qk, cell, kth, v."""
        each = visits.join(cells.select("cell", "parts"), "cell").select("cell", "qk", "kth", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        asks = each.select(F.xxhash64("cell", "part").alias("shard"), F.lit(1).alias("ask"), F.col("qk").alias("id"), "kth", "v")
        dealt = held.unionByName(asks).repartition("shard").sortWithinPartitions("shard", "ask", "id")
        return dealt.mapInArrow(_searcher(k + 1, factor, block), "qk long, id long, score double")

    first = scratch.keep(_best(search(queries.withColumn("kth", F.lit(None).cast("double"))), k + 1).select("qk", "id", "score", "place"))
    kth = first.where(F.col("place") == k + 1).select("qk", F.col("score").alias("kth"))
    radii = {r.cell: r.radius for r in cells.where("cell >= 0").select("cell", "radius").collect()}  # as many as pivots
    known = queries.join(kth, "qk", "left")
    visits = known.mapInArrow(_other_cells(shared, radii, factor), "qk long, cell long")
    second = search(visits.join(known.drop("cell", "away", "vk"), "qk"))
    both = _best(first.select("qk", "id", "score").unionByName(second), k + 1)
    # every query's own row goes, and the next moves up
    out = asked.select(F.col("id").alias("query_id"), "vk", "v").join(queries.select("qk", "vk", "v"), ["vk", "v"]).select("query_id", "qk")
    out = out.join(both.select("qk", F.col("id").alias("vec_id"), "score"), "qk").where("query_id <> vec_id")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
