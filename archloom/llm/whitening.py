"""Whitening of embeddings: MLlib's Gramian of exactly centred rows, a local eigh, broadcast whitening in mapInPandas.

Entries become whole numbers x, so sums and centred rows ``n*x - S`` are exact. The fit list (each distinct x
vector once; equal vectors combine before the shuffle) is written once; ``RowMatrix.computeGramianMatrix`` adds
outer products in the JVM and merges them by a tree. Only matrices whose size is the dimension's square reach
the driver or are broadcast.

Defined results: vectors that are null, or hold null or non-finite entries, take no part; nor do empty ones,
those whose length isn't the most frequent length of the others (ties: the longer), and those with an entry
beyond 2**31, for which sums of longs aren't exact. Rows that repeat each give their rows; a null ``vec_id``
stays null. Components without variance have no unit to whiten to and give no rows, so a table with fewer than
two distinct vectors gives none. A deviation too large for a long is null. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.sources.scratch import Scratch

COMPONENTS = 16
STEPS = 64
OFFSET = 1_000_000
LARGEST = float(1 << 31)
#: Eigenvalues below this part of the largest are rounding.
FLAT = 1e-12


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part, x without the offset, which centring takes away again."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    rows = embeddings.select("vec_id", c.alias("c")).where(F.col("c").isNotNull() & F.forall("c", lambda v: v.isNotNull() & (F.abs(v) <= LARGEST)) & (F.size("c") > 0))
    widths = rows.groupBy(F.size("c").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if widths is None:
        return rows.select("vec_id", F.array().cast("array<long>").alias("x")).where("false")
    return rows.where(F.size("c") == widths.w).select("vec_id", F.transform("c", lambda v: F.floor(v * STEPS)).alias("x"))


def _gramian(rows: DataFrame, column: str) -> np.ndarray:
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias(column)), column)
    return np.asarray(RowMatrix(vectors).computeGramianMatrix().toArray(), np.float64)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n*x - S)**2: in longs where they surely fit, else in Python's whole numbers."""
    about = ((n * x.astype(np.float64) - sums.astype(np.float64)) ** 2).sum(axis=1)
    small = about < float(1 << 61)
    d = n * x[small] - sums
    out = np.zeros(len(x), object)
    out[small] = (d * d).sum(axis=1)
    for i in np.flatnonzero(~small):
        total = sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[i], sums, strict=True))
        out[i] = total if total < 1 << 63 else None
    return out.tolist()


def _project(shared: Broadcast):
    """The task that whitens batches of (vec_id, x); ``shared``: n, sums, and the components over their deviations, a column each.

    Ids come and go as text: as numbers with nulls pandas would round large ones.
    """

    def project(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, unit = shared.value
        for frame in frames:
            if len(frame):
                x = np.stack(frame["x"].to_numpy()).astype(np.int64)
                white = ((n * x - sums) / float(n)) @ unit
                yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation": pd.Series(_deviations(x, n, sums), dtype=object), "whitened": list(white)})

    return project


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = whole_vectors(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    fit = scratch.keep(rows.select("x").distinct())
    shape = fit.agg(F.count("*"), F.max(F.size("x"))).first()
    n, width = shape[0], shape[1] or 0
    empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if n < 2:
        return spark.createDataFrame([], empty)
    sums = np.array(fit.agg(*[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).first(), np.int64)
    total = F.lit(sums.tolist())
    centred = F.zip_with("x", total, lambda x, s: (x * F.lit(n).cast("long") - s) / F.lit(float(n)))
    cov = _gramian(fit.select(centred.alias("centred")), "centred") / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = min(components, int((values > FLAT * max(values[0], 0.0)).sum()))
    if not some:
        return spark.createDataFrame([], empty)
    unit = vectors[:, :some] / np.sqrt(values[:some])
    project, kinds = _project(spark.sparkContext.broadcast((n, sums, unit))), "vec_id string, deviation long, whitened array<double>"
    # rows of the fit list sum to exactly n*S - n*S = 0 in every dimension, so what is projected is centred
    again = _gramian(fit.select(F.lit(None).cast("string").alias("vec_id"), "x").mapInPandas(project, kinds), "whitened") / n
    error = float(np.abs(again - np.eye(some)).max())
    explained = F.lit((values[:some] / np.trace(cov)).tolist())
    out = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x").mapInPandas(project, kinds).select(F.col("vec_id").cast("long").alias("vec_id"), "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return out.select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error")
    )
