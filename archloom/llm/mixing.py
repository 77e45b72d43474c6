"""Mixing to target weights with soft membership.

A classifier fitted on labelled documents gives each document a posterior over domains. Document rates
r >= 0 then make the expected token totals of the domains, sum over documents of r * tokens * posterior,
match targets in the least-squares sense. The fit is projected gradient descent, of which only the
totals (as many numbers as domains) leave the executors: each step is one aggregation, and a
document's rate follows from its posterior and the steps' few numbers.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archloom.llm.words import chunks, hash_words_and_prefixes, mix, text_buffers
from archloom.sources.scratch import Scratch

DOMAINS = ("good", "poor", "toxic")
#: Multiples of each domain's expected tokens: good text is repeated a little, toxic text goes.
TARGETS = {"good": 1.25, "poor": 1.0, "toxic": 0.0}
PREFIXES = (4, 5, 6)
BUCKETS = 1 << 20
#: At most so many labelled documents are used to fit the classifier, those of the least id hash,
#: and of them so many as hold this many bytes of text together; longer texts than the last bound don't train.
MAX_TRAIN, MAX_TRAIN_BYTES, MAX_TEXT_BYTES = 9_000, 32 << 20, 1 << 18


def _features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, n+1 positions of each text's first, words of each text): lower-case words and how they begin."""
    h, at = hash_words_and_prefixes(raw, offsets, PREFIXES, lower=True)
    rows = len(h)
    flat = (h.T.ravel() & np.uint64(BUCKETS - 1)).astype(np.int64)
    return flat, at * rows, np.diff(at)


def _label_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(domain, distinct buckets) of each labelled text."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(1))
        for lo, hi in chunks(offsets):
            flat, at, _ = _features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            each = [np.unique(flat[a:b]).astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(each, pa.binary())], names=["domain", "buckets"])


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the classifier of all (domain, buckets), in the bytes of its arrays; their order doesn't depend on partitions, so that sums come out alike."""
    domain, buckets = [], []
    for batch in batches:
        domain += batch.column(0).to_pylist()
        buckets += [np.frombuffer(b, np.int32) for b in batch.column(1).to_pylist()]
    order = sorted(range(len(buckets)), key=lambda i: (domain[i], len(buckets[i]), zlib.crc32(buckets[i])))
    model = fit_classifier(np.array([domain[i] for i in order], np.int64), [buckets[i] for i in order])
    yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (model.place, model.weights, model.bias)], names=["place", "weights", "bias"])


@dataclass
class Classifier:
    """Multinomial logistic regression on the presence of chosen features; ``place`` maps buckets to rows of ``weights``, 0 for none."""

    place: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        rows = self.place[flat].astype(np.int64)
        text = np.repeat(np.arange(n), np.diff(at))
        pairs = np.unique((text * len(self.weights) + rows)[rows > 0])
        text, rows = pairs // len(self.weights), pairs % len(self.weights)
        z = np.stack([np.bincount(text, self.weights[rows, k], n) for k in range(len(self.bias))], axis=1) + self.bias
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        return z / z.sum(axis=1, keepdims=True)


def fit_classifier(domain: np.ndarray, buckets: list[np.ndarray], *, least_chi2: float = 24.0, most: int = 6000, passes: int = 120, decay: float = 1e-3) -> Classifier:
    """``domain``: 0..2 for each text; ``buckets``: its distinct features. Features are those that go with a domain beyond chance."""
    k, n = len(DOMAINS), len(domain)
    counts = np.zeros((k, BUCKETS), np.int32)
    for d, b in zip(domain, buckets, strict=True):
        counts[d, b] += 1  # a text's buckets are distinct
    sizes = np.bincount(domain, minlength=k).astype(float)
    df = counts.sum(axis=0)
    chi = np.zeros(BUCKETS)
    for d in range(k):
        a, b = counts[d].astype(float), (df - counts[d]).astype(float)
        c, rest = sizes[d] - a, n - sizes[d] - b
        with np.errstate(all="ignore"):
            x = n * (a * rest - b * c) ** 2 / ((a + b) * (c + rest) * (a + c) * (b + rest))
        chi = np.maximum(chi, np.nan_to_num(x))
    chosen = np.flatnonzero((chi >= least_chi2) & (df >= 3))
    chosen = chosen[np.argsort(-chi[chosen], kind="stable")][:most]
    place = np.zeros(BUCKETS, np.int16)
    place[chosen] = np.arange(1, len(chosen) + 1)
    held = [found[found > 0] for found in (place[b] for b in buckets)]
    text = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in held])
    rows = np.concatenate([np.zeros(0, np.int16), *held])
    full, begin = np.unique(text, return_index=True)
    by_row = np.argsort(rows, kind="stable")
    used, first = np.unique(rows[by_row], return_index=True)
    text_by_row = text[by_row]
    w = np.zeros((len(chosen) + 1, k))
    bias = np.log((sizes + 1) / (n + k)) if n else np.array([0.0, -50.0, -50.0])
    bias = np.where(sizes > 0, bias, -50.0) if n else bias  # a domain without examples is not expected
    want = np.eye(k)[domain] if n else np.zeros((0, k))
    past_w, past_b, rate = np.full_like(w, 1e-8), np.full(k, 1e-8), 0.3
    for _ in range(passes if n else 0):
        z = np.tile(bias, (n, 1))
        if len(full):
            for d in range(k):
                z[full, d] += np.add.reduceat(w[:, d].copy()[rows], begin)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        err = (p - want) / n
        grad = decay / n * w
        if len(used):
            for d in range(k):
                grad[used, d] += np.add.reduceat(err[:, d].copy()[text_by_row], first)
        past_w += grad**2
        w -= rate * grad / np.sqrt(past_w)
        past_b += err.sum(axis=0) ** 2
        bias = bias - rate * np.where(sizes > 0, err.sum(axis=0), 0) / np.sqrt(past_b)
    return Classifier(place, w, bias)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, max_train: int, max_bytes: int = MAX_TRAIN_BYTES, max_text: int = MAX_TEXT_BYTES) -> Classifier:
    """The classifier of the ``max_train`` labelled documents of least id hash, as far as ``max_bytes`` of text go.

    A byte of text gives 8 bytes of features at most, so both bounds hold for the task that fits. Of
    rows with one id the text of least hash trains.
    """
    toxic, quality = F.coalesce(F.max("toxic"), F.lit(0)), F.coalesce(F.min("quality"), F.lit(1))
    domain = F.when(toxic == 1, 2).when(quality == 0, 1).otherwise(0)
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_l")).agg(domain.cast("int").alias("domain"))
    rows = docs.select(F.col(id_col).cast("long").alias("_l"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tk", F.xxhash64("text"))
    sizes = rows.select("_l", "tk", F.octet_length("text").alias("size")).where(F.col("size") <= max_text)
    first = sizes.groupBy("_l").agg(F.min(F.struct("tk", "size")).alias("x")).select("_l", "x.tk", "x.size")
    ids = first.join(said, "_l").withColumn("order", F.xxhash64("_l")).orderBy("order", "_l").limit(max_train)
    so_far = F.sum("size").over(Window.orderBy("order", "_l"))  # over max_train rows of a few numbers
    ids = F.broadcast(ids.withColumn("so_far", so_far).where(F.col("so_far") <= max_bytes).select("_l", "tk", "domain"))
    spec = T.StructType([T.StructField("domain", T.IntegerType()), T.StructField("buckets", T.BinaryType())])
    chosen = rows.join(ids, ["_l", "tk"]).dropDuplicates(["_l", "tk"])
    # the sample is bounded, so one task fits it; the driver gets the model alone, of fixed size
    features = chosen.select("domain", "text").mapInArrow(_label_rows, spec).repartition(1)
    place, weights, bias = features.mapInArrow(_fit_rows, "place binary, weights binary, bias binary").first()
    return Classifier(np.frombuffer(place, np.int16), np.frombuffer(weights).reshape(-1, len(DOMAINS)), np.frombuffer(bias))


def with_posteriors(rows: DataFrame, model: Classifier, *, within: int | None = None) -> DataFrame:
    """``rows`` with tokens long and p array<double> in the order of DOMAINS.

    The text is the column ``text``, which goes; or with ``within`` that field of the struct ``row``,
    which stays, so that a text that is kept passes Python once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size
    others = [f for f in rows.schema.fields if f.name != "text"]
    made = [T.StructField("tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]
    names = [f.name for f in others] + ["tokens", "p"]
    lead = ["text"] if within is None else []

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0) if within is None else batch.column("row").field(within))
            for lo, hi in chunks(offsets):
                flat, at, n = _features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                p = model.posteriors(flat, at)
                ends = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * len(DOMAINS))
                found = [pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[len(lead) :], *found], names=names)

    return rows.select(*lead, *[f.name for f in others]).mapInArrow(predict, T.StructType([*others, *made]))


def floor_column(p: Column, targets: dict[str, float], least: float) -> Column:
    """The least rate of a document: ``least`` where it belongs, more likely than not, to domains that are wanted whole, else 0."""
    whole = [F.get(p, i) for i, d in enumerate(DOMAINS) if targets[d] >= 1]
    return F.when(sum(whole[1:], whole[0]) >= 0.5, float(least)).otherwise(0.0) if whole and least else F.lit(0.0)


def rate_column(p: Column, steps: list[list[float]], targets: dict[str, float], least: float = 0.0) -> Column:
    """The rate of a document after the steps, from 1: less posterior times step, never below its floor, then on by the step's momentum."""
    if not steps:
        return F.lit(1.0)
    made = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")  # a constant of one literal
    dot = lambda s: sum((F.get(p, i) * F.get(s, i) for i in range(1, len(DOMAINS))), F.get(p, 0) * F.get(s, 0))
    floor = floor_column(p, targets, least)

    def step(at: Column, s: Column) -> Column:
        # the new rate is used twice, so it is bound first
        rate = F.array(F.greatest(floor, at["ahead"] - dot(s)))
        return F.element_at(F.transform(rate, lambda r: F.struct(r.alias("rate"), (r + F.get(s, len(DOMAINS)) * (r - at["rate"])).alias("ahead"))), 1)

    return F.aggregate(made, F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead")), step, lambda at: at["rate"])


def fit_rates(table: DataFrame, targets: dict[str, float], *, least: float = 0.0, most_steps: int = 60, close: float = 0.01) -> list[list[float]]:
    """The steps of the fit over ``table`` (tokens, p): for each a number for each domain, and the momentum after it.

    Minimised: the squared difference of totals and targets in the metric of the domains' Gram matrix;
    steps are scaled by 1/tokens, so that a long document is not cut more than a short one alike. In
    this metric a step of length 1 is safe; accelerated projected gradient, restarted where the
    difference grows. Each domain is measured by its own tokens, so a rare one counts as much as a
    common one: the fit ends when all totals are within ``close`` of their domain's tokens from their
    targets, or hardly move (a fiftieth of that, three times). Unsure documents are spared by their
    floor (``floor_column``, with ``least`` above 0), not by an early end.
    """
    k = len(DOMAINS)
    p = [F.get("p", i) for i in range(k)]
    first = table.agg(*[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"g{i}{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.col("tokens") * p[i]).alias(f"t{i}") for i in range(k)]).first().asDict()
    if not first["t0"]:
        return []
    gram = np.array([[first[f"g{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)])
    total = np.array([first[f"t{i}"] for i in range(k)])
    want = total * np.array([targets[d] for d in DOMAINS])
    live = total > 1e-15 * total.sum()  # a domain without examples has e^-50
    size = np.sqrt(np.where(live, np.diag(gram), 1.0))
    held = np.outer(live, live)
    inverse = np.linalg.pinv(np.where(held, gram, 0) / np.outer(size, size), rcond=1e-10, hermitian=True) / np.outer(size, size)
    off = lambda x: float((x - want) @ inverse @ (x - want))
    steps: list[list[float]] = []
    now = ahead = total
    t, quiet = 1.0, 0
    while len(steps) < most_steps and quiet < 3 and (np.abs(now - want) > close * total)[live].any():
        steps.append([*(inverse @ (ahead - want)).tolist(), 0.0])
        rate = rate_column(F.col("p"), steps, targets, least)
        row = table.select("tokens", "p", rate.alias("r")).agg(*[F.sum(F.col("tokens") * F.col("r") * p[i]) for i in range(k)]).first()
        after = np.array(list(row))
        t, before = (1.0, 1.0) if off(after) > off(now) else ((1 + (1 + 4 * t * t) ** 0.5) / 2, t)
        steps[-1][-1] = (before - 1) / t
        ahead = after + steps[-1][-1] * (after - now)
        quiet = quiet + 1 if (np.abs(after - now) <= 0.02 * close * total)[live].all() else 0
        now = after
    return steps


def copies_column(rate: Column, *of: Column) -> Column:
    """``rate`` up or down to a whole number, at random by the hash of ``of``, so that it is right on average."""
    chance = F.pmod(F.xxhash64(*of, F.lit("copies")), F.lit(1 << 24)) / (1 << 24)
    return F.floor(rate + chance).cast("long")


def mix_to_targets(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, max_train: int = MAX_TRAIN, least: float = 0.0) -> DataFrame:
    """``docs`` (all columns) with: tokens, p_good, p_poor, p_toxic, rate, copies.

    ``labels``: doc_id, quality, toxic (a document labelled more than once counts by its worst). Domains:
    toxic; else of quality 0: poor; else good. ``targets``: multiples of the domains' expected tokens.
    copies: the rate, rounded up or down by a hash of id and text so that the copies' totals are those
    of the rates on average. Rates are 0 at least. With ``least`` a document that is more likely than not of
    domains with targets of 1 or more has that rate at least, with 1 it keeps a copy however unsure it is; what such
    documents hold of a domain with a lower target then stays above it. A domain without labelled examples gets no documents;
    without any labels all are good, at the rate of that target. Null texts and texts without words
    have 0 tokens and the prior's posterior. Rows with one id are judged each by its text, and equal
    rows alike. A column of ``docs`` with the name of a result gives way to it.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    model = train(docs, labels, id_col=id_col, text_col=text_col, max_train=max_train)
    text = F.col(text_col).cast("string").alias("text")
    table = scratch.keep(with_posteriors(docs.select(text), model))
    targets = targets or TARGETS
    steps = fit_rates(table, targets, least=least)
    scratch.drop(table)
    new = ["tokens", *[f"p_{d}" for d in DOMAINS], "rate", "copies"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    plain = isinstance(docs.schema[text_col].dataType, T.StringType)
    out = with_posteriors(docs.select(row), model, within=docs.columns.index(text_col)) if plain else with_posteriors(docs.select(text, row), model)
    out = out.withColumn("rate", rate_column(F.col("p"), steps, targets, least))
    copies = copies_column(F.col("rate"), F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`"))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in new]
    return out.select(*kept, "tokens", *[F.get("p", i).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", copies.alias("copies"))
