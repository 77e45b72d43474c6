"""LM scoring: a log-bilinear model over learned word classes, trained by noise-contrastive estimation, beside a unigram base.

Every word belongs to a class: the most frequent words to one of their own, all others to one of the
clusters of words that stand among the same neighbours. Words too rare for a place in the lexicon are
clustered by how they begin. P(word) = P(class | two words before) P(word | class); the second factor
is the word's own share of its class, so each word of the corpus has a class and a parameter of its
own. The score of class w after classes u (last) and v is (R[u] C1 + R[v] C2) . R[w] + b[w]. As that
splits into a part of (u, w) and one of (v, w), the sums over w for all contexts at once are one matrix
product, and every probability is exactly normalised.

The texts are read twice: for the counts of all words (summed by Spark), and to write them as numbers.
Neighbour sums (whole numbers, so their order doesn't matter), training and scoring read those. For
training, rows are dealt to shards by hash, in the order of a hash; each shard learns from the common
model, and the results are averaged by their tokens, in rounds. So scores don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archloom.llm.words import chunks, hash_words_and_prefixes, text_buffers
from archloom.sources.scratch import Scratch

#: The end of a text among the word hashes, and its class.
END_WORD, END = 0x454E44, 0
SEED = 11
#: Words outside the lexicon go by their first bytes, in so many buckets.
FORM_BYTES, FORMS = 3, 4096
#: Neighbour sums: so many numbers for words within ``NEAR`` places, and for the word before and after.
ROUND, BESIDE, NEAR = 16, 8, 4
WIDE = ROUND + 2 * BESIDE


@dataclass
class Lexicon:
    """The most frequent words by hash, sorted, and their counts. A word's number is its place here, or comes after them all by its form."""

    words: np.ndarray
    counts: np.ndarray

    def numbers(self, h: np.ndarray, form: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, len(self.words) + form).astype(np.int32)

    @property
    def end(self) -> int:
        return int(np.searchsorted(self.words, END_WORD))


@dataclass
class Classes:
    """The class of each word number; the shares of classes in the corpus, and what a word's count plus one is divided by within its class."""

    of: np.ndarray
    counts: np.ndarray
    norm: np.ndarray


@dataclass
class Model:
    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    b: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.c1, self.c2, self.b)])

    @classmethod
    def from_flat(cls, x: np.ndarray, size: int, width: int) -> Model:
        a, m = size * width, width * width
        return cls(x[:a].reshape(size, width).copy(), x[a : a + m].reshape(width, width).copy(), x[a + m : a + 2 * m].reshape(width, width).copy(), x[a + 2 * m :].copy())

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(near, far, norm): natural-log scores near[u, w] + far[v, w], and the log of their sum over w, norm[u, v]."""
        r = self.r.astype(np.float64)
        near = (r @ self.c1) @ r.T + self.b
        far = (r @ self.c2) @ r.T
        high_near, high_far = near.max(axis=1, keepdims=True), far.max(axis=1, keepdims=True)
        norm = np.log(np.exp(near - high_near) @ np.exp(far - high_far).T) + high_near + high_far.T
        return near.astype(np.float32), far.astype(np.float32), norm.astype(np.float32)


def start_model(class_counts: np.ndarray, width: int) -> Model:
    """The unigram distribution, with small random word vectors."""
    rng = np.random.default_rng(SEED)
    n = len(class_counts)
    r = rng.normal(0, 0.3, (n, width)).astype(np.float32)
    share = (class_counts + 0.5) / (class_counts.sum() + 0.5 * n)
    eye = np.eye(width, dtype=np.float32)
    return Model(r, 0.1 * eye, 0.1 * eye, np.log(share).astype(np.float32))


def _scatter(target: np.ndarray, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    used, first = np.unique(rows[order], return_index=True)
    return used, np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive steps with Adagrad; the noise words of a batch are common to its contexts."""

    def __init__(self, model: Model, past: Model, noise: np.ndarray, seed: int, count: int = 48, rate: float = 0.15) -> None:
        self.m, self.past, self.count, self.rate = model, past, count, rate
        self.log_noise = np.log(count * noise).astype(np.float32)
        self.cum = np.cumsum(noise)
        self.rng = np.random.default_rng(seed)

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        m, n = self.m, len(w)
        ru, rv, rw = m.r[u], m.r[v], m.r[w]
        q = ru @ m.c1 + rv @ m.c2
        other = np.minimum(np.searchsorted(self.cum, self.rng.random(self.count) * self.cum[-1]), len(self.cum) - 1)
        ro = m.r[other]
        good = np.einsum("ij,ij->i", q, rw) + m.b[w] - self.log_noise[w]
        bad = q @ ro.T + m.b[other] - self.log_noise[other]
        eg = (1 / (1 + np.exp(-np.clip(good, -30, 30))) - 1).astype(np.float32)
        eb = (1 / (1 + np.exp(-np.clip(bad, -30, 30)))).astype(np.float32)
        dq = eg[:, None] * rw + eb @ ro
        rows = np.concatenate([w, other, u, v])
        values = np.concatenate([eg[:, None] * q, eb.T @ q, dq @ m.c1.T, dq @ m.c2.T])
        scale = np.float32(1 / n)
        used, g = _scatter(m.r, rows, values)
        self._move("r", used, g * scale)
        self._move("c1", slice(None), ru.T @ dq * scale)
        self._move("c2", slice(None), rv.T @ dq * scale)
        used, g = _scatter(m.b, np.concatenate([w, other]), np.concatenate([eg, eb.sum(axis=0)]))
        self._move("b", used, g * scale)

    def _move(self, name: str, rows, g: np.ndarray) -> None:
        past, x = getattr(self.past, name), getattr(self.m, name)
        past[rows] += g * g
        x[rows] -= self.rate * g / np.sqrt(past[rows])


def _tokens(h: np.ndarray, form: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and forms with an end after each text, and the n+1 positions of the texts."""
    ends = at + np.arange(len(at))
    place = np.ones(len(h) + len(at) - 1, bool)
    place[ends[1:] - 1] = False
    words, forms = np.full(len(place), END_WORD, np.int64), np.zeros(len(place), np.int64)
    words[place], forms[place] = h.view(np.int64), form
    return words, forms, ends


def _contexts(classes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two tokens back; the end's class stands before a text's first token."""
    u = np.concatenate([[END], classes[:-1]])
    v = np.concatenate([[END, END], classes[:-2]])[: len(classes)]
    first = ends[:-1]
    u[first] = END
    v[first] = END
    second = first + 1
    second = second[second < ends[1:]]
    v[second] = END
    return u, v


def _read(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(lo, hi, word hashes, forms, positions) of ranges of texts."""
    raw, offsets = text_buffers(column)
    for lo, hi in chunks(offsets):
        h, at = hash_words_and_prefixes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], (FORM_BYTES,), lower=True)
        yield lo, hi, *_tokens(h[0], (h[1] % np.uint64(FORMS)).astype(np.int64), at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, form, n) of the texts, in parts."""
    parts, rows = [], 0

    def merged() -> pa.RecordBatch:
        words, first, place = np.unique(np.concatenate([x[0] for x in parts]), return_index=True, return_inverse=True)
        n = np.bincount(place, np.concatenate([x[2] for x in parts])).astype(np.int64)
        return pa.record_batch([pa.array(words), pa.array(np.concatenate([x[1] for x in parts])[first]), pa.array(n)], names=["word", "form", "n"])

    for batch in batches:
        for _, _, words, forms, _ in _read(batch.column(0)):
            each, first, n = np.unique(words, return_index=True, return_counts=True)
            parts.append((each, forms[first], n))
            rows += len(each)
            if rows > 1_500_000:
                yield merged()
                parts, rows = [], 0
    if parts:
        yield merged()


def _number(shared):
    """Rows (text, ...) with the text as word numbers (4 bytes each) and the hashes of the words outside the lexicon."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        for batch in batches:
            for lo, hi, words, forms, ends in _read(batch.column(0)):
                n = lexicon.numbers(words, forms)
                tail = n >= len(lexicon.words)
                tails = np.concatenate([[0], np.cumsum(np.add.reduceat(tail.astype(np.int64), ends[:-1]))]).astype(np.int32)
                raw = n.tobytes()
                texts = [raw[4 * x : 4 * y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[1:], pa.array(texts, pa.binary()), pa.ListArray.from_arrays(pa.array(tails), pa.array(words[tail]))], names=[*batch.schema.names[1:], "tokens", "tail"])

    return number


def _numbers(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, word numbers, positions) of ranges of a column of ``_number``."""
    size = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    for lo, hi in chunks(offsets, 1 << 21):
        raw = b"".join(column.slice(lo, hi - lo).to_pylist())
        yield lo, hi, np.frombuffer(raw, np.int32), (offsets[lo : hi + 1] - offsets[lo]) // 4


def _signs(n: int) -> np.ndarray:
    """Fixed vectors of -1, 0 and 1 for all word numbers, in the parts of ``WIDE``."""
    return np.random.default_rng(SEED + 1).integers(-1, 2, (n, WIDE), dtype=np.int8)


def _neighbours(size: int, end: int, blocks: int):
    """Sums of the fixed vectors of each word's neighbours, in blocks of word numbers. The end of a text is no neighbour."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = _signs(size)
        signs[end] = 0
        total = np.zeros((size, WIDE), np.int64)
        for batch in batches:
            for _, _, n, ends in _numbers(batch.column(0)):
                for a in range(0, len(n), 1 << 17):
                    lo, hi = max(0, a - NEAR), min(len(n), a + (1 << 17) + NEAR)
                    i = np.arange(a, min(a + (1 << 17), len(n)))
                    text = np.searchsorted(ends, i, "right")
                    first, past = np.maximum(ends[text - 1], i - NEAR), np.minimum(ends[text], i + NEAR + 1)
                    g = signs[n[lo:hi]].astype(np.int32)
                    cum = np.concatenate([np.zeros((1, ROUND), np.int32), np.cumsum(g[:, :ROUND], axis=0, dtype=np.int32)])
                    got = np.zeros((len(i), WIDE), np.int32)
                    got[:, :ROUND] = cum[past - lo] - cum[first - lo] - g[i - lo, :ROUND]
                    has = i > ends[text - 1]
                    got[has, ROUND : ROUND + BESIDE] = g[i[has] - 1 - lo, ROUND : ROUND + BESIDE]
                    has = i + 1 < ends[text]
                    got[has, ROUND + BESIDE :] = g[i[has] + 1 - lo, ROUND + BESIDE :]
                    used, s = _scatter(total, n[i], got)
                    total[used] += s
        for k, part in enumerate(np.array_split(np.arange(size), blocks)):
            rows = part[total[part].any(axis=1)]
            if len(rows):
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([rows.astype(np.int32).tobytes()], pa.binary()), pa.array([total[rows].astype(np.int32).tobytes()], pa.binary())], names=["block", "rows", "sums"])

    return sums


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's sums over all tasks; a task may hold several blocks."""
    held: dict[int, dict] = {}
    for batch in batches:
        for block, rows, sums in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            rows, sums = np.frombuffer(rows, np.int32), np.frombuffer(sums, np.int32).reshape(-1, WIDE).astype(np.int64)
            had = held.get(block)
            if had is not None:
                rows, sums = np.concatenate([had[0], rows]), np.concatenate([had[1], sums])
                used, sums = _scatter(sums, rows, sums)
                rows = used
            held[block] = (rows, sums)
    for block in sorted(held):
        rows, sums = held[block]
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([rows.astype(np.int32).tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], names=["block", "rows", "sums"])


def cluster(x: np.ndarray, weight: np.ndarray, k: int, most: int = 16384, rounds: int = 10) -> np.ndarray:
    """The cluster of each row by spherical k-means, fitted on the ``most`` rows of the greatest weight."""
    mean = (x * weight[:, None]).sum(axis=0) / max(weight.sum(), 1)
    x = x - mean
    x = (x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]).astype(np.float32)
    order = np.argsort(-weight, kind="stable")
    some = x[order[:most]]
    rng = np.random.default_rng(SEED + 2)
    centres = some[np.sort(rng.choice(len(some), min(k, len(some)), replace=False))].copy()

    def nearest(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[(rows[lo : lo + 8192] @ centres.T).argmax(axis=1) for lo in range(0, len(rows), 8192)]])

    for _ in range(rounds):
        own = nearest(some)
        used, sums = _scatter(some, own, some)
        centres[used] = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
    return nearest(x)


def make_classes(lexicon: Lexicon, sums: np.ndarray, form_counts: np.ndarray, form_words: np.ndarray, classes: int, clusters: int) -> Classes:
    """``sums``: neighbour sums of all word numbers; ``form_counts`` and ``form_words``: tokens and words outside the lexicon by form."""
    n = len(lexicon.words)
    of = np.zeros(n + FORMS, np.int64)
    by_count = np.lexsort((lexicon.words, -lexicon.counts))
    named = by_count[by_count != lexicon.end][: max(0, classes - 1 - clusters)]
    of[named] = np.arange(1, len(named) + 1)
    own = np.zeros(len(of), bool)
    own[named] = own[lexicon.end] = True
    rest = np.flatnonzero(~own)
    counts = np.concatenate([lexicon.counts, form_counts])
    # means, so that a word's frequency doesn't matter
    mean = sums[rest] / np.maximum(counts[rest], 1)[:, None]
    of[rest] = 1 + len(named) + cluster(mean, counts[rest].astype(float), clusters)
    of[lexicon.end] = END
    size = 1 + len(named) + clusters
    words = np.bincount(of[:n], minlength=size) + np.bincount(of[n:], form_words, minlength=size)
    unknown = np.bincount(of[n:], minlength=size) > 0  # one place more for the words never seen
    total = np.bincount(of, counts, minlength=size)
    return Classes(of, total, np.where(np.arange(size) <= len(named), np.maximum(total + 1, 1), total + words + unknown))


def _learn(shared, flat_shared, width: int, batch_tokens: int, blocks: int, round_: int):
    """Over rows sorted by shard: each shard's model, learned from the common one."""

    def model_of(trainer: Trainer, shard: int, seen: int) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate([trainer.m.flat(), trainer.past.flat()]).astype(np.float32)
        for k, part in enumerate(np.array_split(flat, blocks)):
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([shard], pa.int64()), pa.array([seen], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["block", "shard", "tokens", "values"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: Classes = shared.value
        size = len(classes.counts)
        noise = (classes.counts + 0.5) / (classes.counts + 0.5).sum()
        trainer, shard, seen = None, None, 0
        for batch in batches:
            shards = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if shards[a] != shard:
                    if trainer is not None:
                        yield from model_of(trainer, shard, seen)
                    half = len(flat_shared.value) // 2
                    parts = [Model.from_flat(x, size, width) for x in (flat_shared.value[:half], flat_shared.value[half:])]
                    shard, seen = int(shards[a]), 0
                    trainer = Trainer(*parts, noise, SEED + 7919 * round_ + shard)
                for _, _, n, ends in _numbers(batch.column(1).slice(a, b - a)):
                    w = classes.of[n]
                    u, v = _contexts(w, ends)
                    order = trainer.rng.permutation(len(w))
                    for lo in range(0, len(w), batch_tokens):
                        i = order[lo : lo + batch_tokens]
                        trainer.step(u[i], v[i], w[i])
                    seen += len(w)
        if trainer is not None:
            yield from model_of(trainer, shard, seen)

    return learn


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token-weighted mean of each block's values, over rows sorted by block and shard."""
    sums: dict[int, tuple[float, np.ndarray]] = {}
    for batch in batches:
        for block, _, tokens, values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            had = sums.get(block, (0.0, 0.0))
            sums[block] = (had[0] + tokens, had[1] + tokens * np.frombuffer(values, np.float32).astype(np.float64))
    if sums:
        keys = sorted(sums)
        yield pa.record_batch([pa.array(keys, pa.int32()), pa.array([(sums[k][1] / sums[k][0]).astype(np.float32).tobytes() for k in keys], pa.binary())], names=["block", "values"])


_TABLES: dict[int, tuple] = {}


def _scorer(lexicon_shared, shared, model_shared, width: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, classes = lexicon_shared.value, shared.value
        key, flat = model_shared.value
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = Model.from_flat(flat, len(classes.counts), width).tables()
        near, far, norm = _TABLES[key]
        known = np.concatenate([lexicon.counts, np.zeros(FORMS, np.int64)])
        logs = np.log10(known + 1.0)
        share = np.log10(classes.norm)
        for batch in batches:
            for lo, hi, n, ends in _numbers(batch.column(0)):
                w = classes.of[n]
                u, v = _contexts(w, ends)
                model = near[u, w].astype(np.float64) + far[v, w] - norm[u, v]
                add = lambda x: np.add.reduceat(x.astype(np.float64), ends[:-1])
                made = [np.diff(ends), add(known[n] > 0).astype(np.int64), add(logs[n]), add(model) / np.log(10) - add(share[w])]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[1:], *map(pa.array, made)], names=[*batch.schema.names[1:], "n_tokens", "known", "logs", "model"])

    return score


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classes: int = 2048, clusters: int = 640, width: int = 16, frequent: int = 1 << 17, rounds: int = 2, shard_tokens: int = 2_000_000, batch_tokens: int = 2048, blocks: int = 64) -> DataFrame:
    """One row for each row of ``docs``: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Texts (null: empty) with A-Z lowered; tokens are the words and one end. Rows of which the crc32 of
    the id as text has remainder 2 modulo 7 are held out, the others train; an absent id counts as an
    empty text. base_score: unigram with one added to each count and one word more for the unknown;
    score: the log10 probability by the log-bilinear model: of the word's class, times the word's count
    plus one within its class (words never seen share one place in each class they may belong to).
    ``classes`` bounds the model's matrices: the most frequent words have classes of their own,
    ``clusters`` are learned for all the others. Only the ``frequent`` most frequent words' counts are
    sent to all tasks; the others' are joined. Equal rows get equal scores. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    sc = spark.sparkContext
    held = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7) == 2
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held.alias("held_out"), F.col(id_col).alias("doc_id"))
    vocabulary = rows.where("not held_out").select("text").mapInArrow(_count, "word long, form long, n long")
    vocabulary = scratch.keep(vocabulary.groupBy("word").agg(F.sum("n").alias("n"), F.min("form").alias("form")))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = vocabulary.where(F.col("word") != END_WORD).orderBy(F.desc("n"), "word").limit(frequent - 1)
    top = top.unionByName(vocabulary.where(F.col("word") == END_WORD)).select("word", "n", "form").toArrow()  # ``frequent`` rows of three numbers
    words, counts, forms = (top.column(c).to_numpy() for c in ("word", "n", "form"))
    if END_WORD not in words:
        words, counts, forms = np.append(words, END_WORD), np.append(counts, 0), np.append(forms, 0)
    order = np.argsort(words)
    lexicon = Lexicon(words[order].astype(np.int64), counts[order].astype(np.int64))
    lexicon_shared = sc.broadcast(lexicon)
    n_numbers = len(lexicon.words) + FORMS
    by_form = vocabulary.groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("w")).toArrow()  # FORMS rows
    form_counts, form_words = (np.bincount(by_form.column("form").to_numpy(), by_form.column(c).to_numpy(), FORMS).astype(np.int64) for c in ("n", "w"))
    form_counts -= np.bincount(forms.astype(np.int64), counts, FORMS).astype(np.int64)
    form_words -= np.bincount(forms[counts > 0].astype(np.int64), minlength=FORMS)

    named = rows.select("text", "held_out", "doc_id", F.xxhash64("doc_id", "text").alias("deal"))
    id_type = docs.schema[id_col].dataType.simpleString()
    read = scratch.keep(named.mapInArrow(_number(lexicon_shared), f"held_out boolean, doc_id {id_type}, deal long, tokens binary, tail array<long>").withColumn("row", F.monotonically_increasing_id()))
    training = read.where("not held_out")
    summed = training.select("tokens").mapInArrow(_neighbours(n_numbers, lexicon.end, blocks), "block int, rows binary, sums binary")
    summed = summed.repartition("block").mapInArrow(_add_sums, "block int, rows binary, sums binary").toArrow()  # WIDE numbers for each of n_numbers
    sums = np.zeros((n_numbers, WIDE))
    for r, x in zip(summed.column("rows").to_pylist(), summed.column("sums").to_pylist(), strict=True):
        sums[np.frombuffer(r, np.int32)] = np.frombuffer(x, np.int64).reshape(-1, WIDE)
    del summed
    made = make_classes(lexicon, sums, form_counts, form_words, classes, min(clusters, max(1, n_numbers // 8)))
    del sums
    shared = sc.broadcast(made)

    start = start_model(made.counts, width)
    flat = np.concatenate([start.flat(), np.full(len(start.flat()), 1e-6, np.float32)])
    shards = max(1, -(-total // shard_tokens))
    dealt = training.select(F.pmod("deal", F.lit(shards)).alias("shard"), "tokens", F.xxhash64("deal").alias("place")).repartition(shards, "shard").sortWithinPartitions("shard", "place").select("shard", "tokens")
    for k in range(rounds):
        learner = _learn(shared, sc.broadcast(flat), width, batch_tokens, blocks, k)
        parts = dealt.mapInArrow(learner, "block int, shard long, tokens long, values binary")
        means = parts.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_average, "block int, values binary").toArrow()  # one model
        learned = dict(zip(means.column("block").to_pylist(), means.column("values").to_pylist(), strict=True))
        if learned:
            flat = np.concatenate([np.frombuffer(learned[b], np.float32) for b in sorted(learned)])
    model = sc.broadcast((hash(flat.tobytes()), flat[: len(flat) // 2]))
    schema = f"held_out boolean, doc_id {id_type}, row long, n_tokens long, known long, logs double, model double"
    scored = read.select("tokens", "held_out", "doc_id", "row").mapInArrow(_scorer(lexicon_shared, shared, model, width), schema)
    tail = read.select("row", F.explode("tail").alias("word")).join(vocabulary, "word")
    tail = tail.groupBy("row").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("n") + 1)).alias("tail_logs"))
    more = F.coalesce("tail_logs", F.lit(0.0))
    return scored.join(tail.hint("shuffle_hash"), "row", "left").select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("model") + F.col("logs") + more).alias("score"),
    )
