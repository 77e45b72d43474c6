"""Source audit, exact dedup and whitening against brute force, and on rows that tend to break things."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archloom.llm import exact_dedup, source_audit
from archloom.llm.cuckoo import SLOTS, CuckooFilter, LiveKeys
from archloom.llm.exact_dedup import LiveIndex, dedup
from archloom.llm.source_audit import audit
from archloom.llm.whitening import _deviations, whiten

# -- cuckoo filter


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_live_keys_are_always_found(data):
    """Whatever is inserted and deleted, in batches, with repeated keys and through resizing."""
    r = random.Random(data.draw(st.integers(0, 10**6)))
    live, want = LiveKeys(), Counter()
    few = [r.getrandbits(64) for _ in range(40)]
    for _ in range(data.draw(st.integers(1, 8))):
        batch = [r.choice(few) if r.random() < 0.02 else r.getrandbits(64) for _ in range(r.randrange(200))]
        fresh = sorted({k for k in batch if not want[k]})
        more = [k for k in batch if want[k]]
        want.update(fresh + more)
        live.insert(np.array(fresh, np.uint64))
        live.insert(np.array(more, np.uint64), again=True)
        gone = [k for k in want if want[k] and r.random() < 0.3]
        for k in gone:
            want[k] -= 1
        live.delete(np.array(gone, np.uint64))
        left = [k for k in want.elements()]
        assert sorted(live.stored().tolist()) == sorted(left)
        if left:
            assert live.filter.holds(np.array(left, np.uint64)).all()
        again = LiveKeys(live.filter.packed(), live.stored().tobytes())
        assert not left or again.filter.holds(np.array(left, np.uint64)).all()


def test_few_other_keys_hit_and_deleted_ones_go():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 200_000, np.uint64)
    live = LiveKeys()
    for part in np.array_split(keys[:100_000], 37):
        live.insert(part)
    assert live.resized > 5 and live.filter.buckets * SLOTS < 400_000
    assert live.filter.holds(keys[:100_000]).all()
    assert live.filter.holds(keys[100_000:]).mean() < 0.001
    live.delete(keys[:50_000])
    assert live.filter.holds(keys[50_000:100_000]).all()
    assert live.filter.holds(keys[:50_000]).mean() < 0.001


def test_overflow_is_told():
    full = CuckooFilter(2)
    assert full.insert(np.arange(1, 8, dtype=np.uint64) << np.uint64(40))
    assert not full.insert(np.arange(100, 120, dtype=np.uint64) << np.uint64(40))


# -- exact dedup

DOCS = "doc_id long, text string, digest string, n long, shard long, kind string, times long, keep_id long"
ODD = [(None, None), (None, ""), (None, "no id"), (1, None), (2, ""), (3, "x"), (3, "x"), (3, "y"), (4, "x "), (5, "X"), (6, "é"), (7, "é"), (8, "w " * 40000), (9, "w " * 40000), (10, "w " * 40000 + "v"), (-4, "x")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", 1, 2, "k", 3, 4) for i, t in rows], DOCS)


def plain(rows):
    """Rows of the result by brute force."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            kept = i == top and first
            first = first and not kept
            out[(i, top, len(ids), kept, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


def many(seed, n):
    r = random.Random(seed)
    return [(i, "hot " * 50 if r.random() < 0.35 else f"text {r.randrange(n // 2)} " * r.randrange(1, 9)) for i in r.sample(range(10 * n), n)]


@pytest.mark.parametrize("rows", [ODD, many(1, 3000)], ids=["odd", "hot"])
@pytest.mark.parametrize("shards", [None, 1, 7])
def test_dedup_equals_brute_force(spark, rows, shards):
    found = dedup(frame(spark, rows).repartition(5), shards)
    assert Counter(map(tuple, found.collect())) == plain(rows)
    assert not dedup(frame(spark, rows).limit(0), shards).collect()


def test_texts_whose_digests_begin_alike_stay_apart(spark, monkeypatch):
    """Hits are verified by content: here only four keys exist, so nearly every lookup hits."""
    import pyarrow as pa

    whole = exact_dedup._distinct_in_batch

    def short(batches):
        for b in whole(batches):
            cut = [bytes([d[0] % 4]) * 9 + d[9:] for d in b.column("digest").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), *b.columns[1:]], b.schema.names)

    rows = many(2, 400)
    batches = [pa.record_batch({"doc_id": [i for i, _ in part], "text": [t for _, t in part]}) for part in (rows[:150], rows[150:])]
    shard = exact_dedup._Shard(0)
    for b in short(batches):
        shard.take(exact_dedup.NEW, b)
    found = [r for r in shard.found(False).to_pylist() if r["kind"] == "new"]
    want = {(top, n) for (_, top, n, kept, _) in plain(rows) if kept}
    assert {(r["top_id"], r["n"]) for r in found} == want and len(found) == len(want)
    assert shard.false_hits > 100


def test_index_inserts_and_deletes(spark):
    rows, r = many(3, 900), random.Random(4)
    parts = [rows[:400], rows[400:700], rows[700:] + [(None, "late"), (rows[0][0], rows[0][1])]]
    index, live = LiveIndex(spark, 3), []
    for part in parts:
        known = {bytes(x.digest): x.known for x in index.insert(frame(spark, part)).collect()}
        before = {hashlib.sha256((t or "").encode()).digest() for _, t in live}
        assert known == {d: d in before for d in (hashlib.sha256((t or "").encode()).digest() for _, t in part)}
        live += part
        gone = {i for i, _ in live if i is not None and r.random() < 0.3}
        index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        live = [x for x in live if x[0] not in gone]
        assert Counter(map(tuple, index.groups().collect())) == plain(live)
        assert {x.text.decode() for x in index.content.select(F.col("text")).collect()} == {t for _, t in live}
    again = index.insert(frame(spark, parts[0])).collect()  # what was deleted is new, what is live is known
    held = {hashlib.sha256(t.encode()).digest() for _, t in live}
    assert all(x.known == (bytes(x.digest) in held) for x in again)


# -- source audit


def brute(rows, least, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + math.floor(Fraction(10**9 * (count[t] + 2), total)) for t in kept}

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        whole = shares(sum((groups[lang, s] for s in sources), Counter()))
        own = {s: shares(groups[lang, s]) for s in sources}
        for s in sources:
            pair = [(sum(apart(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(apart(own[s][t], whole[t]), t) for t in kept if groups[lang, s][t] and own[s][t] > whole[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return Counter(out)


def corpus(seed, n, sources):
    r = random.Random(seed)
    names = ["alpha", "Beta", "gamma", "déjà", "ÉA", "don't", "x1y", "zz", "\U0001f600q", "Tok-en"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)]
    rows = [(r.choice(["en", "fr", None]), None if r.random() < 0.05 else f"s{min(r.randrange(sources), r.randrange(sources))}", " ".join(r.choices(names, k=r.randrange(40)))) for _ in range(n)]
    return rows + [("en", "empty", None), ("en", "empty", ""), ("xx", "only", "rare words"), ("xx", "other", "123 ..."), ("fr", "s0", "alpha " * 30000)]


AUDIT = "lang string, source string, text string, term string, n long, total long, value long, rank int, g long, chunk long, slab long"


def audited(spark, rows):
    return spark.createDataFrame([(*x, "t", 1, 2, 3, 4, 5, 6, 7) for x in rows], AUDIT).repartition(3)


@pytest.mark.parametrize(("chunk", "slab", "block"), [(4096, 16, 16), (7, 3, 4), (1, 1, 1), (5, 100, 2)])
def test_audit_equals_brute_force(spark, monkeypatch, chunk, slab, block):
    rows = corpus(chunk, 300, 9)
    for name, value in (("CHUNK", chunk), ("SLAB", slab)):
        monkeypatch.setattr(source_audit, name, value)
    found = Counter(map(tuple, audit(audited(spark, rows), least_docs=5, block=block).collect()))
    assert found == brute(rows, 5, 10)


def test_counting_tasks_pass_their_counts_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_audit, "HELD", 20)
    rows = [("en", f"s{k % 3}", f"a b c{k} d e{k}") for k in range(60)]
    batch = pa.record_batch({c: pa.array([r[i] for r in rows]) for i, c in enumerate(("lang", "source", "text"))})
    found = Counter()
    docs = Counter()
    for out in source_audit._count([batch, batch]):
        for r in out.to_pylist():
            found[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert found["s0", "a"] == 40 and docs["s1", "e"] == 40 and found["s2", "d"] == 40 and found["s0", None] == 0


def test_audit_of_nothing(spark):
    empty = audited(spark, corpus(1, 5, 2)).limit(0)
    assert not audit(empty).collect()
    rare = audit(audited(spark, [("en", "a", "x y"), ("en", "b", "x z"), (None, None, None)])).collect()
    assert sorted(map(tuple, rare)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


# -- whitening

VECTORS = "vec_id long, embedding array<float>, x string, n long, whitened string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "w", "c") for i, v in rows], VECTORS).repartition(3)


def check_whitening(found, rows, width, most=16):
    """Everything that a reader can compute in whole numbers or with numpy alone."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[c - s / n for c, s in zip(x, sums, strict=True)] for x in fit])
    cov = centred.T @ centred / n
    values, units = (a[..., ::-1] for a in np.linalg.eigh(cov))
    some = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(found) == some * len(good)
    assert Counter((r.vec_id, r.component) for r in found) == Counter((i, k) for i, _ in good for k in range(1, some + 1))
    exact = defaultdict(set)
    for i, x in good:
        exact[i].add(sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)))
    assert all(r.n == n and r.deviation in exact[r.vec_id] for r in found)
    assert all(abs(r.explained / (values[r.component - 1] / np.trace(cov)) - 1) < 1e-9 for r in found)
    assert len({r.identity_error for r in found}) == 1 and 0 <= found[0].identity_error < 1e-9
    once = {i for i, k in Counter(i for i, _ in good).items() if k == 1}
    white = {(r.vec_id, r.component): r.whitened for r in found}
    for k in range(some):
        mine = np.array([white[i, k + 1] for i, _ in good if i in once])
        want = np.array([(np.array([c - s / n for c, s in zip(x, sums, strict=True)]) @ units[:, k]) / math.sqrt(values[k]) for i, x in good if i in once])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6


def some_vectors(seed, n, width):
    r = np.random.default_rng(seed)
    spread = r.normal(size=(width, width)) * np.linspace(0.2, 3, width)
    made = [(int(i), [float(c) for c in np.float32(v)]) for i, v in enumerate(r.normal(size=(n, width)) @ spread)]
    return made + [(n + k, made[3][1]) for k in range(n // 3)]


@pytest.mark.parametrize(("n", "width"), [(300, 24), (200, 5), (40, 20)])
def test_whitening_equals_numpy(spark, n, width):
    rows = some_vectors(n, n, width)
    check_whitening(whiten(vectors(spark, rows)).collect(), rows, width)


def test_whitening_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, [nan] * 4), (902, [0.0, 1.0, None, 2.0]), (903, [inf, 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0]), (906, [1e30, 0.0, 0.0, 0.0]), (None, [9.0, -1.0, 0.5, 2.0]), (7, [1.0, 1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0, 1.0])]
    rows = some_vectors(5, 30, 4) + odd
    found = whiten(vectors(spark, rows)).collect()
    check_whitening(found, [(i, v) for i, v in rows if i != 906], 4)
    assert not whiten(vectors(spark, rows).limit(0)).collect()
    assert not whiten(vectors(spark, odd[:5])).collect()
    assert not whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    flat = whiten(vectors(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 4.0, 3.0]), (3, [1.0, 9.0, 3.0])])).collect()
    assert sorted((r.vec_id, r.component) for r in flat) == [(1, 1), (2, 1), (3, 1)]


def test_whitening_of_the_given_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(whiten(spark.read.parquet(f"{sf}/embeddings.parquet")).collect(), rows, 64)


def test_large_deviations_are_exact_or_null():
    x = np.array([[1 << 20, 0], [3, 5], [1 << 30, 1 << 30]], np.int64)
    sums, n = np.array([7, 9], np.int64), 2000
    want = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert _deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]
    assert want[2] >= 1 << 63 > want[0] > 1 << 61
