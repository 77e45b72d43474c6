"""SentencePiece encoding and decoding, with the N best segmentations of each text.

Over the lattice of all pieces that fit, a forward Viterbi pass gives the best score to reach each
place. The N best paths then come from a backward A-star search, for which those scores are exact
heuristics: a partial path never waits behind a worse whole one. No piece runs on from a letter into
the next mark, so a text's lattice falls into units (words), and the N best of a text combine those of
its units; the search over a whole text gives the same and serves as the test.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archloom.llm.token_counts import MODEL
from archloom.llm.words import CHUNK, chunks, powers

MARK = "▁"
CACHE = 300_000


_LINE, _GAP, _LETTER, _DIGIT, _OTHER = range(5)


def _kinds(signs: str) -> np.ndarray:
    """The kind of each code point, as the finest cut tells them apart."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum() and c not in signs:
            out[i] = _DIGIT if c.isdecimal() else _LETTER
    out[[ord(" "), ord(MARK)]] = _GAP
    out[ord("\n")] = _LINE
    return out


class PieceModel:
    """Pieces with scores and ids; characters that no piece covers fall back to bytes, at a score below all pieces'."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): (float(sp.get_score(i)), i) for i in plain}
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(map(len, self.pieces))
        #: the trie of all pieces: by character, [what follows, the piece's score and ids or None]
        self.trie: dict[str, list] = {}
        for p, (score, i) in self.pieces.items():
            below = self.trie
            for c in p:
                node = below.setdefault(c, [{}, None])
                below = node[0]
            node[1] = (score, (i,))
        self.fallback = min(s for s, _ in self.pieces.values()) - 10.0
        self.as_bytes = [b""] * n
        for p, (_, i) in self.pieces.items():
            self.as_bytes[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            self.as_bytes[i] = bytes([b])
        # units: the finest of these cuts that goes through no piece
        # signs that are neither letters nor decimal digits, such as superscripts, go with the punctuation
        signs = "".join(sorted({c for p in self.pieces for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
        plain, other = rf"[^\W\d_{signs}]+|\d+", rf"(?:[_{signs}]|[^{MARK}\n\w])+"
        cuts = (rf"{MARK}*(?:{plain}|{other})|{MARK}+|\n", rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n", f"{MARK}*[^{MARK}]+|{MARK}+", "(?s:.+)")
        self.unit = self._finest(cuts)
        self.kinds = _kinds(signs) if self.unit.pattern == cuts[0] else None

    def _finest(self, cuts: tuple[str, ...]) -> re.Pattern:
        for cut in map(re.compile, cuts):
            if all(len(cut.findall(p)) == 1 for p in self.pieces):
                return cut
        raise ValueError("the last cut takes a text whole")

    def units(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the different units of the texts, the unit at each place, the n+1 places at which the texts begin).

        The finest cut is made on code points for all texts at once; the other cuts, and texts of
        millions of characters, go through the pattern.
        """
        long = sum(len(t or "") for t in texts) > 2 * CHUNK
        if self.kinds is None or long:
            number: dict[str, int] = {}
            each = [self.unit.findall(self.marked(t)) if t else [] for t in texts]
            inverse = np.array([number.setdefault(u, len(number)) for units in each for u in units], np.int64)
            return list(number), inverse, np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        joined = "".join([" " + t if t else "" for t in texts])
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in texts])]).astype(np.int64)
        if not joined:
            return [], np.zeros(0, np.int64), np.zeros(len(begin), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[points]
        cut = np.ones(len(points) + 1, bool)
        a, b = kind[:-1], kind[1:]
        cut[1:-1] = (b == _LINE) | (a == _LINE) | ((a != _GAP) & (a != b))
        cut[begin] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        up, down = powers(len(points) + 1)
        values = np.where(kind == _GAP, np.uint64(33), points.astype(np.uint64) + np.uint64(1))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(points)])])
        _, first, inverse = np.unique((total[ends] - total[starts]) * down[starts], return_index=True, return_inverse=True)
        names = [joined[x:y].replace(" ", MARK) for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        return names, inverse, np.searchsorted(starts, begin)

    def marked(self, text: str) -> str:
        """The text as the lattice sees it: a mark in front and for each space."""
        return MARK + text.replace(" ", MARK) if text else ""

    def forward(self, s: str, ending: list[list] | None) -> list[float]:
        """The best score up to each place; the edges into each go into ``ending`` if it is given."""
        n, trie, pieces = len(s), self.trie, self.pieces
        best: list = [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):  # all edges into a place start before it, so best[i] stands
            here = best[i]
            if s[i] not in pieces:
                edge = self.by_bytes(i, s[i])
                if ending is not None:
                    ending[i + 1].append(edge)
                if best[i + 1] is None or here + edge[1] > best[i + 1]:
                    best[i + 1] = here + edge[1]
            below, j = trie, i
            for c in s[i : i + self.longest]:
                node = below.get(c)
                if node is None:
                    break
                j += 1
                below, found = node
                if found is not None:
                    score, ids = found
                    if ending is not None:
                        ending[j].append((i, score, ids))
                    total, had = here + score, best[j]
                    if had is None or total > had:
                        best[j] = total
        return best

    def by_bytes(self, i: int, c: str) -> tuple[int, float, tuple[int, ...]]:
        raw = c.encode("utf-8", "surrogatepass")
        return i, self.fallback * len(raw), tuple([self.byte_id[b] for b in raw])

    def ending_at(self, s: str, j: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """The edges into a place, as (start, score, ids)."""
        out = []
        for i in range(max(0, j - self.longest), j):
            found = self.pieces.get(s[i:j])
            if found is not None:
                out.append((i, found[0], (found[1],)))
        if s[j - 1] not in self.pieces:
            out.append(self.by_bytes(j - 1, s[j - 1]))
        return out

    def nbest(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a marked text, best first; ties in the order of the search.

        As the heuristic is exact, each open path stands for a whole one of just its rank. So no more
        than the ``n`` best open paths are ever needed, however long the text; and the edge that keeps
        a path's rank is followed at once, as no other path can come before it.
        """
        if not s:
            return [(0.0, ())]
        ending = [[] for _ in range(len(s) + 1)] if len(s) <= 256 else None
        best = self.forward(s, ending)
        front: list[tuple] = [(0.0, 0, len(s), 0.0, None)]  # loss against the best, order, place, score behind, pieces behind
        out: list[tuple[float, tuple[int, ...]]] = []
        made = 0
        while front and len(out) < n:
            loss, _, j, behind, tail = front.pop(0)
            room = n - len(out) - 1
            while j:
                top, ahead = best[j], None
                for edge in ending[j] if ending is not None else self.ending_at(s, j):
                    more = top - (best[edge[0]] + edge[1])
                    if not more and ahead is None:
                        ahead = edge
                    elif room and (len(front) < room or loss + more < front[-1][0]):
                        made += 1
                        front.append((loss + more, made, edge[0], behind + edge[1], (edge[2], tail)))
                        front.sort()
                        del front[room:]
                j = ahead[0]
                behind += ahead[1]
                tail = (ahead[2], tail)
            ids: list[int] = []
            while tail is not None:
                ids += tail[0]
                tail = tail[1]
            out.append((behind, tuple(ids)))
        return out


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


class _Units(dict):
    """(ids as bytes, best score, first loss, losses of the next best, their ids as bytes with ``_NEXT`` between) of the units met lately.

    Two generations of ``CACHE`` units at most: what is met again moves to the younger one.
    """

    def __init__(self, model: PieceModel, n: int) -> None:
        super().__init__()
        self.model, self.n, self.old = model, n, {}

    def __missing__(self, unit: str) -> tuple:
        made = self.old.get(unit)
        if made is None:
            found = self.model.nbest(unit, self.n)
            top = found[0][0]
            losses = tuple([top - s for s, _ in found[1:]])
            raws = [array("i", ids).tobytes() for _, ids in found]
            made = (raws[0], top, losses[0] if losses else _NEVER, losses, _NEXT.join(raws[1:]))
            if len(unit) > 200:
                return made
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[unit] = made
        return made


_NEVER = float("inf")
#: Between the ids of a unit's alternatives; as the highest byte of an id is 0, it stands in none.
_NEXT = b"\xff" * 4


@lru_cache(maxsize=2)
def _units(path: str, n: int) -> _Units:
    return _Units(piece_model(path), n)


def best_choices(firsts: np.ndarray, losses: Callable[[int], tuple[float, ...]], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The ``n`` least losses of a text against its best segmentation, from its units' first losses (changed) and all of them.

    Each with the changes that make it: (unit, number of its alternative from 0). Only the n-1 units
    of least first loss can matter: each of them alone beats any other change.
    """
    sums: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    for _ in range(min(n - 1, len(firsts))):
        at = int(firsts.argmin())
        if firsts[at] == _NEVER:
            break
        firsts[at] = _NEVER
        sums = sorted(sums + [(a + b, (*had, (at, k))) for a, had in sums for k, b in enumerate(losses(at))], key=_loss)[:n]
    return sums


_loss = itemgetter(0)


def best_losses(firsts: np.ndarray, losses: Callable[[int], tuple[float, ...]], n: int) -> list[float]:
    """The losses of ``best_choices``."""
    return [loss for loss, _ in best_choices(firsts, losses, n)]


def _bytes_of(model: PieceModel, raw: bytes) -> bytes:
    return b"".join(map(model.as_bytes.__getitem__, memoryview(raw).cast("i")))


def _encode_some(model: PieceModel, seen: _Units, texts: list[str | None], n: int) -> tuple[list[pa.Array], list[bool]]:
    """n_pieces, score, scores, others and ids of some texts, and whether their other segmentations decode as the best does."""
    names, inverse, at = model.units(texts)
    raws, tops, firsts, losses, nexts = zip(*map(seen.__getitem__, names), strict=True) if names else ((), (), (), (), ())
    size = np.array([len(r) // 4 for r in raws], np.int64)
    before = np.concatenate([[0], np.cumsum(size)])
    count = size[inverse]
    place = np.concatenate([[0], np.cumsum(count)])
    ids = np.frombuffer(b"".join(raws), np.int32)[np.repeat(before[inverse] - place[:-1], count) + np.arange(place[-1])]
    ends = place[at]
    full = np.flatnonzero(np.diff(at))
    score = np.zeros(len(texts))
    score[full] = np.add.reduceat(np.array(tops, float)[inverse], at[full]) if len(full) else 0
    first = np.array(firsts, float)[inverse]
    scores, other_scores, other_ends, change_ends, changes, new, alike = [], [], [0], [0], [], [], []
    for k in range(len(texts)):
        lo, top, same = int(at[k]), float(score[k]), True
        found = best_choices(first[lo : at[k + 1]], lambda i, lo=lo: losses[inverse[lo + i]], n)
        scores.append([top - x for x, _ in found])
        other_scores += scores[-1][1:]
        other_ends.append(len(other_scores))
        for _, made in found[1:]:
            for i, choice in sorted(made):
                unit = inverse[lo + i]
                new.append(nexts[unit].split(_NEXT)[choice])
                changes.append(lo + i)
                same = same and _bytes_of(model, new[-1]) == _bytes_of(model, raws[unit])
            change_ends.append(len(changes))
        alike.append(same)
    of = np.array(changes, np.int64)
    text = np.searchsorted(at, of, side="right") - 1
    new_ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in new])]).astype(np.int32)
    new_ids = pa.ListArray.from_arrays(pa.array(new_ends), pa.array(np.frombuffer(b"".join(new), np.int32)))
    change = pa.StructArray.from_arrays([pa.array((place[of] - ends[text]).astype(np.int32)), pa.array(count[of].astype(np.int32)), new_ids], names=["at", "n", "ids"])
    other = pa.StructArray.from_arrays([pa.array(other_scores, pa.float64()), pa.ListArray.from_arrays(pa.array(change_ends, pa.int32()), change)], names=["score", "changes"])
    others = pa.ListArray.from_arrays(pa.array(other_ends, pa.int32()), other)
    listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=pa.array([t is None for t in texts], pa.bool_()))
    return [pa.array(np.diff(ends)), pa.array(score), pa.array(scores, pa.list_(pa.float64())), others, listed], alike


def _texts_of(model: PieceModel, ids: pa.ListArray) -> list[str | None]:
    """The text of each list of ids: the pieces' bytes joined, less the space that stands in front."""
    table, ends = model.as_bytes.__getitem__, ids.offsets.to_numpy()
    parts = list(map(table, ids.values.to_numpy()[ends[0] : ends[-1]].tolist()))
    ends = (ends - ends[0]).tolist()
    return [b"".join(parts[a:b]).removeprefix(b" ").decode("utf-8", "replace") if ok else None for a, b, ok in zip(ends[:-1], ends[1:], ids.is_valid().to_pylist(), strict=True)]


def _encoder(path: str, n: int, check: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = piece_model(path), _units(path, n)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in chunks(np.concatenate([[0], np.cumsum([len(t or "") for t in texts])])):
                made, alike = _encode_some(model, seen, texts[lo:hi], n)
                names = ["n_pieces", "score", "scores", "others", "ids"]
                columns = batch.slice(lo, hi - lo).columns
                if check:  # in the same task, so that the text needn't travel
                    back = _texts_of(model, made[-1])
                    made.append(pa.array([a == b and same for a, b, same in zip(texts[lo:hi], back, alike, strict=True)], pa.bool_()))
                    yield pa.RecordBatch.from_arrays([columns[0], *made], names=["doc_id", *names, "round_trip"])
                else:
                    yield pa.RecordBatch.from_arrays([*columns, *made], names=[*batch.schema.names, *names])

    return encode


OTHERS = "others array<struct<score:double,changes:array<struct<at:int,n:int,ids:array<int>>>>>"


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", nbest: int = 3, model: str = MODEL) -> DataFrame:
    """One row for each row of ``docs``: (id, text, n_pieces, score, scores, others, ids).

    ids: the best segmentation; score: the sum of its pieces' scores; scores: those of the ``nbest``
    best, fewer where there are no more; others: the segmentations after the best, as score and changes
    (in place of the ``n`` best ids after the first ``at`` stand ``ids``; ``segmentations`` has them
    whole). A null text has null ids and no pieces, an empty one empty
    ids. ``model``: a SentencePiece model file that all executors find at this path. Other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_encoder(model, nbest, False), f"doc_id long, text string, n_pieces long, score double, scores array<double>, {OTHERS}, ids array<int>")
    return out.withColumnRenamed("doc_id", id_col)


def segmentations(encoded: DataFrame) -> DataFrame:
    """A row for each segmentation: ``encoded`` (all other columns) with rank from 1, score, n_pieces and ids of it."""

    def changed(changes: Column) -> Column:
        # from the last change to the first, so that the places before stay as they are
        return F.aggregate(F.reverse(changes), F.col("ids"), lambda ids, c: F.concat(F.slice(ids, F.lit(1), c["at"]), c["ids"], F.slice(ids, c["at"] + c["n"] + 1, F.size(ids))))

    best = F.array(F.struct(F.col("score").alias("score"), F.col("ids").alias("ids")))
    every = F.concat(best, F.transform("others", lambda o: F.struct(o["score"].alias("score"), changed(o["changes"]).alias("ids"))))
    rest = [c for c in encoded.columns if c not in ("score", "scores", "others", "ids", "n_pieces")]
    rows = encoded.select(*rest, F.posexplode(every).alias("_rank", "_one"))
    return rows.select(*rest, (F.col("_rank") + 1).alias("rank"), F.col("_one.score").alias("score"), F.coalesce(F.array_size("_one.ids"), F.lit(0)).cast("long").alias("n_pieces"), F.col("_one.ids").alias("ids"))


def _decoder(path: str, place: int):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                texts = _texts_of(piece_model(path), batch.column(place))
                yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return decode


def decode(encoded: DataFrame, *, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text that the ids stand for; null where they are null."""
    place = encoded.columns.index(ids_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(_decoder(model, place), schema)


def encode_and_check(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", nbest: int = 3, model: str = MODEL) -> DataFrame:
    """``encode`` without the text, and whether decoding gives the text back (it does unless the text holds the mark itself).

    round_trip is for all segmentations: the best is decoded, and the changes of the others must have
    the bytes of what they replace.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_encoder(model, nbest, True), f"doc_id long, n_pieces long, score double, scores array<double>, {OTHERS}, ids array<int>, round_trip boolean")
    return out.withColumnRenamed("doc_id", id_col)
