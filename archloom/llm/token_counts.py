"""Token counts: greedy longest-match word pieces by a trie with failure links, counted without building them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 200_000
_GAPS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


class Automaton:
    """Longest-match counting in one pass over a word.

    Each node of the trie has a failure link and the number of pieces that following it pops: where no
    edge fits, the pieces matched so far are counted and the scan goes on from the link's node, which
    stands for the rest of what was read. A word starts with the mark; ``root`` is where a word starts,
    and after its first piece the unmarked pieces go on from there too, as no word holds the mark again.
    """

    def __init__(self, pieces: Iterable[str]) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.final = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.edges[node]:
                    self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    self.final.append(False)
                node = self.edges[node][c]
            self.final[node] = True
        n = len(self.edges)
        self.link: list[int | None] = [None] * n
        self.popped = [0] * n
        level = [(0, c, v) for c, v in self.edges[0].items()]
        while level:
            after = []
            for parent, c, v in level:
                if self.final[v]:
                    self.link[v], self.popped[v] = 0, 1
                elif parent:
                    z, count = self.link[parent], self.popped[parent]
                    while z is not None and c not in self.edges[z]:
                        count += self.popped[z]
                        z = self.link[z]
                    if z is not None:
                        self.link[v], self.popped[v] = self.edges[z][c], count
                after += [(v, d, w) for d, w in self.edges[v].items()]
            level = after

    def count(self, word: str) -> int:
        """The pieces of ``word`` by greedy longest match; 0 if it can't be cut into pieces whole."""
        edges, link, popped = self.edges, self.link, self.popped
        node, total = 0, 0
        for c in word:
            while (to := edges[node].get(c)) is None:
                total += popped[node]
                if link[node] is None:
                    return 0
                node = link[node]
            node = to
        while node:
            total += popped[node]
            if link[node] is None:
                return 0
            node = link[node]
        return total


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(load_pieces(path))


class _Counts(dict):
    """Counts of the words met so far, of at most ``CACHE`` words."""

    def __init__(self, machine: Automaton) -> None:
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.count(MARK + word)
        if len(word) > 1000:
            return n
        if len(self) >= CACHE:
            self.clear()
        self[word] = n
        return n


def _counter(path: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _Counts(automaton(path))
        for pdf in batches:
            words, tokens, unknown = [], [], []
            for text in pdf["text"]:
                parts = [w for w in text.translate(_GAPS).split(" ") if w] if text else []
                each = list(map(seen.__getitem__, parts))
                lost = each.count(0)
                words.append(len(parts))
                tokens.append(sum(each) + lost)
                unknown.append(lost)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": words, "n_tokens": tokens, "n_unknown": unknown})

    return count


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row for each row of ``docs``: (id, n_words, n_tokens, n_unknown), all long.

    Words are runs of characters other than space and 0x09-0x0D. A word is cut from its start by the
    longest piece each time; one that can't be cut whole is one unknown token. Null and empty texts
    have no tokens. ``model``: a SentencePiece model file that all executors find at this path.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInPandas(_counter(model), "doc_id long, n_words long, n_tokens long, n_unknown long")
    return out.withColumnRenamed("doc_id", id_col)
