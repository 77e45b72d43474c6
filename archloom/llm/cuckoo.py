"""A cuckoo filter over 64-bit keys: insertion, deletion and lookup of whole arrays in numpy.

A key has a 16-bit fingerprint and two buckets of four slots; either bucket and the fingerprint give
the other one, so a fingerprint can move without its key. Only a wider table needs the keys again.
"""

from __future__ import annotations

import numpy as np

from archloom.llm.words import mix

SLOTS = 4
ROUNDS = 64


class CuckooFilter:
    """Fingerprints of live keys. A key that was inserted and not deleted is always found; few others are."""

    def __init__(self, buckets: int = 16, slots: bytes | None = None) -> None:
        """``buckets`` is a power of two; ``slots`` is what ``packed`` gave."""
        self.table = np.zeros((buckets, SLOTS), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()

    @property
    def buckets(self) -> int:
        return len(self.table)

    def packed(self) -> bytes:
        return self.table.tobytes()

    def _print(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints (never 0, which marks a free slot) and first buckets."""
        fp = (keys >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        return fp, (mix(keys) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (mix(fp.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """False: the key isn't live. True: it may be."""
        fp, at = self._print(keys)
        return (self.table[at] == fp[:, None]).any(1) | (self.table[self._other(fp, at)] == fp[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Whether all keys found room. If not, some fingerprint is lost: build a wider filter from the stored keys.

        In each round every waiting fingerprint takes a free slot of its bucket; of those that find none, one
        a bucket takes the place of a fingerprint there, which then waits at its own other bucket.
        """
        fp, at = self._print(keys)
        for turn in range(ROUNDS):
            if not len(fp):
                return True
            order = np.argsort(at, kind="stable")
            fp, at = fp[order], at[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            free = self.table[at] == 0
            mine = free & (np.cumsum(free, axis=1) == (place + 1)[:, None])
            fits = mine.any(1)
            self.table[at[fits], mine[fits].argmax(1)] = fp[fits]
            fp, at = fp[~fits], at[~fits]
            if turn and len(fp):  # both buckets were tried once
                kicks = np.r_[True, at[1:] != at[:-1]]
                slot = (mix(at[kicks].astype(np.uint64) + np.uint64(turn)) % np.uint64(SLOTS)).astype(np.int64)
                out = self.table[at[kicks], slot]
                self.table[at[kicks], slot] = fp[kicks]
                fp = fp.copy()
                fp[kicks] = out
            at = self._other(fp, at)
        return not len(fp)

    def delete(self, keys: np.ndarray) -> None:
        """Each key, which must be live, loses one fingerprint."""
        fp, at = self._print(keys)
        for f, a, b in zip(fp.tolist(), at.tolist(), self._other(fp, at).tolist(), strict=True):
            for bucket in (a, b):
                found = np.flatnonzero(self.table[bucket] == f)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break


class LiveKeys:
    """A filter with the keys that are live in it; an overflow builds a filter of twice the width from the keys.

    A key may be live several times (different texts can have one key); the filter holds it once.
    """

    def __init__(self, slots: bytes | None = None, keys: bytes = b"") -> None:
        self.filter = CuckooFilter(slots=slots)
        self.keys = [np.frombuffer(keys, np.uint64)]
        self.resized = 0

    def stored(self) -> np.ndarray:
        self.keys = [np.concatenate(self.keys)]
        return self.keys[0]

    def insert(self, keys: np.ndarray, again: bool = False) -> None:
        """Adds keys, no two the same and none live; ``again``: all are live already."""
        self.keys.append(keys)
        if again or self.filter.insert(keys):
            return
        every, buckets = np.unique(self.stored()), self.filter.buckets
        while True:
            buckets *= 2
            self.resized += 1
            self.filter = CuckooFilter(buckets)
            if len(every) <= buckets * SLOTS and self.filter.insert(every):
                return

    def delete(self, keys: np.ndarray) -> None:
        """One live copy of each key goes; the filter loses the keys of which none is left."""
        left = np.sort(self.stored())
        keys = np.sort(keys)
        nth = np.arange(len(keys)) - np.searchsorted(keys, keys)
        left = np.delete(left, np.searchsorted(left, keys) + nth)
        self.keys = [left]
        self.filter.delete(np.setdiff1d(keys, left))
