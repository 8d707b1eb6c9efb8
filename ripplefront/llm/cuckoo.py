"""A cuckoo filter over 64-bit hashes: membership without misses, and deletions."""

from __future__ import annotations

import struct

import numpy as np

SLOTS = 4
KICKS = 500
HEAD = struct.Struct("<4sQQ")
MAGIC = b"CKF1"
MIX = np.uint64(0x9E3779B97F4A7C15)


class Full(Exception):
    """The filter has no room left; build a larger one from the exact table."""


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; each entry has two buckets it may be in.

    An inserted hash is always found until it is deleted; others are found by mistake about
    once in 8000 lookups. Delete only what was inserted.
    """

    def __init__(self, capacity: int):
        need = max(1, int(capacity / (0.9 * SLOTS)) + 1)
        self.n = 1 << (need - 1).bit_length()
        self.table = np.zeros((self.n, SLOTS), dtype=np.uint16)
        self.count = 0

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.asarray(hashes, dtype=np.uint64)
        mask = np.uint64(self.n - 1)
        fp = np.maximum(h >> np.uint64(48), np.uint64(1))
        first = h & mask
        return fp.astype(np.uint16), first.astype(np.int64), self._other(first, fp).astype(np.int64)

    def _other(self, place, fp):
        with np.errstate(over="ignore"):
            step = (np.asarray(fp, dtype=np.uint64) * MIX) >> np.uint64(24)
        return (np.asarray(place, dtype=np.uint64) ^ step) & np.uint64(self.n - 1)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(hashes)
        return (self.table[a] == fp[:, None]).any(axis=1) | (self.table[b] == fp[:, None]).any(axis=1)

    def insert(self, hashes: np.ndarray) -> None:
        """All or, where there is no room, those before the first that found none."""
        fps, firsts, seconds = self._places(hashes)
        todo = np.arange(len(fps))
        for places in (firsts, seconds):  # as many at once as free slots take
            todo = todo[~self._fill(fps[todo], places[todo])]
        for i in todo.tolist():
            if not (self._put(int(firsts[i]), int(fps[i])) or self._put(int(seconds[i]), int(fps[i]))):
                self._kick(int(firsts[i]), int(fps[i]))
            self.count += 1

    def _fill(self, fps: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Put what its bucket has a free slot for; which were put."""
        order = np.argsort(places, kind="stable")
        at = places[order]
        first = np.concatenate(([True], at[1:] != at[:-1])) if len(at) else np.zeros(0, bool)
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        free = (self.table[at] == 0).sum(axis=1)
        fits = rank < free
        slots = np.argsort(self.table[at[fits]] != 0, axis=1, kind="stable")  # free ones first
        self.table[at[fits], slots[np.arange(len(slots)), rank[fits]]] = fps[order][fits]
        self.count += int(fits.sum())
        done = np.zeros(len(at), dtype=bool)
        done[order[fits]] = True
        return done

    def _put(self, place: int, fp: int) -> bool:
        row = self.table[place]
        for k in range(SLOTS):
            if row[k] == 0:
                row[k] = fp
                return True
        return False

    def _kick(self, place: int, fp: int) -> None:
        path = []
        for i in range(KICKS):
            k = (place + i) % SLOTS
            path.append((place, k))
            held = int(self.table[place, k])
            self.table[place, k], fp = fp, held
            place = int(self._other(place, fp))
            if self._put(place, fp):
                return
        for place, k in reversed(path):  # leave the filter as it was
            self.table[place, k], fp = fp, int(self.table[place, k])
        raise Full

    def delete(self, hashes: np.ndarray) -> None:
        fps, firsts, seconds = self._places(hashes)
        for fp, a, b in zip(fps.tolist(), firsts.tolist(), seconds.tolist(), strict=True):
            for place in (a, b):
                at = np.flatnonzero(self.table[place] == fp)
                if len(at):
                    self.table[place, at[0]] = 0
                    self.count -= 1
                    break
            else:
                raise KeyError("deleted what was never inserted")

    def to_bytes(self) -> bytes:
        return HEAD.pack(MAGIC, self.n, self.count) + self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        magic, n, count = HEAD.unpack_from(data)
        if magic != MAGIC or len(data) != HEAD.size + 2 * SLOTS * n:
            raise ValueError("not a cuckoo filter, or cut short")
        out = cls(1)
        out.n, out.count = n, count
        out.table = np.frombuffer(data, "<u2", offset=HEAD.size).reshape(n, SLOTS).astype(np.uint16)
        return out

    @classmethod
    def built(cls, hashes: np.ndarray) -> CuckooFilter:
        size = max(8, len(hashes))
        while True:
            out = cls(size)
            try:
                out.insert(hashes)
                return out
            except Full:
                size *= 2
