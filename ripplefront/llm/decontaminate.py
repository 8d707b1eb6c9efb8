"""Benchmark decontamination with SimHash over item-sized windows.

Words are runs of letters, digits and marks in lower case, so case, punctuation and white
space don't count. For an item of n words every window of n words of a document is a
candidate (of a shorter document, the document). A window is compared by its 5-word
shingles, each weighted by how often it occurs: the similarity is the sum of the smaller
weights over the sum of the larger ones, and a pair counts at 0.8 or more.

A window without any shingle of an item of its size has similarity 0, so only windows
around such a shingle are fingerprinted: none that could count is lost. Their SimHashes are
looked up in multi-index Hamming blocks: the 64 bits are cut into 8 bytes, and fingerprints
within RADIUS bits agree up to RADIUS // 8 bits in one byte at least, so looking up all
bytes that near finds each pair in the radius. Then the exact similarity decides. At a
similarity of 0.8 about 10 bits differ, with a deviation of 3: the radius of 23 is beyond
four deviations, and beyond all doubt for closer pairs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RADIUS = 23
#: Items are a query set: they are broadcast in blocks of up to so many bytes of text.
BLOCK_BYTES = 16 << 20
#: Windows fingerprinted at once; bounds memory.
WINDOWS = 4096


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each word of all texts in a row, and where each text's end."""
    from xxhash import xxh3_64_intdigest

    at, distinct, ends = words.numbered(texts)
    codes = np.array([xxh3_64_intdigest(w) for w in distinct.to_pylist()], dtype=np.uint64)
    return codes[at], ends


def shingles(codes: np.ndarray) -> np.ndarray:
    """The 64-bit hash of the shingle at each word; a shorter text has one, of all its words."""
    n = min(SHINGLE_WORDS, len(codes))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - n + 1 + i]
            out ^= out >> np.uint64(31)
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def simhash(hashes: np.ndarray) -> np.ndarray:
    """SimHashes of rows of shingle hashes: a bit is 1 if set in over half of a row."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(*hashes.shape, 8), axis=2, bitorder="little")
    votes = bits.reshape(*hashes.shape, 64).sum(axis=1, dtype=np.int32)
    return np.packbits(2 * votes > hashes.shape[1], axis=1, bitorder="little").view("<u8")[:, 0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over joint weight of two rows of shingles, weighted by how often they occur."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    shared = sum((x & y).values())
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 0.0


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _masks(radius: int) -> np.ndarray:
    flips = [0]
    for k in range(1, radius // 8 + 1):
        flips += [sum(1 << i for i in c) for c in combinations(range(8), k)]
    return np.array(flips, dtype=np.uint8)


class Items:
    """A block of benchmark items, by size, with their shingles and Hamming index."""

    def __init__(self, items: list[tuple], radius: int = RADIUS):
        self.radius, self.masks = radius, _masks(radius)
        self.ids, self.shingles, self.sizes = [], [], []
        for item_id, text in items:
            codes, _ = word_codes([text or ""])
            if len(codes):
                self.ids.append(item_id)
                self.shingles.append(shingles(codes))
                self.sizes.append(len(codes))
        self.fp = np.array([int(simhash(s[None, :])[0]) for s in self.shingles], dtype=np.uint64)
        bytes_of = self.fp.astype("<u8").view(np.uint8).reshape(-1, 8)
        self.index: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        by_size: dict[int, list[np.ndarray]] = defaultdict(list)
        for i, size in enumerate(self.sizes):
            by_size[size].append(self.shingles[i])
            for k in range(8):
                for v in (bytes_of[i, k] ^ self.masks).tolist():  # every byte near enough to the item's
                    self.index[size][k, v].append(i)
        self.anchors = {size: np.unique(np.concatenate(s)) for size, s in by_size.items()}
        #: shingles of items with five words or more; shorter items have a shingle of their own length
        long = [s for size, s in self.anchors.items() if size >= SHINGLE_WORDS]
        self.known = np.unique(np.concatenate(long)) if long else np.zeros(0, np.uint64)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.known >> np.uint64(44)] = True

        self.short = [s for s in self.anchors if s < SHINGLE_WORDS]

    def seen(self, hashes: np.ndarray) -> np.ndarray:
        """Where a shingle of any item is."""
        at = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        return at[among(hashes[at], self.known)]

    def suspects(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The documents, of all in a row, that hold a shingle of an item."""
        if self.short:
            return np.arange(len(ends))
        at = self.seen(shingles(codes)) if len(codes) >= SHINGLE_WORDS else np.zeros(0, np.int64)
        doc = np.searchsorted(ends, at, side="right")
        return np.unique(doc[at + SHINGLE_WORDS <= ends[doc]])

    def near(self, fps: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(window, item) pairs within the radius, from the blocks' postings."""
        index, out = self.index[size], []
        for w, row in enumerate(fps.astype("<u8").view(np.uint8).reshape(-1, 8)):
            found = {i for k, v in enumerate(row.tolist()) for i in index.get((k, v), ())}
            out += [(w, i) for i in found if int(self.fp[i] ^ fps[w]).bit_count() <= self.radius]
        return out

    def matches(self, codes: np.ndarray, threshold: float) -> list[tuple]:
        """(item_id, similarity, first word, words) of the best window for each item."""
        n, best = len(codes), {}
        if not n:
            return []
        hashes = shingles(codes)
        if n >= SHINGLE_WORDS:
            seen = self.seen(hashes)
        else:
            seen = np.zeros(0, np.int64)
        if not len(seen) and not self.short:
            return []
        for size, anchors in self.anchors.items():
            if size < SHINGLE_WORDS:
                # a window of so few words is one shingle: it counts if it is the item
                if n < size:
                    continue
                rows = np.lib.stride_tricks.sliding_window_view(codes, size)
                own = np.array([shingles(r)[0] for r in rows]) if n == size else _short(codes, size)
                for at in np.flatnonzero(among(own, anchors)).tolist():
                    self._judge(best, own[at : at + 1][None, :], np.array([at]), size, size, threshold)
                continue
            at = seen[among(hashes[seen], anchors)]
            if not len(at):
                continue
            width = min(size, n)
            reach = width - SHINGLE_WORDS  # a window's last shingle starts so far behind its first word
            mark = np.zeros(n - width + 2, dtype=np.int64)
            np.add.at(mark, np.maximum(0, at - reach), 1)
            np.add.at(mark, np.minimum(at, n - width) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            rows = np.lib.stride_tricks.sliding_window_view(hashes, reach + 1)
            for i in range(0, len(starts), WINDOWS):
                part = starts[i : i + WINDOWS]
                self._judge(best, rows[part], part, size, width, threshold)
        return [(self.ids[i], s, at, width) for i, (s, at, width) in sorted(best.items(), key=lambda x: x[0])]

    def _judge(self, best: dict, rows: np.ndarray, starts: np.ndarray, size: int, width: int, threshold: float) -> None:
        for w, i in self.near(simhash(rows), size):
            s = similarity(rows[w], self.shingles[i])
            if s >= threshold and s > best.get(i, (0.0,))[0]:
                best[i] = (s, int(starts[w]), width)


def _short(codes: np.ndarray, size: int) -> np.ndarray:
    """The shingle of each window of fewer words than a shingle has."""
    out = np.zeros(len(codes) - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - size + 1 + i]
            out ^= out >> np.uint64(31)
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items in blocks small enough to broadcast; one block is on the driver at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += 4 * len(r["text"])
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): each document and item it holds.

    The window is the first of those most similar. Every document is compared with every
    item; items come in blocks, each a pass over the documents without a shuffle. Null and
    wordless texts or items match nothing; repeated rows of documents give repeated rows,
    items with equal texts each match. Null ids are kept. Other columns are ignored.
    """
    import pyarrow as pa

    spark = documents.sparkSession
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long"
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(F.col("text")).alias("text"))
    out = None
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            items = Items(shared.value, radius)
            for b in common.slices(batches, "text"):
                ids, found = b.column("doc_id").to_pylist(), []
                codes, ends = word_codes(b.column("text").to_pylist())
                for k in items.suspects(codes, ends).tolist():
                    start = ends[k - 1] if k else 0
                    found += [(ids[k], *m) for m in items.matches(codes[start : ends[k]], threshold)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                cols = zip(*found, strict=True) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
