"""SimHash near-duplicates through an inverted index of byte positions.

A fingerprint is 8 bytes. At most 4 differing bits spoil at most 4 of them, so two linked
fingerprints share at least 4 bytes in place: that is the count a pair must reach. Postings
hold 3 positional bytes at once, one less than the count, a posting for each of the 56
choices of positions. In a posting list the bytes that each pair shares are tallied, all 8
positions of them; pairs below the count are dropped, the others are verified by their true
distance. (Postings of single bytes would tally every pair of fingerprints 1/32 times on the
average, which grows with the square of the input; a pair of unlike ones is met in a list of
three bytes 1/300,000 times.) Long lists are searched breadth first: what is reached leaves
the list, and only the tree of links is kept. Equal fingerprints are one entry, so a group
of copies has no pairs, and a list of near copies yields fewer links than members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Shingle hashes whose bits are counted at once; bounds the memory of very long texts.
CHUNK = 1 << 15
#: Posting lists up to this size are compared pair by pair, many lists at once.
SMALL = 8
#: Posting lists beyond this size are parted by one more positional byte before the search.
LARGE = 4096


def shingle_hashes(text: bytes, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of the lower-cased words, in chunks; none for no words."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not found:
        return
    if len(found) <= words:
        yield np.array([xxh64_intdigest(b" ".join(found), seed)], dtype=np.uint64)
        return
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1]
    ends = ends[words - 1 :]
    for i in range(0, len(starts), CHUNK):
        spans = zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist(), strict=True)
        yield np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each of the 64 bits is set, lowest bit first."""
    out = np.zeros(64, dtype=np.int64)
    full = len(hashes) // 255 * 255
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    if full:
        out += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out + bits[full:].sum(axis=0, dtype=np.int64)


def majority(chunks) -> int:
    """The bits set in over half of all hashes; no hashes: zero."""
    total, votes = 0, np.zeros(64, dtype=np.int64)
    for h in chunks:
        total += len(h)
        votes += bit_counts(h)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0]) if total else 0


def simhash(text: bytes, words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if set in over half of the shingle hashes; no words: zero."""
    return majority(shingle_hashes(text, words, seed))


def fingerprinted(df: DataFrame, text: str, words: int = 4, seed: int = 42) -> DataFrame:
    """``df`` without the text, with its 64-bit fingerprint in ``fp`` (a signed long)."""
    import pyarrow as pa

    def made(texts):
        fps = [simhash(t, words, seed) for t in texts.cast(pa.large_binary()).to_pylist()]
        return (pa.array(np.array(fps, dtype=np.uint64).view(np.int64)),)

    return common.Carried(df, text, "fp long", [c for c in df.columns if c != text]).through(made)


def postings(fps: DataFrame, at_once: int) -> DataFrame:
    """(key, fp): for each choice of ``at_once`` byte positions, the fingerprint's bytes at them."""
    masks = []
    for at in combinations(range(8), at_once):
        mask = sum(0xFF << (8 * p) for p in at)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    kinds = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(masks)])
    each = fps.select("fp", F.explode(kinds).alias("p"))
    return each.select(F.xxhash64("p.k", F.col("fp").bitwiseAND(F.col("p.m"))).alias("key"), "fp")


def tally(apart: np.ndarray) -> np.ndarray:
    """How many positional bytes each pair shares, given the two fingerprints' exclusive or."""
    return (np.ascontiguousarray(apart).view(np.uint8).reshape(*apart.shape, 8) == 0).sum(axis=-1)


def linked(apart: np.ndarray, max_bits: int, min_shared: int) -> np.ndarray:
    """Which pairs reach the count of shared bytes and then lie within the distance."""
    out = tally(apart) >= min_shared
    out[out] = np.bitwise_count(apart[out]) <= max_bits
    return out


def tree(fps: np.ndarray, max_bits: int, min_shared: int) -> list[tuple[int, int]]:
    """Links that connect the list's fingerprints just as all links within ``max_bits`` do."""
    if len(fps) > LARGE:
        common_bits = np.bitwise_or.reduce(fps ^ fps[0])
        varied = [p for p in range(8) if int(common_bits) >> (8 * p) & 0xFF]
        if 8 - len(varied) < min_shared:  # linked ones share one more byte: search by each
            out = []
            for p in varied:
                byte = (fps >> np.uint64(8 * p)) & np.uint64(0xFF)
                order = np.argsort(byte, kind="stable")
                cuts = np.flatnonzero(np.diff(byte[order])) + 1
                for part in np.split(fps[order], cuts):
                    out += tree(part, max_bits, min_shared)
            return out
    rest, out = fps, []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = linked(rest ^ at, max_bits, min_shared)
            if near.any():
                found = rest[near]
                out += [(int(at), int(x)) for x in found]
                frontier += list(found)
                rest = rest[~near]
    return out


def _pairs_of(values: np.ndarray, starts: np.ndarray, size: int, max_bits: int, min_shared: int) -> np.ndarray:
    """The links within each of many lists of one small size."""
    rows = values[starts[:, None] + np.arange(size)]
    i, j = np.triu_indices(size, 1)
    a, b = rows[:, i], rows[:, j]
    near = linked(a ^ b, max_bits, min_shared)
    return np.stack((a[near], b[near]), axis=1)


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): links of 1 to ``max_bits`` bits that connect the fingerprints as all such links do."""
    import pyarrow as pa

    min_shared = 8 - max_bits
    if not 1 <= min_shared <= 7:
        raise ValueError("max_bits is 1 to 7")
    distinct = fps.select("fp").distinct()
    dealt = postings(distinct, max(1, min_shared - 1)).repartition(common.n_partitions(fps.sparkSession), "key")

    def run(batches):
        held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            keys = np.concatenate((held_keys, b.column("key").to_numpy()))
            values = np.concatenate((held, b.column("fp").to_numpy().view(np.uint64)))
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # sorted: the last list may go on
            yield from _found(keys[:last], values[:last])
            held_keys, held = keys[last:], values[last:]
        yield from _found(held_keys, held)

    def _found(keys, values):
        starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1)) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        out = [_pairs_of(values, starts[sizes == n], n, max_bits, min_shared) for n in range(2, SMALL + 1) if (sizes == n).any()]
        for i in np.flatnonzero(sizes > SMALL).tolist():
            found = tree(values[starts[i] : starts[i] + sizes[i]], max_bits, min_shared)
            out.append(np.array(found, dtype=np.uint64).reshape(-1, 2))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
        if len(pairs):
            pairs = pairs.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return dealt.sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    df: DataFrame, doc_id: str, text: str, words: int = 4, seed: int = 42, max_bits: int = 4
) -> DataFrame:
    """(doc_id, fp, component_id) for every row.

    component_id is the smallest id reachable over links of at most ``max_bits`` differing
    bits, the row's own included. Null and empty texts, and those of blanks only, have
    fingerprint zero and link like any other. Repeated ids stay repeated rows; a null id
    stays null and is never a component's id unless all ids of the component are null.
    Other columns are ignored; an empty table gives an empty one.
    """
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fps = common.stored(fingerprinted(source, "text", words, seed), "simhash")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = common.stored(components(links(fps, max_bits), "a", "b"), "simhash-components")
    grouped = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    grouped = common.stored(grouped, "simhash-groups")
    ids = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    # a component may hold a great share of all fingerprints
    classes = common.stored(common.lookup(grouped, ids, "component").select("fp", "component_id"), "simhash-classes")
    return common.lookup(fps, classes, "fp").select("doc_id", "fp", "component_id")
