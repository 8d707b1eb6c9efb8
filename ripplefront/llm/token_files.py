"""Token-id files: patched frame-of-reference blocks with an index of block starts.

A shard file holds the ids of a range of documents in ascending doc_id order:

    magic | blocks ... | tail | length of the tail (u64) | magic

Each block has up to BLOCK ids: their minimum (u32), count (u16), width (u8), number of
exceptions (u16), the low ``width`` bits of id minus minimum, packed lowest bit first, then
the exceptions' places (u16 each) and their full differences (u32 each). The width is the
one that fits the ``percentile`` of the block's differences; wider ones are exceptions. The
tail is zlib-compressed: counts, the byte offset of every block's start, the end of each
document as a number of ids, the documents' ids (i64) and a byte each, 1 for a null id. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

MAGIC = b"TFOR0001"
BLOCK = 512
#: Blocks packed or unpacked at once; bounds memory whatever a shard's size.
GROUP = 1024
HEAD = struct.Struct("<IHBH")
PERCENTILE = 90


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values, the low ``width`` bits of each, as rows of little-endian bytes."""
    rows = len(values)
    lanes = np.ascontiguousarray((values.astype(np.uint64) & np.uint64((1 << width) - 1)).reshape(-1, 64).T)
    out = np.zeros((width, lanes.shape[1]), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8).reshape(rows, -1)


def unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    """The reverse of ``pack_bits``."""
    rows, mask = len(packed), np.uint64((1 << width) - 1)
    words = np.ascontiguousarray(packed.reshape(-1, 8 * width).view("<u8").T).astype(np.uint64)
    out = np.empty((64, words.shape[1]), dtype=np.uint32)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        v = words[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | words[word + 1] << np.uint64(64 - shift)
        out[j] = v & mask
    return np.ascontiguousarray(out.T).reshape(rows, BLOCK)


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """The blocks of up to GROUP * BLOCK ids; only the last may be short."""
    n, out = len(ids), []
    rows = -(-n // BLOCK)
    padded = np.empty(rows * BLOCK, dtype=np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    v = padded.reshape(rows, BLOCK)
    least = v.min(axis=1)
    diff = v - least[:, None]
    place = (BLOCK * percentile - 1) // 100
    widths = np.frexp(np.partition(diff, place, axis=1)[:, place].astype(np.float64))[1]
    packed: list = [b""] * rows
    for w in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == w)
        for i, p in zip(at.tolist(), pack_bits(diff[at], w), strict=True):
            packed[i] = p
    row, column = np.nonzero(diff >= (np.uint64(1) << widths.astype(np.uint64))[:, None])
    if n < len(padded):
        own = row * BLOCK + column < n
        row, column = row[own], column[own]
    cuts = np.searchsorted(row, np.arange(rows + 1)).tolist()
    places, values = column.astype("<u2"), diff[row, column].astype("<u4")
    for i, (low, width, a, b) in enumerate(zip(least.tolist(), widths.tolist(), cuts[:-1], cuts[1:], strict=True)):
        count = min(BLOCK, n - i * BLOCK)
        body = bytes(packed[i][: -(-count * width // 8)])
        out.append(HEAD.pack(low, count, width, b - a) + body + places[a:b].tobytes() + values[a:b].tobytes())
    return out


def unpack_blocks(data: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks at these places, one after another."""
    raw = np.frombuffer(data, np.uint8)
    heads = [HEAD.unpack_from(data, s) for s in starts]
    out = np.zeros((len(starts), BLOCK), dtype=np.uint32)
    widths = np.array([h[2] for h in heads])
    for w in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == w)
        packed = np.zeros((len(at), BLOCK * w // 8), dtype=np.uint8)
        for k, i in enumerate(at.tolist()):
            size = -(-heads[i][1] * w // 8)
            begin = starts[i] + HEAD.size
            packed[k, :size] = raw[begin : begin + size]
        out[at] = unpack_bits(packed, w)
    for i, (_, count, width, odd) in enumerate(heads):
        if odd:
            at = starts[i] + HEAD.size - (-count * width // 8)
            out[i, np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    out += np.array([h[0] for h in heads], dtype=np.uint32)[:, None]
    counts = [h[1] for h in heads]
    return out.reshape(-1) if min(counts) == BLOCK else out[np.arange(BLOCK) < np.array(counts)[:, None]]


class Writer:
    """Appends documents' ids to an open file; memory is a group of blocks and the index."""

    def __init__(self, out, percentile: int = PERCENTILE):
        self.out, self.percentile = out, percentile
        self.at = self.total = 0
        self.blocks: list[int] = []
        self.ends: list[int] = []
        self.doc_ids: list[int | None] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        size = GROUP * BLOCK
        stop = len(ids) if rest else len(ids) // size * size
        for i in range(0, stop, size):
            for block in pack_blocks(ids[i : min(i + size, stop)], self.percentile):
                self.blocks.append(self.at)
                self._put(block)
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        self.ends.append(self.total)
        if self.n_held >= GROUP * BLOCK:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        tail = struct.pack("<QQQ", len(self.blocks), len(self.ends), self.total)
        tail += np.array(self.blocks, "<u8").tobytes() + np.array(self.ends, "<u8").tobytes()
        tail += np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + bytes(x is None for x in self.doc_ids)
        tail = zlib.compress(tail, 1)
        self._put(tail + struct.pack("<Q", len(tail)) + MAGIC)


class Reader:
    """Documents of a shard by position; only the blocks they lie in are read."""

    def __init__(self, file, size: int):
        self.file = file
        n = self._read(size - 16, 16)
        if n[8:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        length = struct.unpack("<Q", n[:8])[0]
        tail = zlib.decompress(self._read(size - 16 - length, length))
        n_blocks, n_docs, self.total = struct.unpack_from("<QQQ", tail)
        self.blocks = np.append(np.frombuffer(tail, "<u8", n_blocks, 24), size - 16 - length).astype(np.int64)
        self.ends = np.frombuffer(tail, "<u8", n_docs, 24 + 8 * n_blocks).astype(np.int64)
        at = 24 + 8 * (n_blocks + n_docs)
        missing = np.frombuffer(tail, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [None if m else int(x) for x, m in zip(np.frombuffer(tail, "<i8", n_docs, at), missing, strict=True)]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        a, b = start // BLOCK, -(-stop // BLOCK)
        if stop <= start:
            return np.zeros(0, np.uint32)
        data = self._read(int(self.blocks[a]), int(self.blocks[b] - self.blocks[a]))
        found = unpack_blocks(data, (self.blocks[a:b] - self.blocks[a]).tolist())
        return found[start - a * BLOCK : stop - a * BLOCK]

    def documents(self, group: int = GROUP * BLOCK) -> Iterator[np.ndarray]:
        """The ids of every document in order, reading about ``group`` ids at a time."""
        begins = np.concatenate(([0], self.ends[:-1]))
        i = 0
        while i < len(self.ends):
            j = max(i + 1, int(np.searchsorted(self.ends, begins[i] + group, side="right")))
            ids = self.ids(int(begins[i]), int(self.ends[j - 1]))
            for a, b in zip(begins[i:j] - begins[i], self.ends[i:j] - begins[i], strict=True):
                yield ids[a:b]
            i = j


def write_token_files(
    df: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int, folder: str, percentile: int = PERCENTILE,
    slice_bytes: int = 2 << 20,
) -> DataFrame:
    """Write ids of every whole text to files in ``folder``; their manifest is returned.

    Manifest: shard, path, n_docs, n_ids, start (ids in the shards before), in shard order.
    Documents are encoded where they are read; their ids, a few bytes each, are sent to
    shards cut by ranges of doc_id. Null ids come first, repeated ids stay repeated, in the
    order of their ids' bytes (where very many rows share an id, of their shard first, which a
    hash of the text names); null texts are empty: the end id alone. Other columns are
    ignored; an empty table writes no file. A worker encodes ``slice_bytes`` of texts at
    once: more take more memory and less time. A file a lost or repeated task left behind isn't
    in the manifest, so it is never read.
    """
    import pyarrow as pa

    spark = df.sparkSession
    tie = F.xxhash64(common.text_or_empty(F.col(text)))
    bucket, n_shards = common.range_bucket(df, doc_id, common.n_partitions(spark), tie)
    source = df.select(
        F.col(doc_id).cast("long").alias("doc_id"), bucket.alias("shard"), common.text_or_empty(F.col(text)).alias("_text")
    )

    def encode(batches):
        e = bpe.encoder(tokenizer)
        kind = "<u2" if e.vocabulary <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for b in common.slices(batches, "_text", slice_bytes):
            ids = [np.append(x, np.uint32(end_id)).astype(kind).tobytes() for x in e.encode(b.column("_text"))]
            width = pa.array(np.full(b.num_rows, int(kind[2]), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("shard"), width, pa.array(ids, pa.binary())], names=["doc_id", "shard", "width", "ids"])

    ids = source.mapInArrow(encode, "doc_id long, shard int, width int, ids binary")
    dealt = ids.repartitionById(n_shards, F.col("shard")).sortWithinPartitions(
        "shard", F.col("doc_id").asc_nulls_first(), "ids"
    )

    def write(batches):
        import uuid

        fs, root = common.open_uri(folder)
        fs.create_dir(root, recursive=True)
        shard, out, writer, doc_ids = None, None, None, 0

        def closed():
            writer.close()
            out.close()
            return pa.RecordBatch.from_pylist([{"shard": shard, "path": name, "n_docs": doc_ids, "n_ids": writer.total}], schema=kinds)

        kinds = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for b in batches:
            rows = zip(*(b.column(x).to_pylist() for x in ("shard", "doc_id", "width", "ids")), strict=True)
            for s, key, width, value in rows:
                if s != shard:
                    if writer:
                        yield closed()
                    shard, doc_ids = s, 0
                    name = f"ids-{s:06d}-{uuid.uuid4().hex}.tfor"
                    out = fs.open_output_stream(f"{root}/{name}")
                    writer = Writer(out, percentile)
                writer.add(key, np.frombuffer(value, f"<u{width}").astype(np.uint32))
                doc_ids += 1
        if writer:
            yield closed()

    made = common.stored(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_ids long"), "token-manifest")
    shards = sorted(made.collect(), key=lambda r: r["shard"])  # a row for each file
    start, rows = 0, []
    for r in shards:
        rows.append((r["shard"], r["path"], r["n_docs"], r["n_ids"], start))
        start += r["n_ids"]
    return spark.createDataFrame(rows, "shard int, path string, n_docs long, n_ids long, start long")


def read_token_files(manifest: DataFrame, folder: str, made: Callable, schema: str) -> DataFrame:
    """One row for each document of the files: shard, position, doc_id, start and what is made.

    ``made`` gets the document's ids and returns a tuple for the columns of ``schema``.
    """
    import pyarrow as pa

    spark: SparkSession = manifest.sparkSession
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        fs, root = common.open_uri(folder)
        for b in batches:
            for row in b.to_pylist():
                path = f"{root}/{row['path']}"
                with fs.open_input_file(path) as f:
                    r = Reader(f, fs.get_file_info(path).size)
                    if (len(r.ends), r.total) != (row["n_docs"], row["n_ids"]):
                        raise ValueError(f"{path} isn't what was written")
                    begins = np.concatenate(([0], r.ends[:-1])) + row["start"]
                    found, first = [], 0
                    for i, ids in enumerate(r.documents()):
                        found.append(made(ids))
                        if len(found) == 4096 or i == len(r.ends) - 1:
                            n = len(found)
                            cols = [pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.arange(first, first + n))]
                            cols += [pa.array(r.doc_ids[first : first + n], pa.int64()), pa.array(begins[first : first + n]), *map(pa.array, zip(*found, strict=True))]
                            yield pa.RecordBatch.from_arrays(cols, names=["shard", "position", "doc_id", "start", *names])
                            found, first = [], first + n

    parts = max(1, min(manifest.count(), 4 * common.n_partitions(spark)))
    full = f"shard int, position long, doc_id long, start long, {schema}"
    return manifest.repartition(parts).mapInArrow(run, full)
