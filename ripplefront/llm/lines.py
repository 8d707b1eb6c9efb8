"""Line dedup that documents can be added to and taken from again.

A line's key is the line with ASCII white space stripped and A-Z lowered, as 128 bits of
XXH3. The exact table is a ledger of postings (key, document, +1 or -1): a document that is
added writes +1 for each of its distinct keys, one that is taken away writes -1. A key's
reference count is the sum, its last holder the largest document with a sum above zero.
Sharded cuckoo filters hold the keys with enough references to be dropped; when documents
come or go only the keys that pass the threshold either way are inserted or deleted. A
text's keys are sent to their shard's tasks, which load that one filter; only the keys that
may be dropped go on to be joined with the exact table, which decides.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .cuckoo import CuckooFilter, Full

#: A shard's lookups are dealt to so many tasks, by document, so that a line that a great share
#: of all documents hold doesn't go to one task.
SPREAD = 64
KEYS = "hi long, lo long"


def line_keys(text: bytes, least_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and the 16-byte key of each, None for a line that is too short."""
    from xxhash import xxh3_128_digest

    lines = text.split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        k = line.strip().lower()  # of bytes: ASCII white space, A-Z
        long = len(k) >= least_chars and (k.isascii() or len(k.decode("utf-8", "replace")) >= least_chars)
        keys.append(xxh3_128_digest(k) if long else None)
    return lines, keys


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), dtype=">i8").reshape(-1, 2)
    return both[:, 0].astype(np.int64), both[:, 1].astype(np.int64)


class LineStore:
    """The ledger, and the filters of the keys held by at least ``min_docs`` documents.

    A row is a document, whatever its id: rows that share one count each, and all rows of the
    largest id that holds a key keep its lines. Null texts are one empty line; rows without an
    id count, but are never the largest holder, so where no holder has an id nothing is lost.
    Columns other than doc_id and text are ignored when adding and kept when rewriting.
    """

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = 3, least_chars: int = 20):
        self.spark, self.folder = spark, folder
        self.min_docs, self.least_chars = min_docs, least_chars
        self.shards = common.n_partitions(spark)
        self.batches: list[str] = []
        self.filters: dict[int, tuple[str, int]] = {}
        self.droppable: DataFrame | None = None

    # -- the exact table

    def _postings(self, docs: DataFrame, sign: int) -> DataFrame:
        import pyarrow as pa

        least = self.least_chars
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(F.col("text")).cast("binary").alias("text"))

        def run(batches):
            for b in common.slices(batches, "text"):
                found, counts = [], []
                for t in b.column("text").to_pylist():
                    keys = {k for k in line_keys(t, least)[1] if k}
                    found += keys
                    counts.append(len(keys))
                hi, lo = _halves(found)
                ids = b.column("doc_id").take(pa.array(np.repeat(np.arange(b.num_rows), counts)))
                one = pa.array(np.full(len(hi), sign, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), ids, one], names=["hi", "lo", "doc_id", "sign"])

        return source.mapInArrow(run, f"{KEYS}, doc_id long, sign int")

    def _book(self, docs: DataFrame, sign: int) -> None:
        path = f"{self.folder}/ledger-{len(self.batches)}-{uuid.uuid4().hex}"
        self._postings(docs, sign).write.parquet(path)
        self.batches.append(path)
        self._refresh()

    def add(self, docs: DataFrame) -> LineStore:
        self._book(docs, 1)
        return self

    def take_away(self, docs: DataFrame) -> LineStore:
        """Undo ``add`` for these documents: their texts must be those that were added."""
        self._book(docs, -1)
        return self

    def references(self) -> DataFrame:
        """hi, lo, refs, last: the key's documents and the largest id among them."""
        ledger = self.spark.read.schema(f"{KEYS}, doc_id long, sign int").parquet(*self.batches)
        if len(self.batches) > 1:  # a document's +1 and -1 cancel before the largest is taken
            ledger = ledger.groupBy("hi", "lo", "doc_id").agg(F.sum("sign").alias("sign")).where("sign > 0")
        return ledger.groupBy("hi", "lo").agg(F.sum("sign").alias("refs"), F.max("doc_id").alias("last"))

    # -- the filters

    def _refresh(self) -> None:
        before = self.droppable
        self.droppable = common.stored(self.references().where(F.col("refs") >= self.min_docs), "line-references")
        keys = self.droppable.select("hi", "lo")
        if before is None:
            changes = keys.withColumn("sign", F.lit(1))
        else:
            old = before.select("hi", "lo")
            changes = keys.join(old, ["hi", "lo"], "left_anti").withColumn("sign", F.lit(1)).unionByName(
                old.join(keys, ["hi", "lo"], "left_anti").withColumn("sign", F.lit(-1))
            )
        full = self._apply(changes, self.filters)
        if full:  # no room: those shards are built anew from the exact table
            again = keys.withColumn("sign", F.lit(1)).where(self._shard().isin(full))
            self._apply(again, {})

    def _shard(self):
        return F.pmod(F.col("hi"), F.lit(self.shards)).cast("int")

    def _apply(self, changes: DataFrame, present: dict[int, tuple[str, int]]) -> list[int]:
        import pyarrow as pa

        folder = self.folder
        dealt = changes.withColumn("shard", self._shard()).repartitionById(self.shards, F.col("shard"))

        def run(batches):
            fs, root = common.open_uri(folder)
            fs.create_dir(root, recursive=True)
            parts = [(b.column("shard").to_numpy(), b.column("hi").to_numpy(), b.column("sign").to_numpy()) for b in batches]
            if not parts:
                return
            shard, hi, sign = (np.concatenate(x) for x in zip(*parts, strict=True))
            for s in np.unique(shard).tolist():
                h, d = hi[shard == s].view(np.uint64), sign[shard == s]
                name, size = f"filter-{s:06d}-{uuid.uuid4().hex}.ckf", -1
                try:
                    if s in present:
                        with fs.open_input_stream(f"{root}/{present[s][0]}") as f:
                            filt = CuckooFilter.from_bytes(f.read())
                        filt.delete(h[d < 0])
                        filt.insert(h[d > 0])
                    else:
                        filt = CuckooFilter.built(h[d > 0])
                    data = filt.to_bytes()
                    size = len(data)
                    with fs.open_output_stream(f"{root}/{name}") as f:
                        f.write(data)
                except Full:
                    pass
                yield pa.RecordBatch.from_pylist([{"shard": s, "name": name, "size": size}])

        made = common.stored(dealt.mapInArrow(run, "shard long, name string, size long"), "line-filters").collect()
        self.filters.update({r["shard"]: (r["name"], r["size"]) for r in made if r["size"] >= 0})
        return [r["shard"] for r in made if r["size"] < 0]

    # -- rewriting texts

    def _hits(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text_key, hi, lo) of the lines that may have to go."""
        import pyarrow as pa

        folder, filters, shards, least = self.folder, dict(self.filters), self.shards, self.least_chars
        source = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
            common.text_or_empty(F.col("text")).cast("binary").alias("text"),
        )

        def keyed(batches):
            for b in common.slices(batches, "text"):
                found, counts = [], []
                for t in b.column("text").to_pylist():
                    keys = {k for k in line_keys(t, least)[1] if k}
                    found += keys
                    counts.append(len(keys))
                hi, lo = _halves(found)
                shard = np.mod(hi, shards).astype(np.int32)
                at = pa.array(np.repeat(np.arange(b.num_rows), counts))
                cols = [pa.array(shard), b.column("doc_id").take(at), b.column("text_key").take(at), pa.array(hi), pa.array(lo)]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", *names])

        def tested(batches):
            fs, root = common.open_uri(folder)
            held, filt = None, None
            for b in batches:
                shard, hi = b.column("shard").to_numpy(), b.column("hi").to_numpy()
                keep = np.zeros(len(hi), dtype=bool)
                for s in np.unique(shard).tolist():  # sorted by shard: one filter at a time
                    if s not in filters:
                        continue
                    if s != held:
                        with fs.open_input_stream(f"{root}/{filters[s][0]}") as f:
                            held, filt = s, CuckooFilter.from_bytes(f.read())
                    at = np.flatnonzero(shard == s)
                    keep[at] = filt.contains(hi[at].view(np.uint64))
                kept = b.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([kept.column(c) for c in names], names=names)

        names, ddl = ["doc_id", "text_key", "hi", "lo"], f"doc_id long, text_key long, {KEYS}"
        keys = source.mapInArrow(keyed, f"shard int, {ddl}")
        dealt = keys.repartition(common.n_partitions(self.spark), "shard", F.pmod("text_key", F.lit(SPREAD)))
        return dealt.sortWithinPartitions("shard").mapInArrow(tested, ddl)

    def dropped(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text_key, keys): the keys that a document's text loses."""
        hits = common.stored(self._hits(docs).withColumn("key", F.struct("hi", "lo")), "line-hits")
        known = self.droppable.select(F.struct("hi", "lo").alias("key"), "last")
        lost = common.lookup(hits, known, "key").where(
            F.col("last").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") != F.col("last")))
        )
        packed = F.struct(F.col("hi"), F.col("lo"))
        return lost.groupBy("doc_id", "text_key").agg(F.collect_set(packed).alias("keys"))

    def rewrite(self, docs: DataFrame, report: bool = False) -> DataFrame:
        """``docs`` with the kept text; or, as a report, doc_id and what became of its lines.

        The report has n_lines (before), n_dropped and kept_sha256 of the kept text.
        """
        import pyarrow as pa

        lost = self.dropped(docs).select(
            F.col("doc_id").alias("_id"), F.col("text_key").alias("_t"),
            F.col("keys.hi").alias("_hi"), F.col("keys.lo").alias("_lo"),
        )
        cols = ["doc_id"] if report else [c for c in docs.columns if c != "text"]
        text = common.text_or_empty(F.col("text"))
        source = common.packed(docs, cols, F.col("doc_id").cast("long").alias("_d"), text.cast("binary").alias("_text"), F.xxhash64("text").alias("_k"))
        same = F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_t"))
        joined = source.join(lost, same, "left").select("row", "_text", "_hi", "_lo")
        least = self.least_chars

        def run(batches):
            for b in common.slices(batches, "_text"):
                texts, made = [], []
                for t, hi, lo in zip(*(b.column(c).to_pylist() for c in ("_text", "_hi", "_lo")), strict=True):
                    n, gone = t.count(b"\n") + 1, 0
                    if hi:
                        pairs = np.stack([hi, lo], axis=1).astype(">i8").tobytes()
                        out = {pairs[i : i + 16] for i in range(0, len(pairs), 16)}
                        lines, keys = line_keys(t, least)
                        kept = [x for x, k in zip(lines, keys, strict=True) if k not in out]
                        gone = n - len(kept)
                        t = b"\n".join(kept)
                    texts.append(t)
                    made.append((n, gone, hashlib.sha256(t).hexdigest()) if report else ())
                added = map(pa.array, zip(*made, strict=True)) if report else [pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([b.column("row"), *added], names=["row", *names])

        from pyspark.sql.types import StructType

        ddl = "n_lines long, n_dropped long, kept_sha256 string" if report else "text string"
        names = [x.split()[0] for x in ddl.split(", ")]
        schema = StructType([source.schema["row"], *StructType.fromDDL(ddl).fields])
        out = common.unpacked(joined.mapInArrow(run, schema), cols, *names)
        return out if report else out.select(*docs.columns)
