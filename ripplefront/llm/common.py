"""Shared helpers: scratch tables, range buckets, word rules, remote files."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regex class of the white space that separates words and is stripped from lines.
SPACE = r"\x20\x09-\x0D"

_own_scratch: dict[str, str] = {}
_written: list[str] = []
_reclaimed: dict[str, float] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where it is unset, and the master is local, a folder of our own is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        folder = tempfile.mkdtemp(prefix="ripplefront-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_scratch[app] = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(_own_scratch[app])
    return _own_scratch[app]


def scratch_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new path in the shared folder; what is written to a lasting one is never cleared away."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not lasting:
        _written.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this process; results not yet read are lost."""
    for path in list(_written):
        delete_path(spark, path)


@contextmanager
def scratch(spark: SparkSession):
    """Scratch tables written inside the block go at its end, but for those it keeps."""
    before, kept = set(_written), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.scratch)
        return df

    yield keep
    for path in [p for p in _written if p not in before and p not in kept]:
        delete_path(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_stored(df: DataFrame) -> None:
    delete_path(df.sparkSession, df.scratch)


def reclaim(spark: SparkSession, every: float = 5.0) -> None:
    """Let shuffles and broadcasts that no frame needs any more leave the disks, and garbage the driver.

    Spark deletes them once the driver's JVM happens to collect the plans that hold them, which a
    large heap may put off for long, while every next step adds its own. Python tells the JVM of
    frames that are gone by a thread that sleeps a second at a time: it is waited for. A call
    within ``every`` seconds of the last does nothing.
    """
    if time.monotonic() - _reclaimed.get("at", -every) < every:
        return
    gc.collect()
    untold, until = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ()), time.monotonic() + 2
    while untold and time.monotonic() < until:
        time.sleep(0.05)
    spark.sparkContext._jvm.System.gc()
    _reclaimed["at"] = time.monotonic()


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def held_out(doc_id: str) -> Column:
    """True where crc32 of the id's text leaves no remainder modulo 5; null ids: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


LEAST, MOST = -(1 << 63), (1 << 63) - 1


def range_bucket(df: DataFrame, key: str, n: int, tie: Column | None = None, segments: int = 64) -> tuple[Column, int]:
    """A monotone bucket number of an integer key, and how many buckets there are (about ``n``).

    Quantile bounds cut the key into at most ``segments`` segments; each is cut evenly into
    as many parts as ``n`` buckets need. Nulls sort first. A value that holds over one
    segment, and nulls that do, have buckets of their own: with ``tie``, a hash of the row,
    as many as their share asks for, each row in the one its hash names. Bounds are exact
    integers, not a partitioner's sample, so a row's bucket is the same in every job. Any
    longs do; differences are taken within 62 bits only.
    """
    k = max(1, min(segments, n))
    c = F.col(key).cast("long")
    probs = F.array(*[F.lit(i / k) for i in range(k + 1)])
    found = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(c).alias("known"), F.min(c).alias("low"), F.max(c).alias("high"),
        F.percentile_approx(c, probs, F.lit(1000)).alias("q"),
    ).first()
    nulls = found["rows"] - found["known"]
    spread = lambda share: max(1, round(share * n)) if tie is not None else 1
    none_parts = spread(nulls / found["rows"]) if nulls else 1
    pieces = _pieces(found, k, n, spread) if found["known"] else []
    total = none_parts + sum(parts for *_, parts, _ in pieces)
    dealt = lambda parts: F.pmod(tie, F.lit(parts)) if parts > 1 else F.lit(0)

    def within(i: int) -> Column:
        low, high, parts, one = pieces[i]
        before = F.lit(none_parts + sum(p[2] for p in pieces[:i]))
        if one:
            return before + dealt(parts)
        inside = F.greatest(F.lit(low), F.least(F.lit(high), c)) - F.lit(low)
        width = (high - low + 1) / parts
        return before + F.least(F.lit(parts - 1), F.floor(inside / F.lit(width)))

    def pick(a: int, b: int) -> Column:
        if b - a == 1:
            return within(a)
        m = (a + b) // 2
        return F.when(c < F.lit(pieces[m][0]), pick(a, m)).otherwise(pick(m, b))

    none = dealt(none_parts)
    if not pieces:
        return none.cast("int"), total
    return F.when(c.isNull(), none).otherwise(pick(0, len(pieces))).cast("int"), total


def _pieces(found, k: int, n: int, spread) -> list[tuple[int, int, int, bool]]:
    """(first, last, parts, whether it is one value) of each piece, in order, without gaps."""
    low, high = found["low"], found["high"]
    bounds = [min(max(int(q), low), high) for q in found["q"]]
    cuts = sorted({low, high, *bounds})
    per = max(1, -(-n // k))
    out = []

    def stretch(a: int, z: int) -> None:
        if a > z:
            return
        if z - a >= 1 << 62:
            middle = (a + z) // 2
            stretch(a, middle)
            stretch(middle + 1, z)
        else:
            out.append((a, z, min(per, z - a + 1), False))

    for i, v in enumerate(cuts):
        times = bounds.count(v)
        hot = times > 1 and v != high or times > 2 or low == high
        upto = cuts[i + 1] - 1 if i + 1 < len(cuts) else v
        if hot:
            out.append((v, v, spread((times - 1) / k), True))
            stretch(v + 1, upto)
        else:
            stretch(v, upto)
    return out


def open_uri(uri: str):
    """(filesystem, path) of a folder that executors share; any scheme pyarrow knows."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def lookup(rows: DataFrame, found: DataFrame, key: str, shares: int = 1000) -> DataFrame:
    """``rows`` left joined with ``found``, which has each key once; the key may be skewed.

    Keys that more than 1/``shares`` of all rows hold number under ``shares``, whatever the
    input: their entries are broadcast, and the other rows are joined by a shuffle.
    ``rows`` is read twice, so let it be a stored table.
    """
    counts = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") > max(100, total // shares)).select(key)
    entries = found.join(F.broadcast(hot), key, "left_semi")
    usual = rows.join(F.broadcast(hot), key, "left_anti").join(found, key, "left")
    heavy = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(entries), key, "left")
    return usual.unionByName(heavy)


def packed(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """The columns as one struct ``row``, safe from clashes of names, and further columns."""
    inner = [df[f"`{c}`"] for c in columns] or [F.lit(0).alias("_")]
    return df.select(F.struct(*inner).alias("row"), *more)


def unpacked(df: DataFrame, columns: list[str], *made: str) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns], *made)


class Carried:
    """Rows on their way through a Python function that adds columns made from a text.

    ``keep`` are the columns to give back (default: all); those named like an added one,
    in any case of letters, are replaced. The text travels once.
    """

    def __init__(self, df: DataFrame, text: str, made: str, keep: list[str] | None = None):
        self.made = [x.split()[0] for x in made.split(", ")]
        taken = {m.lower() for m in self.made}
        self.keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
        self.place = self.keep.index(text) if text in self.keep else None
        more = [] if self.place is not None else [df[f"`{text}`"].cast("string").alias("text")]
        self.source = packed(df, self.keep, *more)
        self.ddl = made

    def texts(self, batch):
        """The batch's texts, null ones as empty ones."""
        import pyarrow.compute as pc

        column = batch.column("text") if self.place is None else batch.column("row").flatten()[self.place]
        return pc.fill_null(column, "")

    def through(self, function, max_bytes: int = 1 << 20) -> DataFrame:
        """``function`` gets an Arrow array of texts and returns an Arrow array for each added column."""
        import pyarrow as pa
        from pyspark.sql.types import StructType

        schema = StructType([self.source.schema["row"], *StructType.fromDDL(self.ddl).fields])
        names = ["row", *self.made]

        def run(batches):
            for b in slices(batches, self.texts, max_bytes):
                yield pa.RecordBatch.from_arrays([b.column("row"), *function(self.texts(b))], names=names)

        holder = self.source
        del self.source  # a frame can't travel with the function
        return unpacked(holder.mapInArrow(run, schema), self.keep, *self.made)


def give_back() -> None:
    """Return freed memory of a Python worker, which lives on for later tasks, to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches, column, max_bytes: int = 1 << 20):
    """The batches, cut so that a column's texts take at most ``max_bytes``, or one row.

    ``column`` is a name, or a function of a batch.
    """
    import numpy as np
    import pyarrow.compute as pc

    get = column if callable(column) else lambda b: b.column(column)
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(get(b)), 0), dtype=np.int64))
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield b.slice(start, stop - start)
            start = stop
    give_back()
