"""WARC archives of pages: an index written first, then coalesced byte-range reads.

Archives are sequences of gzip members, one record each. The index has a row for each
record: file, offset, length, URL, digest. Reads take the index rows that were selected,
sort them by file and offset, and join neighbours that lie close into one range each.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the WARC format, version 1.1.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below so many bytes are always written in full.
LEAST_REVISIT_BYTES = 1000
#: Ranges with up to GAP bytes between them are one read of at most SPAN bytes, or one record.
GAP, SPAN = 64 << 10, 8 << 20
#: Fixed value: there is no capture time in a page row, so all records bear this date.
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"


def decided(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, _d (SHA-1), _n (bytes), refers_to: the response a row revisits, or null.

    Only payloads found in several rows get a second look: their groups fold into a count
    and the largest id before the shuffle, and a group of very many rows is looked up by
    broadcast (see ``common.lookup``). Rows that repeat the response's id are responses too;
    in a group without any id nothing is revisited.
    """
    html = common.text_or_empty(F.col("html"))
    narrow = common.stored(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("_d"), F.octet_length(html).cast("long").alias("_n")
        ),
        "payload-digests",
    )
    large = narrow.where(F.col("_n") >= least)
    groups = large.groupBy("_d").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = common.lookup(narrow, common.stored(groups, "payload-groups"), "_d")
    again = F.col("first").isNotNull() & (F.col("_n") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "_d", "_n", F.when(again, F.col("first")).alias("refers_to"))


def record(page_id, url, kind, refers_to, digest: str, payload: bytes) -> bytes:
    """A record's bytes before compression. A revisit has no block."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = payload if kind == "response" else b""
    head = [
        VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    return fields, rest[:size]


def write(pages: DataFrame, folder: str, least: int = LEAST_REVISIT_BYTES, level: int = 6) -> DataFrame:
    """Write a record for each row of (page_id, url, html); the index is returned, stored.

    Null html is an empty payload, a null url an empty one. Repeated rows are repeated
    records. Other columns are ignored; an empty table writes no archive. Archives that a
    lost task left aren't in the index.
    """
    import pyarrow as pa

    plan = decided(pages, least).select(F.col("page_id").alias("_id"), F.col("_d").alias("_digest"), "refers_to").distinct()
    html = common.text_or_empty(F.col("html"))
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.sha1(html).alias("digest"), html.cast("binary").alias("html"),
    )
    joined = source.join(plan, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    joined = joined.select("page_id", "url", "digest", "refers_to", "html")

    def run(batches):
        fs, root = common.open_uri(folder)
        name, out, at = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            rows = []
            for part in common.slices([b], "html"):
                for page_id, url, digest, refers_to, payload in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    kind = "response" if refers_to is None else "revisit"
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_id, url, kind, refers_to, digest, payload)) + packer.flush()
                    out.write(data)
                    rows.append((page_id, url, kind, refers_to, digest, len(payload), name, at, len(data)))
                    at += len(data)
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in INDEX.split(", ")])
        if out:
            out.close()

    return common.stored(joined.mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[dict], gap: int = GAP, span: int = SPAN) -> Iterator[tuple[int, int, list[dict]]]:
    """(start, end, rows) of the reads for one file's rows, sorted by offset."""
    start = end = 0
    held: list[dict] = []
    for r in rows:
        stop = r["offset"] + r["length"]
        if held and (r["offset"] - end > gap or stop - start > span):
            yield start, end, held
            held = []
        if not held:
            start = r["offset"]
        held.append(r)
        end = max(end, stop) if len(held) > 1 else stop
    if held:
        yield start, end, held


def read(selected: DataFrame, folder: str) -> DataFrame:
    """The records of the selected index rows, read back and proven against their digests.

    Columns: page_id, url, record_type, refers_to, payload_digest, payload_bytes (both of
    the full payload) and the payload, null for a revisit: it is that of refers_to.
    """
    import pyarrow as pa

    n = common.n_partitions(selected.sparkSession)
    # an archive's records are cut into stretches of offsets, so that a large archive is read by many tasks
    stretch = F.floor(F.col("offset") / F.lit(SPAN))
    dealt = selected.select("file", "offset", "length").repartition(n, "file", stretch).sortWithinPartitions("file", "offset")

    def run(batches):
        fs, root = common.open_uri(folder)
        for b in batches:
            rows = b.to_pylist()
            i = 0
            while i < len(rows):
                j = i
                while j < len(rows) and rows[j]["file"] == rows[i]["file"]:
                    j += 1
                with fs.open_input_file(f"{root}/{rows[i]['file']}") as f:
                    for start, end, held in ranges(rows[i:j]):
                        f.seek(start)
                        data = memoryview(f.read(end - start))
                        yield _records(pa, data, start, held)
                i = j

    return dealt.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def _records(pa, data, start: int, rows: list[dict]):
    made = []
    number = lambda x: int(x[len("<urn:page:") : -1]) if x != "<urn:page:>" else None
    for r in rows:
        at = r["offset"] - start
        fields, block = parse(zlib.decompress(data[at : at + r["length"]], 31))
        kind, size = fields["WARC-Type"], int(fields["X-Payload-Length"])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (hashlib.sha1(block).hexdigest(), len(block)) != (digest, size):
            raise ValueError(f"page {fields['WARC-Record-ID']}: the payload isn't what was written")
        refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
        made.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, refers, digest, size, block if kind == "response" else None))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)
