"""Near-duplicates by exact similarity: no pair that reaches the threshold is missed.

The similarity is shared over joint shingles of five words, each counted once; words are
those of ``decontaminate``. Texts with equal shingles are one entry. Each entry has a
SimHash of its shingles; links come from the byte-position index of ``simhash``, and are
verified exactly. At a similarity of 0.8 about 10 of 64 bits differ, which may spoil all 8
bytes, so no count of shared bytes is guaranteed there: what lies beyond the index's radius
is found by a prefix filter. Each entry lists the first of its shingles in an order all
entries keep: of n shingles, so many that two entries as similar as the threshold share at
least SHARED listed ones. Any order does; frequent shingles, told from a sample, come last,
so that lists stay short. A pair that has to share ``need`` of its n and m shingles has the
first SHARED of them among its first n - need + SHARED and m - need + SHARED, as those that
follow must hold the rest: only places up to there count for it. (If need is less, that many.)
So members of a group that are too unlike, whose own rare shingles fill these places, yield
no rows, though they share many frequent ones. Pairs that share so many there, and that
sizes and places don't rule out, are compared.

Only components count: pairs already in one component aren't tried again. So a group of near
copies isn't all pairs: first the SimHash links join its members; then, in long lists, each
entry in another component is compared with the CENTRES members that are in the most long
lists, as what a group's members vary from has the most of what they share; what is in
different components after that is compared in full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components
from .decontaminate import SHINGLE_WORDS, THRESHOLD, among, shingles, word_codes

#: Documents from which frequent shingles are told, and in how many of them those are.
SAMPLE_DOCS, FREQUENT = 20_000, 4
#: Listed shingles that a pair has to share.
SHARED = 6
#: Members from which a list is long, and with how many of them all its members are compared first.
LONG, CENTRES = 200, 4
#: The filter of rows whose texts are compared has at most so many bits (16 MB).
FILTER_BITS = 1 << 27


def shingle_sets(texts: list[str]):
    """The sorted distinct shingles of each text; a wordless text's one is of its characters."""
    from xxhash import xxh3_64_intdigest

    codes, ends = word_codes(texts)
    every, start = shingles(codes), 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        if end - start >= SHINGLE_WORDS:
            yield np.unique(every[start : end - SHINGLE_WORDS + 1])
        elif end > start:
            yield shingles(codes[start:end])
        else:
            yield np.array([xxh3_64_intdigest(text.strip().encode(), 1)], dtype=np.uint64)
        start = end


def n_listed(n, threshold: float):
    """How many of n shingles are listed."""
    return np.minimum(n, n - np.ceil(threshold * np.asarray(n) - 1e-6) + SHARED).astype(np.int64)


def listed(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray, threshold: float) -> np.ndarray:
    """The first shingles in the common order, as many as the threshold asks for."""
    take = int(n_listed(len(own), threshold))
    late = among(own, frequent)
    if not late.any():
        return own[:take]
    last = own[late]
    return np.concatenate((own[~late], last[np.argsort(rank[np.searchsorted(frequent, last)])]))[:take]


def _frequent(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and the rank of each, the rarest first."""
    import pyarrow as pa

    def run(batches):
        for b in common.slices(batches, "text"):
            found = [np.zeros(0, np.uint64), *shingle_sets(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["key"])

    lot = F.pmod("x", F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_DOCS / max(1, total)))
    counts = rows.where(lot).select("text").mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= FREQUENT)
    got = counts.orderBy(F.desc("count"), "key").limit(1_000_000).toPandas()
    keys, n = got["key"].to_numpy(np.int64).view(np.uint64), got["count"].to_numpy(np.int64)
    order = np.argsort(keys)
    rank = np.empty(len(keys), dtype=np.int64)
    rank[np.lexsort((keys, n))] = np.arange(len(keys))
    return keys[order], rank[order]


def _lists(batches, names: list[str]):
    """Columns of each run of rows with one key, for runs of two rows or more."""
    held = None
    for b in batches:
        cols = [b.column(c).to_numpy() for c in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        keys = cols[0]
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.array([0])
        for i in np.flatnonzero(np.diff(cuts)[:-1] > 1).tolist():
            yield [c[cuts[i] : cuts[i + 1]] for c in cols]
        held = [c[cuts[-2] :] for c in cols] if len(keys) else held
    if held is not None and len(held[0]) > 1:
        yield held


def _centred(lists: DataFrame, threshold: float) -> DataFrame:
    """(a, b): each list's members, and the few of them in most lists, if in different classes.

    These are a first choice of pairs, a few for each listed shingle, not all that may link.
    """
    import pyarrow as pa

    names = ["key", "g", "n", "class", "w"]

    def run(batches):
        for _, g, n, c, w in _lists(batches, names):
            for at in np.lexsort((g, -w))[:CENTRES].tolist():
                near = np.minimum(n, n[at]) >= threshold * np.maximum(n, n[at]) - 1e-6
                b = g[near & (c != c[at])]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(b, g[at])), pa.array(np.maximum(b, g[at]))], names=["a", "b"])

    often = lists.groupBy("g").agg(F.count(F.lit(1)).alias("w"))
    dealt = lists.join(often, "g").select(*names).repartition(common.n_partitions(lists.sparkSession), "key")
    return dealt.sortWithinPartitions("key").mapInArrow(_joined(run), "a long, b long").distinct()


def _tried(lists: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs in different classes that share enough and may reach the threshold."""
    import pyarrow as pa

    names = ["key", "g", "n", "i", "class"]

    def run(batches):
        out, held = [], 0
        for _, g, n, i, c in _lists(batches, names):
            if (c == c[0]).all():
                continue
            order = np.argsort(n, kind="stable")
            g, n, i, c = g[order], n[order].astype(np.int64), i[order].astype(np.int64), c[order]
            tops = np.searchsorted(n, n / threshold + 1e-6, side="right")
            for k, top in enumerate(tops.tolist()):
                near = slice(k + 1, top)
                need = np.ceil(threshold / (1 + threshold) * (n[k] + n[near]) - 1e-6).astype(np.int32)
                left, others = n[k] - i[k], n[near] - i[near]
                # of what stands before the shared shingle, and from it on, the shorter part at most
                ok = (c[near] != c[k]) & (np.minimum(i[k], i[near]) + np.minimum(left, others) >= need)
                # one of the first SHARED that they share: from it on, all the others are left
                ok &= np.minimum(left, others) > need - SHARED
                if ok.any():
                    b = g[near][ok]
                    out.append((np.minimum(g[k], b), np.maximum(g[k], b), np.minimum(need[ok], SHARED).astype(np.int32)))
                    held += len(b)
                if held > 1 << 16:
                    yield _pairs(out)
                    out, held = [], 0
        if out:
            yield _pairs(out)

    def _pairs(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b", "need"])

    dealt = lists.select(*names).repartition(common.n_partitions(lists.sparkSession), "key").sortWithinPartitions("key")
    pairs = dealt.mapInArrow(run, "a long, b long, need int")
    counted = pairs.groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("shared"))
    return counted.where("shared >= need").select("a", "b")


def _verified(pairs: DataFrame, entries: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs that reach the threshold; the texts of their entries are fetched."""
    spark = entries.sparkSession
    with common.scratch(spark) as keep:
        links = keep(_verify(common.stored(pairs, "similar-pairs"), entries, rows, threshold))
    common.reclaim(spark)
    return links


def _row_key(doc_id, x):
    return F.xxhash64(F.lit("similar"), doc_id, x)


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the column ``h``, at h modulo the number of bits, as bytes.

    About 16 bits a key, FILTER_BITS at most: with more keys than that suits, more rows that
    aren't asked for pass, and go in the join that follows.
    """
    n = max(1, keys.count())
    bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * n - 1).bit_length()))
    at = keys.select(F.pmod("h", F.lit(bits)).alias("at"))
    # bit_position counts from 0, bucket_number from 1, in buckets of 32,768 bits from value 1 on
    parts = at.select(F.bitmap_bucket_number(F.col("at") + 1).alias("k"), F.bitmap_bit_position(F.col("at") + 1).alias("p"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts.groupBy("k").agg(F.bitmap_construct_agg("p").alias("map")).toArrow().to_pylist():
        own = np.frombuffer(r["map"], dtype=np.uint8)
        out[(r["k"] - 1) * 4096 : (r["k"] - 1) * 4096 + len(own)] = own
    return out


def _passed(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which values have their bit set."""
    at = h % (8 * len(filter_))
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _verify(pairs: DataFrame, entries: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    import pyarrow as pa

    spark = entries.sparkSession
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("g")).distinct().join(entries, "g")
    wanted = common.stored(wanted.select(_row_key("least.doc_id", "least.x").alias("h")), "similar-wanted")
    shared_filter = spark.sparkContext.broadcast(_filter_of(wanted))

    def asked(batches):
        for b in batches:
            yield b.filter(pa.array(_passed(shared_filter.value, b.column("h").to_numpy())))

    def whole(batches):
        from xxhash import xxh3_64_intdigest

        for b in common.slices(asked(batches), "text"):
            own = list(shingle_sets(b.column("text").to_pylist()))
            g = np.array([xxh3_64_intdigest(p.tobytes()) for p in own], dtype=np.uint64).view(np.int64)
            ends = np.concatenate(([0], np.cumsum([len(p) for p in own]))).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["g", "own"])

    # only what is asked for is shuffled, not all texts; rows repeated under one id have equal texts
    texts = rows.select(_row_key("doc_id", "x").alias("h"), "text")
    sets = common.stored(texts.mapInArrow(whole, "g long, own array<long>").dropDuplicates(["g"]), "similar-sets")
    common.reclaim(spark)
    # pairs grow with the input: joined by shuffles at every size
    one, two = (sets.select(F.col("g").alias(c), F.col("own").alias(f"own_{c}")) for c in "ab")
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    shared, sizes = F.size(F.array_intersect("own_a", "own_b")), F.size("own_a") + F.size("own_b")
    return common.stored(both.where(shared >= F.lit(threshold) * (sizes - shared) - F.lit(1e-9)).select("a", "b"), "similar-links")


def representatives(df: DataFrame, doc_id: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, x, copies): of each component of near-duplicates the row with the smallest id.

    ``x`` is XXH64 of the text, a null one being empty; ``copies`` says how many rows have
    this id and ``x``. Components are of texts: rows of no or the same id stay apart if
    their texts are unlike. A null id represents a component only if all its ids are null.
    """
    import pyarrow as pa

    spark = df.sparkSession
    body = common.text_or_empty(F.col(text).cast("string"))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("x"), body.alias("text"))
    total = rows.count()
    shared = spark.sparkContext.broadcast(_frequent(rows, total))
    common.reclaim(spark)

    def made(batches):
        from xxhash import xxh3_64_intdigest

        frequent, rank = shared.value
        for b in common.slices(batches, "text"):
            g, fp, n, first = [], [], [], []
            for own in shingle_sets(b.column("text").to_pylist()):
                g.append(xxh3_64_intdigest(own.tobytes()))
                fp.append(simhash.majority(own[i : i + simhash.CHUNK] for i in range(0, len(own), simhash.CHUNK)))
                n.append(len(own))
                first.append(listed(own, frequent, rank, threshold))
            ends = np.concatenate(([0], np.cumsum([len(p) for p in first]))).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)
            signed = [pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for v in (g, fp)]
            arrays = [*signed, pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("x"), *arrays], names=["doc_id", "x", "g", "fp", "n", "first"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = common.stored(rows.mapInArrow(made, f"doc_id {kind}, x long, g long, fp long, n int, first array<long>"), "similar")
    # the row whose text stands for an entry, and the smallest id of it
    by = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x")
    entries = common.stored(found.groupBy("g").agg(F.min(by).alias("least"), F.min("fp").alias("fp")), "similar-entries")

    # rows of an entry list the same
    postings = found.select("g", "n", "first").dropDuplicates(["g"]).select("g", "n", F.posexplode("first").alias("i", "key"))

    def several(batches):
        for key, g, n, i in _lists(batches, ["key", "g", "n", "i"]):
            size = np.full(len(key), len(key), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, g, n, i, size)], names=["key", "g", "n", "i", "size"])

    dealt = postings.select("key", "g", "n", "i").repartition(common.n_partitions(spark), "key").sortWithinPartitions("key")
    lists = common.stored(dealt.mapInArrow(_joined(several), "key long, g long, n int, i int, size int"), "similar-lists")

    common.reclaim(spark)

    classes = _classes(_verified(_hashed(entries).distinct(), entries, rows, threshold))
    long = lists.where(F.col("size") > LONG)
    if not long.isEmpty():
        classes = _classes(_verified(_centred(_classed(long, classes), threshold), entries, rows, threshold), classes)
    classes = _classes(_verified(_tried(_classed(lists, classes), threshold), entries, rows, threshold), classes)
    found_in = classes.withColumnRenamed("class", "component")

    least = entries.join(found_in, "g", "left").groupBy(F.coalesce("component", "g").alias("component")).agg(F.min("least").alias("least"))
    won = least.select(F.col("least.doc_id").alias("id"), F.col("least.x").alias("y"))
    copies = found.groupBy("doc_id", "x").agg(F.count(F.lit(1)).alias("copies"))
    return copies.join(won.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("x") == F.col("y")), "left_semi")


def _classes(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(g, class): the component of each linked entry; ``before`` are those that earlier links made.

    Earlier components come as a link from each member to the smallest, which settles at once.
    """
    if before is not None:
        links = links.unionByName(before.select(F.col("g").alias("a"), F.col("class").alias("b")))
    found = components(links, "a", "b").select(F.col("node").alias("g"), F.col("component").alias("class"))
    return common.stored(found, "similar-classes")


def _classed(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """The lists with the component, so far, of each entry as ``class``."""
    return lists.join(classes, "g", "left").withColumn("class", F.coalesce("class", "g"))


def _hashed(entries: DataFrame) -> DataFrame:
    """(a, b): entries whose SimHashes are equal or linked, as a forest."""
    first = common.stored(entries.groupBy("fp").agg(F.min("g").alias("first")), "similar-fps")
    same = common.lookup(entries.select("g", "fp"), first, "fp").where("g <> first").select("g", "first")
    pairs = common.stored(simhash.links(first.select("fp")), "similar-fp-links")
    one = common.stored(common.lookup(pairs.withColumnRenamed("a", "fp"), first, "fp").select(F.col("first").alias("g"), F.col("b").alias("fp")), "similar-fp-links")
    across = common.lookup(one, first, "fp").select("g", "first")
    return same.unionByName(across).select(F.least("g", "first").alias("a"), F.greatest("g", "first").alias("b"))


def _joined(function, rows: int = 1 << 16):
    """The function's many small batches as fewer of about ``rows`` rows."""
    import pyarrow as pa

    def run(batches):
        held, n = [], 0
        for b in function(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run
