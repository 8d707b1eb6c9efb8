"""Mixing sources to target weights by systematic sampling, in DataFrame code.

Each document of a source is expected target / source_size times. In a fixed order of the
source's documents those expectations are summed up from one random offset, and a document
is emitted once for each whole number its step crosses: so any stretch of a source gives its
share of copies within one. Documents are ordered by the size class (largest first, a few
classes for each doubling), then by doc_id: a class has near equal sizes, so the words taken
also come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the default mix: weights repeat over sources in code-point order.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(common.text_or_empty(text), F.lit(rf"[^{common.SPACE}]+")).cast("long")


def size_class(size: Column) -> Column:
    """Grows with the size: its bit length and its three leading bits."""
    bits = F.length(F.bin(size))
    lead = F.floor(size / F.pow(F.lit(2), F.greatest(bits - 3, F.lit(0))))
    return (bits * 8 + lead).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row for each source.

    The total, ``share`` of all sizes, is shared by weight; no target is over ``cap`` times
    its source's size, and what is over is shared again among the others. Then a target is
    the smaller of the cap and a common level times the weight: sources fill up in the order
    of cap to weight, and the level is that of the first source that isn't filled. A table
    of sources is small, one row each, so a window over all of it is no bottleneck.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("k", F.row_number().over(every) - 1).withColumn(
        "w", F.element_at(given, (F.col("k") % len(weights) + 1).cast("int"))
    )
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy(F.lit(0))
    before = Window.orderBy(F.col("cap") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("others", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("others"))
    )
    # the level of the first source, in that order, whose cap it does not pass
    w = w.withColumn("cut", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "k", "level"))).over(whole))
    level = F.col("cut")["level"]
    return w.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) for each source, from the seed."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(sized: DataFrame, seed: int = 7, **mix) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of (doc_id, source, size) rows.

    A document's place in its source is the count of rows in the blocks before it plus its
    place within its block; a block is one size class in one range of doc_id, so no source,
    however large, is sorted in one task. Null ids sort first, and such ids as very many rows
    share are dealt to their blocks by a hash of the size; rows with equal ids and sizes are
    alike. A source without words has target 0 and no copies.
    """
    spark = sized.sparkSession
    bucket, _ = common.range_bucket(sized, "doc_id", 4 * common.n_partitions(spark), F.xxhash64("size"))
    placed = common.stored(sized.withColumn("cls", size_class(F.col("size"))).withColumn("b", bucket), "mix-sizes")
    block = ["source", "cls", "b"]
    blocks = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source").orderBy(F.col("cls").desc(), "b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = blocks.join(targets(sizes, **mix).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in block], "ahead", "source_size", "target")
    inside = Window.partitionBy(*block).orderBy(F.col("doc_id").asc_nulls_first(), "size")
    joined = placed.withColumn("k", F.row_number().over(inside)).join(
        plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cls") == F.col("_cls")) & (F.col("b") == F.col("_b"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("ahead") + F.col("k")
    u = offset(F.col("source"), seed)
    crossed = F.floor(u + place * rate) - F.floor(u + (place - 1) * rate)
    return joined.select("doc_id", "source", "size", "source_size", "target", crossed.alias("copies"))


def mix_report(documents: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, copies counted) of every row."""
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return copies(sized, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(documents: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: each row of documents as often as it is taken, columns unchanged.

    Rows that share id, source and size share what these are taken, in text order.
    """
    cols = documents.columns
    rows = common.packed(
        documents, cols, F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.col("text")
    )
    taken = copies(rows.select("doc_id", "source", "size"), seed)
    taken = taken.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("taken"), F.count(F.lit(1)).alias("alike"))
    taken = taken.where("taken > 0").select(
        F.col("doc_id").alias("id"), F.col("source").alias("origin"), F.col("size").alias("words"), "taken", "alike"
    )
    taken = common.stored(taken, "mix-taken")
    same = (
        F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("origin")) & (F.col("size") == F.col("words"))
    )
    # only rows that share id, source and size have to be told apart
    w = Window.partitionBy("id", "origin", "words").orderBy("text")
    found = rows.join(taken.where("alike = 1").hint("merge"), same).select("row", F.col("taken").alias("each"))
    if not taken.where("alike > 1").isEmpty():
        found = found.unionByName(_several(rows.join(taken.where("alike > 1"), same), w))
    copy = F.explode(F.sequence(F.lit(1), F.col("each").cast("int")))
    return common.unpacked(found.select("row", copy.alias("copy")), cols)


def _several(joined: DataFrame, w) -> DataFrame:
    """Rows that share id, source and size, each with its part of what they are taken."""
    ranked = joined.withColumn("k", F.row_number().over(w))
    part = F.floor(F.col("taken") / F.col("alike")) + (F.col("k") <= F.col("taken") % F.col("alike")).cast("int")
    return ranked.select("row", part.alias("each")).where("each > 0")
