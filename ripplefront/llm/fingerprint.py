"""Document fingerprints: canonical exact digests, proven by byte comparison.

Everything here is DataFrame code. A text's canonical form is NFKC, then Unicode's full case
folding, NFKC again, with each run of white space made one blank and the ends stripped. The digest is 128 bits wide: two XXH64 values, the second one seeded by another.
Texts that share a digest are compared byte by byte; should two different canonical texts
share one, those after the smallest get ``-1``, ``-2`` ... appended, in byte order. So two
fingerprints are equal exactly if the canonical texts are. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Up to so many digests held by several rows are broadcast as a filter; more are joined.
BROADCAST_DIGESTS = 100_000


def canonical(text: Column) -> Column:
    t = common.text_or_empty(text)
    nfkc = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = nfkc(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(t), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(canon: Column, chars: int = 32) -> Column:
    """The first ``chars`` hexadecimal digits of the 128-bit digest."""
    low = F.xxhash64(canon)
    high = F.xxhash64(F.lit("wide"), canon)
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(part(low), part(high)).substr(1, chars)


def shared(digests: DataFrame) -> DataFrame:
    """The digests found more than once."""
    return digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")


def among(rows: DataFrame, keys: DataFrame, on: str, n_keys: int) -> DataFrame:
    """Rows whose ``on`` is among the keys; a broadcast only where the keys are few."""
    keys = keys.select(on).distinct()
    return rows.join(F.broadcast(keys) if n_keys <= BROADCAST_DIGESTS else keys, on, "left_semi")


def collisions(members: DataFrame) -> DataFrame:
    """(digest, canon, ordinal) of the canonical texts that share a digest with another text.

    ``members`` has digest and canon. Equal texts fold into a minimum and a maximum before
    the shuffle, so a large group of copies is a few rows; the bytes are compared there.
    """
    uneven = (
        members.groupBy("digest")
        .agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("digest")
    )
    uneven = common.stored(uneven, "uneven-digests")
    if uneven.isEmpty():  # as ever, but for a collision: then no member is sent to its digest's task
        return uneven.select("digest", F.lit("").alias("canon"), F.lit(0).alias("ordinal"))
    texts = members.join(uneven, "digest", "left_semi").select("digest", "canon").distinct()
    w = Window.partitionBy("digest").orderBy("canon")
    return texts.select("digest", "canon", (F.row_number().over(w) - 1).alias("ordinal"))


def with_ordinal(digest_col: Column, ordinal: Column) -> Column:
    return F.when(F.coalesce(ordinal, F.lit(0)) > 0, F.concat(digest_col, F.lit("-"), ordinal)).otherwise(digest_col)


def fingerprints(df: DataFrame, text: str, chars: int = 32) -> DataFrame:
    """``df`` with a column ``fingerprint`` of the text column; other columns are kept.

    Nulls fingerprint as empty texts. An empty table gives an empty table. A column of
    ``df`` named fingerprint is replaced.
    """
    cols = [c for c in df.columns if c.lower() != "fingerprint"]
    canon = canonical(df[f"`{text}`"])
    made = common.packed(df, cols, canon.alias("canon")).withColumn("digest", digest(F.col("canon"), chars))
    keys = common.stored(shared(made.select("digest")), "shared-digests")
    members = among(made.select("digest", "canon"), keys, "digest", keys.count())
    clash = common.stored(collisions(members), "digest-collisions")
    if clash.isEmpty():
        return common.unpacked(made.withColumnRenamed("digest", "fingerprint"), cols, "fingerprint")
    key = clash.select("digest", F.sha2("canon", 256).alias("sha"), "ordinal")
    found = made.withColumn("sha", F.sha2("canon", 256)).join(key, ["digest", "sha"], "left")
    return common.unpacked(found.withColumn("fingerprint", with_ordinal(F.col("digest"), F.col("ordinal"))), cols, "fingerprint")


def successors(docs: DataFrame, made: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Each row of (doc_id, text), with the columns ``made`` adds, and those of the row after it as next_*.

    The order is doc_id, nulls first, then text; rows of an id that very many share, or
    without one, are first in the order of the bucket their text's hash names. The last row
    is followed by the first. Rows meet their successor in range buckets, so the texts are
    shuffled once. The first row of each bucket is also sent to the bucket before it.
    """
    spark = docs.sparkSession
    bucket, _ = common.range_bucket(docs, "doc_id", 4 * common.n_partitions(spark), F.xxhash64("text"))
    placed = docs.withColumn("_b", bucket)
    least = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_first"), F.count("doc_id").alias("_ids"))
    # a bucket with nulls begins with one
    least = least.select("_b", F.when(F.col("_ids") == F.col("_n"), F.col("_first")).alias("_first")).orderBy("_b")
    begins = [tuple(r) for r in least.collect()]  # one row for each bucket
    kind = dict(docs.dtypes)["doc_id"]
    moved = [(b, first, begins[i - 1][0]) for i, (b, first) in enumerate(begins)]
    known = F.broadcast(spark.createDataFrame(moved, f"_at int, _first {kind}, _to int"))
    ghosts = placed.join(known, (F.col("_b") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    ghosts = ghosts.groupBy(F.col("_to").alias("_b")).agg(F.min_by("doc_id", "text").alias("doc_id"), F.min("text").alias("text"))
    ghosts = common.stored(ghosts, "bucket-firsts").withColumn("_ghost", F.lit(1))
    w = Window.partitionBy("_b").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "text")
    both = made(placed.withColumn("_ghost", F.lit(0))).unionByName(made(ghosts))
    for c in made(docs).columns:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.where("_ghost = 0").drop("_b", "_ghost")


def edited(text: Column, n_chars: Column, following: Column) -> Column:
    """The last half (rounded down) of the code points replaced by the next text's first ones."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n_chars - half).cast("int")), F.substring(following, F.lit(1), half))


def edit_report(documents: DataFrame, chars: int = 32) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    Likeness of exact digests is 1.0 where the fingerprints are equal, else 0.0. Repeated
    ids follow one another in text order; columns other than doc_id and text are ignored.
    """
    docs = documents.select("doc_id", common.text_or_empty(F.col("text")).alias("text"))

    def rows(extra: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
        keyed = lambda df: df.withColumn("d", digest(canonical(F.col("text")), chars)).withColumn(
            "n_chars", F.length("text").cast("long")
        )
        pairs = successors(docs, keyed).withColumn("e_text", edited(F.col("text"), F.col("n_chars"), F.col("next_text")))
        e = canonical(F.col("e_text"))
        return pairs.select(
            "doc_id", "n_chars", F.sha2("e_text", 256).alias("edited_sha256"), "d",
            digest(e, chars).alias("e"), F.col("next_d").alias("f"), F.col("next_doc_id").alias("next_id"),
            *[c.alias(k) for k, c in extra(F.col("text"), F.col("e_text")).items()],
        )

    narrow = common.stored(rows(lambda t, e: {}), "fingerprints")
    keys = common.stored(shared(narrow.select(F.explode(F.array("d", "e")).alias("digest"))), "shared-digests")
    n_keys = keys.count()
    own = among(
        docs.select(digest(canonical(F.col("text")), chars).alias("digest"), canonical(F.col("text")).alias("canon")),
        keys, "digest", n_keys,
    )
    edits = among(narrow.select("doc_id", "next_id", F.col("e").alias("digest")), keys, "digest", n_keys).distinct()
    edits = common.stored(edits, "shared-edits")
    ids = edits.select(F.explode(F.array("doc_id", "next_id")).alias("doc_id"))
    texts = common.stored(among(docs, ids, "doc_id", 2 * edits.count()), "shared-texts")
    after = texts.select(F.col("doc_id").alias("next_id"), F.col("text").alias("after"))
    remade = (
        edits.join(texts, "doc_id")
        .join(after, "next_id")
        .select("digest", canonical(edited(F.col("text"), F.length("text"), F.col("after"))).alias("canon"))
        .where(digest(F.col("canon"), chars) == F.col("digest"))
    )
    clash = common.stored(collisions(own.unionByName(remade)), "digest-collisions")
    if not clash.isEmpty():
        return _resolved(rows, clash)
    return narrow.select(
        "doc_id", "n_chars", "edited_sha256", F.col("d").alias("fingerprint"), F.col("e").alias("edited_fingerprint"),
        (F.col("d") == F.col("e")).cast("double").alias("near_edited"),
        (F.col("d") == F.col("f")).cast("double").alias("near_next"),
    )


def _resolved(rows, clash: DataFrame) -> DataFrame:
    """The report where digests collide: ordinals are found by the canonical text's SHA-256."""
    sha = lambda t: F.sha2(canonical(t), 256)
    full = rows(lambda t, e: {"ds": sha(t), "es": sha(e), "fs": sha(F.col("next_text"))})
    key = clash.select(F.col("digest").alias("_d"), F.sha2("canon", 256).alias("_s"), "ordinal")
    for c in "def":
        k = key.select(F.col("_d").alias(c), F.col("_s").alias(f"{c}s"), F.col("ordinal").alias(f"{c}o"))
        full = full.join(k, [c, f"{c}s"], "left").withColumn(f"{c}p", with_ordinal(F.col(c), F.col(f"{c}o")))
    return full.select(
        "doc_id", "n_chars", "edited_sha256", F.col("dp").alias("fingerprint"), F.col("ep").alias("edited_fingerprint"),
        (F.col("dp") == F.col("ep")).cast("double").alias("near_edited"),
        (F.col("dp") == F.col("fp")).cast("double").alias("near_next"),
    )
