"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's input.

1. language: documents whose text has no letter, in which no language is found, go.
2. near_duplicates: of each component of texts at least 0.8 alike, by shared shingles of five
   words, one row stays, with the smallest doc_id. Candidates come from SimHash's byte-position
   index, and from a prefix filter beyond its radius; all are decided exactly.
3. decontamination: documents that hold a benchmark item at a similarity of 0.8 or more go.
4. mixing: each document is repeated as often as its source's target weight takes it.
5. token_files: ids of every kept text in shard files; a row for each document read back.

Every stage works on all its predecessor kept. Stages 1 to 4 return the columns of
documents, whatever columns there are beside doc_id, text, lang and source.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplefront.llm import common, decontaminate, language, mixing, similar, token_files

END_ID = 2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Null and letterless texts are rejected.

    Where no document has a language to learn from, every text with a letter stays.
    """
    # under names that can't clash with what the operator adds, so that every column passes through
    safe = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[docs[f"`{c}`"].alias(x) for c, x in safe.items()])
    model = language.fit(docs)
    if not model.langs:
        model = language.Model(["any"], np.ones((language.BUCKETS, 1), np.float32))
    found = language.identify(rows, safe["text"], model)
    return found.where(F.col("lang_pred") != "und").select(*[F.col(x).alias(c) for c, x in safe.items()])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts at least 0.8 alike: one with the smallest id.

    Rows count, not ids: unlike texts under one id, or under none, are in components of
    their own, and each of those keeps a row. A row without an id stays only if no row of
    its component has one. Of rows with the same id and text one stays, the first by its
    JSON. Null and empty texts are alike. An empty table stays empty.
    """
    cols = docs.columns
    with common.scratch(spark) as keep:
        won = similar.representatives(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), F.col("x").alias("y"), "copies")
        kept = keep(common.stored(won, "kept-rows"))
    common.reclaim(spark)
    text = F.coalesce("text", F.lit(""))
    rows = common.packed(docs, cols, F.col("doc_id"), F.xxhash64(text).alias("x"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("x") == F.col("y"))
    # ids grow with the input: planned as at scale whatever the size, by a shuffle
    out = rows.join(kept.where("copies = 1").hint("merge"), same, "left_semi").select("row")
    if kept.where("copies > 1").isEmpty():  # as a rule: ids should be unique
        return common.unpacked(out, cols)
    repeated = rows.join(kept.where("copies > 1"), same, "left_semi")
    first = repeated.groupBy("doc_id", "x").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return common.unpacked(out.unionByName(first), cols)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item at a similarity of 0.8 or more.

    Texts are judged, not ids: rows stay or go by their own text, whether their ids are null
    or shared. Null, empty and wordless texts hold no item and stay; repeated rows stay
    repeated. Without items, or without documents, nothing goes.
    """
    cols = docs.columns
    x = F.xxhash64(F.coalesce("text", F.lit("")))
    found = decontaminate.leaks(docs.select(x.alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    texts = common.stored(found.select(F.col("doc_id").alias("y")).distinct(), "leaks")
    rows = common.packed(docs, cols, x.alias("x"))
    return common.unpacked(rows.join(texts, F.col("x") == F.col("y"), "left_anti"), cols)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: rows come 0, 1 or 2 times, unchanged.

    Null sources are a source of their own, the last; empty and null texts have size 0 and
    are taken at their source's rate, or never if the whole source has no words. Rows that
    share id, source and size share what these are taken. An empty table stays empty.
    """
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files.

    Null texts are empty ones: the end id alone. Null ids come first; repeated rows are
    written as often as they come. An empty table gives an empty one.
    """
    folder = common.scratch_path(spark, "pipeline-token-files", lasting=True)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_files.write_token_files(docs, "doc_id", "text", tokenizer, END_ID, folder)

    def digest(ids):
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    read = token_files.read_token_files(manifest, folder, digest, "n_tokens long, ids_crc32 long")
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage left behind goes once the next is written."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last = docs
        with common.scratch(spark) as keep:
            docs = keep(common.stored(stage(spark, last, sf_dir), f"stage-{name}"))
        if hasattr(last, "scratch"):
            common.drop_stored(last)
    return docs


#: SQL can express neither the mixture model, XXH64, the tokenizer nor the windows.
ORACLE_SQL = None
