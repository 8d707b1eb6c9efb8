"""From hunks to the methods they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Binary digits of a line number that count within a block of lines.
BLOCK = 12


def changed_methods(methods: DataFrame, hunks: DataFrame) -> DataFrame:
    """(fqn) of methods whose lines meet a hunk of their file, each once.

    Ends count on both sides, and a hunk's end is its start plus its lines: one line past
    it, context lines included. A method meets a hunk if, of the hunks that start by its last
    line, the one that ends last reaches its first line; so a running maximum decides, and no
    method meets a hunk as a row. A file's lines are parted into blocks, each of which begins
    with the maximum of the blocks before it: a file of any size isn't one task's.
    """
    block = lambda c: F.shiftright(c, BLOCK).alias("block")
    h = hunks.select("file_path", F.col("new_start").cast("long").alias("at"), (F.col("new_start") + F.col("new_lines")).cast("long").alias("he"))
    h = h.where("file_path IS NOT NULL AND at IS NOT NULL").groupBy("file_path", "at").agg(F.max("he").alias("he"))
    m = methods.select("file_path", F.col("line_end").cast("long").alias("at"), F.col("line_start").cast("long").alias("begin"), "fqn")
    m = m.where("file_path IS NOT NULL AND at IS NOT NULL AND begin IS NOT NULL")
    # a window over (file, block) that a row for each block enters, however many hunks and methods are in it
    last = h.select("file_path", block("at"), "he").unionByName(m.select("file_path", block("at"), F.lit(None).cast("long").alias("he")))
    last = last.groupBy("file_path", "block").agg(F.max("he").alias("he"))
    before = F.max("he").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    first = last.select("file_path", "block", F.lit(None).cast("long").alias("at"), before.alias("he")).where("he IS NOT NULL")
    none = [F.lit(None).cast("long").alias("begin"), F.lit(None).cast("string").alias("fqn"), F.lit(False).alias("method")]
    rows = first.select("*", *none).unionByName(h.select("file_path", block("at"), "at", "he", *none)).unionByName(
        m.select("file_path", block("at"), "at", F.lit(None).cast("long").alias("he"), "begin", "fqn", F.lit(True).alias("method"))
    )
    so_far = F.max("he").over(Window.partitionBy("file_path", "block").orderBy(F.asc_nulls_first("at")))  # equal lines count
    return rows.withColumn("so_far", so_far).where("method AND begin <= so_far").select("fqn").distinct()


def missing_files(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path) of changed files that aren't in the workspace."""
    return changes.select("file_path").distinct().join(files.select("file_path").distinct(), "file_path", "left_anti")
