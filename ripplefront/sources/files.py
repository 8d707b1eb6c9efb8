"""Source trees as DataFrames of (path, content)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..parsers import CONFIGS, LANGUAGES

#: Entries of these names, and those that start with a dot, are skipped.
SKIPPED = {"target", "build", "node_modules"}
#: What counts for the freshness of an index, wider than what is parsed.
DATED = {"java", "rs", "kt", "scala", "go", "py", "js", "ts"}


def extension(path: str) -> str:
    """The text after the last dot of the name, as it is written; empty if there is none."""
    stem, dot, ext = os.path.basename(path).rpartition(".")
    return ext if dot and stem else ""


def language(path: str) -> str | None:
    return LANGUAGES[extension(path)][0] if extension(path) in LANGUAGES else None


def walk(root: str, extensions: set[str]) -> Iterator[str]:
    """Files below a folder, links followed, in a fixed order."""
    seen = set()
    for folder, folders, names in os.walk(root, followlinks=True):
        real = os.path.realpath(folder)
        if real in seen:  # a link back up
            folders.clear()
            continue
        seen.add(real)
        folders[:] = sorted(d for d in folders if not d.startswith(".") and d not in SKIPPED)
        for name in sorted(names):
            if not name.startswith(".") and name not in SKIPPED and extension(name) in extensions:
                yield os.path.join(folder, name)


def listing(spark: SparkSession, paths: list[str], per_task: int = 64) -> DataFrame:
    """(path) rows, spread so that files are read and parsed by many tasks."""
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return df.repartition(max(1, -(-len(paths) // per_task))) if paths else df


def scan(spark: SparkSession, uri: str, extensions: set[str] | None = None, glob: str | None = None) -> DataFrame:
    """(path, content, modified) of whole text files, read by Spark from any store.

    ``content`` is null where the bytes aren't UTF-8. Folders whose name starts with a dot,
    or is in SKIPPED, are left out below ``uri``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = reader.option("pathGlobFilter", glob or "*").load(uri)
    root = re.sub(r"^\w+:/*", "/", uri.rstrip("/"))
    inner = F.substring_index(F.regexp_replace("path", r"^\w+:/*", "/"), root, -1)
    parts = F.split(inner, "/")
    kept = ~F.exists(parts, lambda x: x.startswith(".") | x.isin(*SKIPPED))
    if extensions is not None:
        kept = kept & F.regexp_extract("path", r"[^/]\.([^./]+)$", 1).isin(*extensions)
    text = F.when(F.is_valid_utf8(F.col("content")), F.col("content").cast("string"))
    return df.where(kept).select("path", text.alias("content"), F.col("modificationTime").alias("modified"))


SOURCES = set(LANGUAGES)
CONFIGURATION = set(CONFIGS)
