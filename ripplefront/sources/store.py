"""The stored index: one Parquet table for each fact table, and a row about all of them.

Everything is stored, so an analysis from the store equals one from the sources. A save
writes a new folder and then a pointer to it: readers see the old index or the new one.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import Facts
from . import files

VERSION = "1.0.0"
FOLDER = ".ripplefront"
META = "metadata.json"


@dataclass
class IndexMetadata:
    version: str
    workspace_path: str
    created_at: int
    updated_at: int
    file_count: int
    method_count: int
    checksum: str
    folder: str


class StoreError(Exception):
    """A stored index that can't be read."""


def checksum(workspace: str) -> str:
    """SHA-256 over the sorted (path, seconds of change) of sources and configuration."""
    h = hashlib.sha256()
    for path in files.walk(workspace, files.DATED | files.CONFIGURATION):
        try:
            h.update(f"{os.path.relpath(path, workspace)}\0{int(os.stat(path).st_mtime)}\n".encode())
        except OSError:
            continue
    return h.hexdigest()


def _root(workspace: str) -> str:
    return os.path.join(workspace, FOLDER)


def exists(workspace: str) -> bool:
    return os.path.exists(os.path.join(_root(workspace), META))


def info(workspace: str) -> IndexMetadata | None:
    """What is known of the index; None if there is none that can be read."""
    try:
        with open(os.path.join(_root(workspace), META), encoding="utf-8") as f:
            return IndexMetadata(**json.load(f))
    except (OSError, ValueError, TypeError):
        return None


def is_valid(workspace: str) -> bool:
    """Same major version, same workspace, nothing changed since."""
    m = info(workspace)
    return bool(
        m and m.version.split(".")[0] == VERSION.split(".")[0] and m.workspace_path == os.path.abspath(workspace)
        and m.checksum == checksum(workspace)
    )


def save(facts: Facts, workspace: str, n_files: int) -> IndexMetadata:
    root, old, now = _root(workspace), info(workspace), int(time.time())
    folder = f"tables-{uuid.uuid4().hex}"
    for name, df in facts.tables().items():
        df.write.parquet("file://" + os.path.join(os.path.abspath(root), folder, name))
    n = facts.methods.agg(F.count(F.lit(1))).first()[0]
    meta = IndexMetadata(VERSION, os.path.abspath(workspace), old.created_at if old else now, now, n_files, n, checksum(workspace), folder)
    temporary = os.path.join(root, f"{META}.{uuid.uuid4().hex}")
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump(asdict(meta), f, indent=2)
    os.replace(temporary, os.path.join(root, META))
    if old:
        shutil.rmtree(os.path.join(root, old.folder), ignore_errors=True)
    return meta


def load(spark: SparkSession, workspace: str) -> Facts | None:
    """The stored tables; None if there are none, or they are out of date."""
    if not is_valid(workspace):
        return None
    folder = os.path.join(os.path.abspath(_root(workspace)), info(workspace).folder)
    read = {n: spark.read.parquet(f"file://{folder}/{n}") for n in sorted(os.listdir(folder)) if not n.startswith((".", "_"))}
    return Facts(**read)


def clear(workspace: str) -> bool:
    """Remove the index; whether there was one."""
    found = os.path.exists(_root(workspace))
    shutil.rmtree(_root(workspace), ignore_errors=True)
    return found


def meta_frame(spark: SparkSession, meta: IndexMetadata) -> DataFrame:
    """The metadata as a one-row table."""
    ddl = "version string, workspace_path string, created_at long, updated_at long, file_count long, method_count long, checksum string, folder string"
    return spark.createDataFrame([tuple(asdict(meta).values())], ddl)
