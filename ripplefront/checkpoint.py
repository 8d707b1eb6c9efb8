"""Cutting lineage in the folder that the cluster's executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset, and the master is local, a temporary one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="ripplefront-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed and written to the checkpoint folder."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The frame, written to the checkpoint folder as Parquet: by columns, a fraction of the bytes of ``cut``."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete what ``stored`` wrote; frames made from it can't be read any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def reclaim(spark: SparkSession) -> None:
    """Let shuffles and broadcasts that no frame needs any more leave the disks.

    Spark deletes them once the driver's JVM happens to collect the plans that hold them. Python tells
    the JVM of frames that are gone by a thread that sleeps a second at a time: it is waited for.
    """
    gc.collect()
    untold, until = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ()), time.monotonic() + 2
    while untold and time.monotonic() < until:
        time.sleep(0.05)
    spark.sparkContext._jvm.System.gc()


def kept_by(df: DataFrame, *keys: str) -> DataFrame:
    """The frame, cut and cached in partitions of its keys.

    A loop that joins it on these keys, round after round, then moves only the other side.
    Cached parts that are lost are read again from the checkpoint. Unpersist it when done.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df).repartition(n, *keys).persist()
