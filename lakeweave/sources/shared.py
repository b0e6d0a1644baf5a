"""Frames written into the folder that driver and executors share, so that they are made once."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode, where it is unset, one under /tmp."""
    global _own
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if _own is None:
        _own = f"/tmp/checkpoints/lakeweave-core-{os.getpid()}"
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


#: Bytes that a task reads or is dealt within ``small_tasks``, and most partitions of a shuffle there.
TASK_BYTES, MOST_PARTITIONS = 8 << 20, 2_000


@contextmanager
def small_tasks(spark: SparkSession, size: int = 0):
    """Within it, tasks read and are dealt ``TASK_BYTES``, so that a table of hashed rows takes as much memory
    however large the input; for frames that are executed there.  The session's settings come back.

    By default these are 128 and 64 MB of compressed rows, which for keys are many millions.
    ``size`` is the bytes to be dealt out, for more partitions than the session's where it is large.
    """
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = {
        "spark.sql.files.maxPartitionBytes": str(TASK_BYTES),
        "spark.sql.files.openCostInBytes": str(TASK_BYTES // 8),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(now, min(MOST_PARTITIONS, size // TASK_BYTES))),
    }
    before = {k: spark.conf.get(k, None) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet by small tasks and read back: its files outlive executors, and nothing is kept in their memory."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_tasks(spark, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))):
        df.write.option("parquet.block.size", 2 * TASK_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
