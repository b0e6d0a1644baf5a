"""Shared pieces: the shared folder, materialised tables, connected components."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: str | None = None
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster, where it must be set.  Only in
    local mode (tests) a folder under /tmp serves, and is removed at the end.
    """
    global _own
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if _own is None:
        _own = f"/tmp/checkpoints/lakeweave-{os.getpid()}"
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; see ``release``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def mark() -> int:
    """A place in the list of scratch paths, for ``release``."""
    return len(_paths)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the scratch paths made after ``mark()`` gave ``since``: for when the frames that
    read them are written elsewhere."""
    for path in _paths[since:]:
        remove(spark, path)
    del _paths[since:]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: cuts the lineage
    with files that outlive any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession):
    """Within it, Arrow batches hold 1000 rows and 16 MB at most, so that long texts take little memory
    in the JVM and in Python; for frames that are executed there.  The session's settings come back."""
    want = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
    before = {k: spark.conf.get(k) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def trim() -> None:
    """Gives the process's free memory back to the system, which the allocators keep otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if give:
        give(0)


def trimmed(run):
    """A function over Arrow batches whose worker, once idle, doesn't hold what its task has freed."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path that nothing reads any more."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: A key with more than one in so many rows is hot.
HOT = 1000


def hot_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined on ``key`` with ``table(key, ..., n)``, which has each key of ``rows`` once
    and the number ``n`` of its rows, ``total`` in all.

    Hot keys, fewer than ``HOT`` by their definition, are broadcast, and their rows stay where
    they are; no other key has more than one in ``HOT`` of the rows that are shuffled.
    """
    hot = F.broadcast(table.where(F.col("n") * HOT > total))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("n") * HOT <= total), key)
    return rows.join(hot, key).unionByName(cold).drop("n")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs) as ``(node, component)``,
    component being the least node reachable; nodes without an edge are absent.

    Alternates large-star and small-star.  Minima are partial aggregates, and hubs
    meet theirs by broadcast (see ``hot_join``), so no task gathers a hub's neighbours;
    each step is written to the shared folder, and the driver sees three numbers a round.
    Self loops, repeated and null edges are ignored; without edges nothing comes out.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[str, DataFrame]:
        path = scratch(spark, "edges")
        df.select("u", "v").write.parquet(path)
        return path, spark.read.schema("u long, v long").parquet(path)

    path, cur = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        now = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = hot_join(both, low, "u", 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        between, large = written(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = hot_join(large, low, "u", large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        last, (path, cur) = path, written(small.distinct())
        remove(spark, last)
        remove(spark, between)
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def annotated(docs: DataFrame, text: str, make, kind: str, rows_at_once: int = 250) -> DataFrame:
    """``(row, value)``: each row of ``docs`` as a struct, and what ``make()``'s function gives for its text.

    ``make`` runs once a task; its function takes a list of texts (null or not) and
    returns as many values of the Spark type ``kind``.  Columns of any name and type
    pass through untouched.
    """

    def run(batches):
        import pyarrow as pa

        values = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                some = batch.slice(at, rows_at_once)
                yield pa.record_batch([some.column(0), pa.array(values(some.column(0).field(place).to_pylist()), arrow_kind)], names=["row", "value"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    place = docs.columns.index(text)
    value = _parse_datatype_string(kind)
    arrow_kind = to_arrow_type(value)
    schema = StructType([StructField("row", docs.schema), StructField("value", value)])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.mapInArrow(trimmed(run), schema)
