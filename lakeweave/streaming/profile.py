"""Extension: profiles and event counts over streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators.profile import column_values


def stream_profile(table: str, stream: DataFrame) -> DataFrame:
    """Running row, non-null and approximate distinct counts of each column of a streaming table (complete mode)."""
    cells = column_values(table, stream)
    return cells.groupBy("table", "column").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_nonnull"), F.approx_count_distinct("value").alias("n_distinct"), F.max("length").alias("len_max"))


def windowed_counts(stream: DataFrame, at: str, keys: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by time window and keys; rows later than ``late`` are dropped, so the state stays bounded."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
