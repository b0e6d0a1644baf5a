"""Sinks, file checks and folder differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds records as JSON lines; a part file a call."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def create_table(spark: SparkSession, name: str, df: DataFrame, mode: str = "overwrite") -> None:
    """Creates or replaces a managed table; ``errorifexists`` refuses to."""
    df.write.mode(mode).saveAsTable(name)


def valid(spark: SparkSession, path: str, kind: str) -> bool:
    """Whether a file parses as csv, json or xml throughout."""
    reader = spark.read.option("mode", "FAILFAST")
    try:
        if kind == "csv":
            df = reader.option("header", True).option("multiLine", True).csv(path)
        elif kind == "json":
            df = reader.option("multiLine", True).json(path)
        elif kind == "xml":
            df = reader.option("rowTag", "ROW").xml(path)
        else:
            raise ValueError(f"no check for {kind}")
        df.write.format("noop").mode("overwrite").save()
    except ValueError:
        raise
    except Exception:  # whatever the parser says, the file isn't valid
        return False
    return True


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """``path, sha256`` of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change`` (added, removed or changed) between two ``content_hashes``."""
    both = before.withColumnRenamed("sha256", "old").join(after.withColumnRenamed("sha256", "new"), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def edge_file(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """Edge verdicts ``column1, column2`` of an edge JSON, turned so that ``left`` is the first side.

    Candidates are a map from "a ↔ b" to a verdict; true ones are kept, whether
    written as a boolean or a text.
    """
    raw = spark.read.option("multiLine", True).schema("table1 string, table2 string, candidates map<string,string>").json(path)
    rows = raw.select("table1", "table2", F.explode("candidates").alias("pair", "verdict")).where(F.lower("verdict") == "true")
    parts = F.split("pair", r"\s*(?:↔|<->|->)\s*|\s+-\s+", 2)
    rows = rows.select("table1", "table2", F.trim(parts[0]).alias("a"), F.trim(F.get(parts, F.lit(1))).alias("b")).where("b is not null")
    swap = (F.col("table1") == right) & (F.col("table2") == left)
    return rows.select(F.lit(left).alias("table1"), F.lit(right).alias("table2"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("column1"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("column2"))
