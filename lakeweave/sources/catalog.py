"""Named tables, their versions, and what the session knows about them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A dotted identifier, each part in backticks."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


class VersionedCatalog:
    """Base tables and their versions ``base_1``, ``base_2``, ...; the largest number is current.

    Versions are immutable frames registered as views; nothing is copied or changed.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.frames: dict[str, DataFrame] = {}
        for name, df in (tables or {}).items():
            self.put(name, df)

    def put(self, name: str, df: DataFrame) -> None:
        self.frames[name] = df
        df.createOrReplaceTempView(quoted(name))

    def names(self) -> list[str]:
        return sorted(self.frames)

    def find(self, name: str) -> str | None:
        """The stored name that equals ``name`` but for case."""
        return next((n for n in self.names() if n.lower() == name.lower()), None)

    def latest(self, base: str) -> str | None:
        """The current version's name: only the base itself, or the base with ``_`` or ``-`` and a number."""
        best, number = self.find(base), -1
        for name in self.names():
            if (m := re.fullmatch(re.escape(base) + r"[_-](\d+)", name, re.I)) and int(m[1]) > number:
                best, number = name, int(m[1])
        return best

    def version(self, base: str) -> int:
        m = re.fullmatch(re.escape(base) + r"[_-](\d+)", self.latest(base) or "", re.I)
        return int(m[1]) if m else 0

    def current(self, base: str) -> DataFrame:
        if (name := self.latest(base)) is None:
            raise KeyError(base)
        return self.frames[name]

    def add_version(self, base: str, df: DataFrame) -> str:
        name = f"{base}_{self.version(base) + 1}"
        self.put(name, df)
        return name

    def drop_latest(self, base: str) -> None:
        """Rolls back: forgets the current version, never the base."""
        if name := self.latest(base):
            if name.lower() != base.lower():
                self.spark.catalog.dropTempView(name)
                del self.frames[name]


def latest_versions(names: DataFrame, base: str) -> DataFrame:
    """The same lookup over a frame of table names (``name``): ``base, latest``."""
    number = F.nullif(F.regexp_extract("name", rf"(?i)^{re.escape(base)}[_-](\d+)$", 1), F.lit("")).try_cast("int")
    hit = names.withColumn("version", F.when(F.lower("name") == base.lower(), F.lit(0)).otherwise(number)).where("version is not null")
    return hit.agg(F.max_by("name", F.struct("version", "name")).alias("latest")).select(F.lit(base).alias("base"), "latest")


def list_tables(spark: SparkSession) -> DataFrame:
    """``name, temporary, ddl`` of the session's tables and views (ddl is the schema's)."""
    rows = []
    for t in spark.catalog.listTables():
        rows.append((t.name, t.isTemporary, spark.table(quoted(t.name)).schema.simpleString()))
    return spark.createDataFrame(sorted(rows), "name string, temporary boolean, ddl string")


def table_info(df: DataFrame) -> DataFrame:
    """``path, type, nullable`` of all columns, nested ones by their dotted path."""

    def walk(fields, prefix=""):
        for f in fields:
            yield (prefix + f.name, f.dataType.simpleString(), f.nullable)
            inner = f.dataType
            while hasattr(inner, "elementType"):
                inner = inner.elementType
            if hasattr(inner, "fields"):
                yield from walk(inner.fields, f"{prefix}{f.name}.")

    return df.sparkSession.createDataFrame(list(walk(df.schema.fields)), "path string, type string, nullable boolean")


def run_sql(spark: SparkSession, text: str, output: str = "direct", limit: int = 1000):
    """Runs a statement.  ``output`` ``direct`` gives the first rows as CSV text; a path gets a CSV folder."""
    df = spark.sql(text)
    if output == "direct":
        return csv_text(df.limit(limit))
    df.write.mode("overwrite").option("header", True).csv(output)
    return output


def csv_text(df: DataFrame) -> str:
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(["" if v is None else v for v in row] for row in df.collect())
    return out.getvalue()
