"""Reading a directory of CSV tables, and lists of links between their columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Types tried in this order; a column takes the first that all its values fit.
CASTS = ("boolean", "bigint", "double", "date", "timestamp_ntz")
#: Texts read as true and false where a column has nothing else.
TRUE_FALSE = ("t", "f", "true", "false")
ENCODINGS = ("utf-8", "utf-8-sig", "iso-8859-1", "cp1252", "utf-16")


def fits(x: Column, kind: str) -> Column:
    """Whether a text reads as ``kind``.  Numbers with a leading zero are codes, not numbers."""
    if kind == "boolean":
        return F.lower(x).isin(*TRUE_FALSE)
    if kind == "bigint":
        return x.rlike(r"^-?(0|[1-9][0-9]{0,18})$") & x.try_cast("bigint").isNotNull()
    if kind == "double":
        return x.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$") | x.isin("NaN", "inf", "-inf")
    if kind == "date":
        return x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & x.try_cast("date").isNotNull()
    return x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}") & F.try_to_timestamp(time_text(x)).isNotNull()


def time_text(x: Column) -> Column:
    return F.regexp_replace(x, r"\s*(UTC|Z)$", "")


def convert(x: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.lower(x).isin("t", "true") | F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(False)
    if kind == "timestamp_ntz":
        return F.try_to_timestamp(time_text(x)).cast("timestamp_ntz")
    return x.try_cast(kind)


def infer_types(df: DataFrame) -> dict[str, str]:
    """Each text column's type: the first of ``CASTS`` that all its non-null values fit, else string.

    One aggregation over all columns; columns without values stay strings.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    if not texts:
        return {}
    checks = []
    for i, name in enumerate(texts):
        x = F.col(f"`{name}`")
        checks.append(F.count(x).alias(f"n{i}"))
        checks += [F.count_if(fits(x, kind)).alias(f"c{i}_{k}") for k, kind in enumerate(CASTS)]
    row = df.agg(*checks).first()
    out = {}
    for i, name in enumerate(texts):
        n = row[f"n{i}"]
        out[name] = next((kind for k, kind in enumerate(CASTS) if n and row[f"c{i}_{k}"] == n), "string")
    return out


def typed(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text columns in their inferred (or given) types."""
    types = infer_types(df) if types is None else types
    return df.select(*[convert(F.col(f"`{c}`"), types[c]).alias(c) if types.get(c, "string") != "string" else F.col(f"`{c}`") for c in df.columns])


def read_csv(spark: SparkSession, path: str, infer: bool = True, mode: str = "PERMISSIVE", encoding: str = "utf-8") -> DataFrame:
    """A CSV table with a header: quoted fields may hold line ends; empty fields are null.

    ``mode`` DROPMALFORMED ignores rows that don't fit, FAILFAST raises on them.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", mode).option("encoding", encoding).csv(path)
    return typed(raw) if infer else raw


def stem(path: str) -> str:
    return re.sub(r"\.csv$", "", path.rstrip("/").rsplit("/", 1)[-1], flags=re.I)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """Files of a folder in any store that Spark reads, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def load_lake(spark: SparkSession, folder: str, infer: bool = True) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """All CSV tables of a folder by their stem, and the errors of files that can't be read, which are skipped."""
    tables, errors = {}, {}
    for path in list_files(spark, folder):
        try:
            tables[stem(path)] = read_csv(spark, path, infer)
        except Exception as e:  # any reader error: the rest of the lake still loads
            errors[stem(path)] = str(e).split("\n", 1)[0]
    return tables, errors


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names, from the first row alone."""
    return spark.read.option("header", True).csv(path).columns


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def catalog_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, column, ordinal`` of all tables."""
    rows = [(t, c, i) for t, df in tables.items() for i, c in enumerate(df.columns)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table string, column string, ordinal int")


LINKS = StructType([StructField(c, StringType()) for c in ("table1", "table2", "column1", "column2", "prob")])


def read_links(spark: SparkSession, path: str, columns: DataFrame, label: int = 1, lenient: bool = False) -> DataFrame:
    """Links ``table1, column1, table2, column2, label`` from a headerless CSV with those four
    names (tables first) and more.

    Tables lose a ``.csv``; rows that name an unknown table or column go, or, if
    ``lenient``, an unknown column is replaced by its table's first.  The first
    encoding that decodes the file without replacement characters is used.
    """
    raw = None
    for encoding in ENCODINGS:
        try:
            raw = spark.read.schema(LINKS).option("encoding", encoding.replace("utf-8-sig", "utf-8")).csv(path)
            if raw.where(F.concat_ws("", *raw.columns).contains("�")).isEmpty():
                break
        except Exception:  # try the next encoding
            continue
    if raw is None:
        raise ValueError(f"no known encoding fits {path}")
    strip = [F.regexp_replace(F.regexp_replace(F.trim(c), "^﻿", ""), r"(?i)\.csv$", "").alias(c) for c in ("table1", "table2")]
    rows = raw.select(*strip, F.trim("column1").alias("column1"), F.trim("column2").alias("column2")).where("table1 is not null and table2 is not null")
    first = columns.groupBy("table").agg(F.min_by("column", "ordinal").alias("first"))
    for side in ("1", "2"):
        known = columns.select(F.col("table").alias(f"table{side}"), F.col("column").alias(f"column{side}"), F.lit(True).alias("known"))
        rows = rows.join(known, [f"table{side}", f"column{side}"], "left")
        if lenient:
            rows = rows.join(first.withColumnRenamed("table", f"table{side}"), f"table{side}")
            rows = rows.withColumn(f"column{side}", F.when(F.col("known"), F.col(f"column{side}")).otherwise(F.col("first"))).drop("first", "known")
        else:
            rows = rows.where("known").drop("known")
    return rows.select("table1", "column1", "table2", "column2", F.lit(label).alias("label"))


def read_matching(spark: SparkSession, pattern: str, source: str = "source_relation") -> DataFrame:
    """All CSV tables whose paths match a wildcard, under each other, with each row's file stem; columns are texts."""
    out = None
    folder, _, name = pattern.rpartition("/")
    for path in list_files(spark, folder, name):
        part = read_csv(spark, path, infer=False).withColumn(source, F.lit(stem(path)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(pattern)
    return out


def first_rows(df: DataFrame, n: int = 20) -> DataFrame:
    return df.limit(n)


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of a seeded sample, as JSON texts: a share of the rows somewhat over ``n``
    is drawn where they are, and only that is put in a random order."""
    total = df.count()
    drawn = df.sample(min(1.0, (n + 4 * n**0.5 + 10) / total), seed) if total else df
    return drawn.orderBy(F.rand(seed)).limit(n).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
