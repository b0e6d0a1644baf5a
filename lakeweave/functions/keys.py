"""Join-key repairs: column to column(s), never in place.

The part that joins keeps the column's name; what is split off goes to new columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cased(x: Column, how: str = "lower") -> Column:
    return {"lower": F.lower, "upper": F.upper, "title": F.initcap}[how](x)


def trimmed(x: Column, characters: str = r"[^\p{L}\p{N}]") -> Column:
    """Without white space and special characters at both ends."""
    return F.regexp_replace(x, rf"^{characters}+|{characters}+$", "")


def split_prefix(x: Column, pattern: str) -> tuple[Column, Column]:
    """(rest, prefix) of a text whose beginning matches; no match leaves it whole with a null prefix."""
    prefix = F.nullif(F.regexp_extract(x, f"^({pattern})", 1), F.lit(""))
    return F.substr(x, F.length(F.coalesce(prefix, F.lit(""))) + 1), prefix


def split_suffix(x: Column, pattern: str) -> tuple[Column, Column]:
    """(rest, suffix) of a text whose end matches."""
    suffix = F.nullif(F.regexp_extract(x, f"({pattern})$", 1), F.lit(""))
    return F.left(x, F.length(x) - F.length(F.coalesce(suffix, F.lit("")))), suffix


def in_unit(x: Column, factors: dict[str, float]) -> Column:
    """A quantity text such as "12 kg" in the base unit; null for unknown units."""
    number = F.regexp_extract(x, r"^\s*(-?[0-9.]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(x, r"([A-Za-z%]+)\s*$", 1))
    return number * F.try_element_at(F.create_map(*[F.lit(v) for pair in factors.items() for v in pair]), unit)


def any_date(x: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "yyyyMMdd")) -> Column:
    """The date by the first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)).cast("date") for f in formats])


def without_zeros(x: Column) -> Column:
    """Without leading zeros; zero stays one digit."""
    return F.regexp_replace(x, "^0+(?=.)", "")


def with_zeros(x: Column, width: int) -> Column:
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, "0"))


def mapped(x: Column, labels: dict[str, str], keep: bool = True) -> Column:
    """Codes as labels; unknown ones as they are, or null."""
    label = F.try_element_at(F.create_map(*[F.lit(v) for pair in labels.items() for v in pair]), x)
    return F.coalesce(label, x) if keep else label


def aligned(x: Column, kind: str) -> Column:
    """A value in another type, null where it isn't one."""
    return x.try_cast(kind)


def joined(*parts: Column, by: str = " ") -> Column:
    return F.concat_ws(by, *parts)


def parts(x: Column, by: str, n: int) -> list[Column]:
    """The first n - 1 parts and the rest."""
    pieces = F.split(x, by, n)
    return [F.get(pieces, F.lit(i)) for i in range(n)]


def rolled_up(df: DataFrame, lookups: list[tuple[str, DataFrame, str, list[str]]]) -> DataFrame:
    """Adds the columns of a chain of lookup tables, as from city to region: each step ``(column, table, key,
    columns)`` looks ``column``, of the table or of a step before, up in ``table`` by ``key``.

    A key that is missing gives nulls; of rows that repeat a key the least by its columns counts,
    so that no row of ``df`` is multiplied.
    """
    for column, lookup, key, wanted in lookups:
        found = lookup.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*wanted)).alias("_found"))
        df = df.join(found, F.col(column) == F.col("_key"), "left").select(*df.columns, *[F.col(f"_found.{c}").alias(c) for c in wanted])
    return df
