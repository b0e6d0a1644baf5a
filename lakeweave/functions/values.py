"""Canonical values: what is equal to what across columns of different types.

Values are compared as text within a type family; families never mix.  An integer
and an equal float are one value, a number and the same digits as text are not,
and a date is no timestamp.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, NumericType, StringType, TimestampNTZType, TimestampType

#: Longer texts are compared by their hash.
LONG_TEXT = 256


def family(kind: DataType) -> str:
    """number, text, date, time, bool or other."""
    if isinstance(kind, NumericType):
        return "number"
    if isinstance(kind, BooleanType):
        return "bool"
    if isinstance(kind, StringType):
        return "text"
    if isinstance(kind, DateType):
        return "date"
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return "time"
    return "other"


def plain_number(x: Column) -> Column:
    """Text of a float without exponent or trailing zeros; very large ones as Spark prints them."""
    fixed = F.regexp_replace(x.try_cast(DecimalType(38, 12)).cast("string"), r"\.?0+$", "")
    return F.when(x == 0, "0").otherwise(F.coalesce(fixed, x.cast("string")))


def canonical(x: Column, kind: DataType) -> Column:
    """The canonical text of a value; null for null and NaN."""
    of = family(kind)
    if of == "number":
        if kind.typeName() in ("float", "double"):
            return F.when(~F.isnan(x), plain_number(x))
        if isinstance(kind, DecimalType):
            return plain_number(x.cast("double")) if kind.scale else x.cast("string")
        return x.cast("string")
    if of == "text":
        return F.when(F.length(x) > LONG_TEXT, F.concat(F.lit("\x00"), F.sha2(x, 256))).otherwise(x)
    return F.to_json(x) if of == "other" else x.cast("string")


def number_or_null(x: Column) -> Column:
    """A value as double where it is one; null for other texts, NaN and null."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value), value)


def finite(x: Column) -> Column:
    """0 for null, NaN and infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once a row, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)
