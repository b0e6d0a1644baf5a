"""Column profiles of all tables: one unpivot and one aggregation a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, StructField

from lakeweave.functions.values import canonical, family, number_or_null
from lakeweave.sources.shared import written


def length_of(f: StructField) -> Column:
    """Characters of a value: of a text itself, else of its canonical text."""
    x = F.col(f"`{f.name}`")
    return F.length(x if family(f.dataType) == "text" else canonical(x, f.dataType))


def column_values(table: str, df: DataFrame) -> DataFrame:
    """``table, column, ordinal, n_cols, family, value`` for each cell of a table; ``value`` is canonical."""
    cells = [
        F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("ordinal"), F.lit(family(f.dataType)).alias("family"), canonical(F.col(f"`{f.name}`"), f.dataType).alias("value"), length_of(f).alias("length"))
        for i, f in enumerate(df.schema)
    ]
    melted = df.select(F.explode(F.array(*cells)).alias("c"))
    return melted.select(F.lit(table).alias("table"), "c.column", "c.ordinal", F.lit(len(df.columns)).alias("n_cols"), "c.family", "c.value", "c.length")


def lake_values(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables' cells in one frame."""
    out = None
    for name, df in sorted(tables.items()):
        part = column_values(name, df)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no tables")
    return out


def value_counts(cells: DataFrame) -> DataFrame:
    """Frequency of each column's values: the shape that all set features start from.  Null is a value here."""
    keys = ["table", "column", "ordinal", "n_cols", "family", "value"]
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("freq"), F.max("length").alias("length"))


def lake_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``value_counts`` of all tables' cells, by one aggregation a column that reads that column alone.

    Numbers, dates and the like are counted in their own type and made text
    afterwards, a distinct value each; ``number`` is the value as double where it is one,
    ``cid`` numbers the columns.
    """
    out, cid = None, 0
    for name, df in sorted(tables.items()):
        for i, f in enumerate(df.schema):
            x, of = F.col(f"`{f.name}`"), family(f.dataType)
            if of in ("text", "other"):
                value = canonical(x, f.dataType)
                part = df.select(value.alias("value"), (F.length(x) if of == "text" else F.length(value)).alias("length"))
                part = part.groupBy("value").agg(F.count(F.lit(1)).alias("freq"), F.max("length").alias("length")).withColumn("number", number_or_null(F.col("value")) if of == "text" else F.lit(None).cast("double"))
            else:
                rounds = isinstance(f.dataType, DecimalType) and f.dataType.scale  # compared as doubles
                part = df.select((x.cast("double") if rounds else x).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("freq"))
                kind = DoubleType() if rounds else f.dataType
                if kind.typeName() in ("float", "double"):  # floats of one canonical text are one value
                    part = part.groupBy(canonical(F.col("x"), kind).alias("text")).agg(F.sum("freq").alias("freq"), F.min("x").alias("x"))
                number = F.col("x").cast("double") if of == "number" else F.lit(None).cast("double")
                part = part.select(canonical(F.col("x"), kind).alias("value"), "freq", F.when(~F.isnan(number), number).alias("number")).withColumn("length", F.length("value"))
            own = part.select(F.lit(name).alias("table"), F.lit(f.name).alias("column"), F.lit(i).alias("ordinal"), F.lit(len(df.columns)).alias("n_cols"), F.lit(of).alias("family"), "value", "freq", "length", "number", F.lit(cid).alias("cid"))
            out, cid = own if out is None else out.unionByName(own), cid + 1
    if out is None:
        raise ValueError("no columns")
    return out


def profiles(counts: DataFrame, top: int = 10) -> DataFrame:
    """A row a column: rows, non-nulls, distinct values, lengths, numeric range, frequent values.

    ``top_values`` ranks by frequency, then value; the rank limit runs before the shuffle.
    With a ``top`` of 0 there is no such column, and no ranking.
    """
    keys = ["table", "column", "ordinal", "n_cols", "family"]
    has = F.col("value").isNotNull()
    number = F.col("number") if "number" in counts.columns else number_or_null(F.col("value"))
    base = counts.groupBy(*keys).agg(
        F.sum("freq").alias("n_rows"),
        F.coalesce(F.sum(F.when(has, F.col("freq"))), F.lit(0)).alias("n_nonnull"),
        F.count_if(has).alias("n_distinct"),
        F.try_divide(F.sum(F.col("freq") * F.col("length")), F.sum(F.when(has, F.col("freq")))).alias("len_avg"),
        F.min("length").alias("len_min"),
        F.max("length").alias("len_max"),
        F.min(number).alias("num_min"),
        F.max(number).alias("num_max"),
        F.coalesce(F.sum(F.when(number.isNotNull(), F.col("freq"))), F.lit(0)).alias("n_numeric"),
    )
    numeric = (F.col("family") == "number").alias("is_numeric")
    if not top:
        return base.select("*", numeric)
    rank = F.row_number().over(Window.partitionBy("table", "column").orderBy(F.desc("freq"), "value"))
    frequent = counts.where(has).withColumn("r", rank).where(F.col("r") <= top)
    frequent = frequent.groupBy("table", "column").agg(F.array_sort(F.collect_list(F.struct("r", "value", "freq"))).alias("t"))
    frequent = frequent.select("table", "column", F.transform("t", lambda t: F.struct(t["value"].alias("value"), t["freq"].alias("freq"))).alias("top_values"))
    return base.select("*", numeric).join(frequent, ["table", "column"], "left")


def frequent_values(counts: DataFrame, budget: int = 512, cost=None) -> DataFrame:
    """Each column's most frequent values while their running cost, and one for each comma, stays within
    ``budget``; stops at the first that doesn't fit.  ``cost`` of a value is its words by default."""
    cost = cost or (lambda v: F.size(F.split(v, r"\s+")))
    order = Window.partitionBy("table", "column").orderBy(F.desc("freq"), "value")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    kept = counts.where("value is not null").withColumn("r", F.row_number().over(order)).where(F.col("r") <= budget)
    kept = kept.withColumn("used", F.sum(cost(F.col("value")) + 1).over(run) - 1).where(F.col("used") <= budget)
    return written(kept.select("table", "column", "r", "value", "freq", "used"), "frequent")  # budget rows a column, found by small tasks


def column_text(profile: DataFrame, frequent: DataFrame) -> DataFrame:
    """``table, column, text``: a column's profile as a sentence for an encoder."""
    values = frequent.groupBy("table", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda v: v["value"]), ", ").alias("values"))
    joined = profile.join(values, ["table", "column"], "left")
    text = F.format_string("%s.%s contains %d values (%d, %d, %.1f): %s", "table", "column", "n_distinct", F.coalesce("len_max", F.lit(0)), F.coalesce("len_min", F.lit(0)), F.coalesce("len_avg", F.lit(0.0)), F.coalesce("values", F.lit("")))
    return joined.select("table", "column", text.alias("text"))


def profile_lake(tables: dict[str, DataFrame], top: int = 10) -> DataFrame:
    return profiles(lake_counts(tables), top)
