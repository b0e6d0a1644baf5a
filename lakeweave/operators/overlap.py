"""Value overlap between columns: single pairs, and all pairs through an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.values import canonical, family, number_or_null
from lakeweave.sources.shared import written


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """``family, value`` of a column: its distinct canonical values without null."""
    kind = df.schema[column].dataType
    value = canonical(F.col(f"`{column}`"), kind)
    return df.select(F.lit(family(kind)).alias("family"), value.alias("value")).where("value is not null").distinct()


def overlap_coefficient(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> DataFrame:
    """One row: ``n_a, n_b, shared, overlap``; overlap is shared / min(n_a, n_b), 0 if either is empty.

    Both sides are tagged, united and aggregated by value: one shuffle, no join.
    """
    both = distinct_values(a, column_a).withColumn("side", F.lit(1)).unionByName(distinct_values(b, column_b).withColumn("side", F.lit(2)))
    by_value = both.groupBy("family", "value").agg(F.bit_or("side").alias("sides"))
    counts = by_value.agg(
        F.count_if(F.col("sides").bitwiseAND(1) != 0).alias("n_a"),
        F.count_if(F.col("sides").bitwiseAND(2) != 0).alias("n_b"),
        F.count_if(F.col("sides") == 3).alias("shared"),
    )
    return counts.withColumn("overlap", F.coalesce(F.try_divide(F.col("shared").cast("double"), F.least("n_a", "n_b").cast("double")), F.lit(0.0)))


#: Columns of a lake whose sets are kept as bits; sets of wider lakes are arrays of numbers.
MOST_BITS = 512


def shared_values(counts: DataFrame) -> DataFrame:
    """``table1, column1, table2, column2, shared`` for all column pairs of different tables with common values.

    Inverted index: a value's set of columns, as bits, so that it is or-ed before the
    shuffle; equal sets are counted before pairs are made of them.  The sets with their
    counts are written, so that the index is made by small tasks.
    """
    named = counts.select("table", "column", *(["cid"] if "cid" in counts.columns else [])).distinct()
    names = [(r["table"], r["column"]) for r in sorted(named.collect(), key=lambda r: r["cid"] if "cid" in named.columns else tuple(r))]  # the lake's columns
    if "cid" not in counts.columns:
        numbers = counts.sparkSession.createDataFrame([(*n, i) for i, n in enumerate(names)], "table string, column string, cid int")
        counts = counts.join(F.broadcast(numbers), ["table", "column"])
    rows = counts.where("value is not null").select("family", "value", "cid")
    if len(names) <= MOST_BITS:
        masks = [f"m{w}" for w in range(-(-len(names) // 64))]
        bits = [F.when(F.expr(f"cid div 64 = {w}"), F.expr("shiftleft(1L, cid % 64)")).otherwise(F.lit(0).cast("long")) for w in range(len(masks))]
        index = rows.groupBy("family", "value").agg(*[F.bit_or(b).alias(m) for b, m in zip(bits, masks, strict=True)])
        many = sum((F.bit_count(m) for m in masks), F.lit(0))
        sets = index.where(many > 1).groupBy(*masks).agg(F.count(F.lit(1)).alias("n"))

        def members(w: int) -> Column:
            return F.filter(F.sequence(F.lit(64 * w), F.lit(min(64 * w + 63, len(names) - 1))), lambda i: F.getbit(F.col(masks[w]), i % 64) == 1)

        held = [members(w) for w in range(len(masks))]
        sets = sets.select("n", F.concat(*held).alias("columns"))
    else:
        index = rows.groupBy("family", "value").agg(F.array_sort(F.collect_set("cid")).alias("columns")).where(F.size("columns") > 1)
        sets = index.groupBy("columns").agg(F.count(F.lit(1)).alias("n"))
    sets = written(sets, "sets")  # 2^columns rows at most, in practice few
    pairs = sets.select("n", F.posexplode("columns").alias("i", "a"), "columns").select("n", "a", F.explode(F.slice("columns", F.col("i") + 2, F.size("columns"))).alias("b"))
    pairs = pairs.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    for side, number in (("1", "a"), ("2", "b")):
        own = counts.sparkSession.createDataFrame([(i, *n) for i, n in enumerate(names)], f"{number} int, table{side} string, column{side} string")
        pairs = pairs.join(F.broadcast(own), number)  # a row a column of the lake
    first = F.struct("table1", "column1") < F.struct("table2", "column2")
    turned = [F.when(first, F.col(f"{c}{s}")).otherwise(F.col(f"{c}{3 - s}")).alias(f"{c}{s}") for s in (1, 2) for c in ("table", "column")]
    return pairs.where("table1 <> table2").select(*turned, "shared")


def containment(shared: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds both containments, their max and min, and the overlap coefficient."""
    for side in ("1", "2"):
        n = profile.select(F.col("table").alias(f"table{side}"), F.col("column").alias(f"column{side}"), F.col("n_distinct").alias(f"n{side}"))
        shared = shared.join(n, [f"table{side}", f"column{side}"])
    c1, c2 = F.try_divide("shared", "n1"), F.try_divide("shared", "n2")
    return shared.select(
        "table1", "column1", "table2", "column2", "shared", "n1", "n2",
        c1.alias("containment1"), c2.alias("containment2"),
        F.greatest(c1, c2).alias("max_containment"), F.least(c1, c2).alias("min_containment"),
        F.try_divide("shared", F.least("n1", "n2")).alias("overlap"),
    )


def range_overlap(pairs: DataFrame) -> DataFrame:
    """Adds ``range_overlap`` from ``min1, max1, min2, max2``: the common length over the united span; 0 if
    disjoint, without numbers, or of span 0."""
    common = F.least("max1", "max2") - F.greatest("min1", "min2")
    span = F.greatest("max1", "max2") - F.least("min1", "min2")
    return pairs.withColumn("range_overlap", F.when((common > 0) & (span > 0), common / span).otherwise(F.lit(0.0)))


#: Numeric columns whose running sums stand in one row, and distinct numbers in a range of them.
WIDE, RANGE_ROWS = 24, 50_000


def bucket_of(x: Column, bounds: list[float]) -> Column:
    """The number of bounds at or below ``x``, by a balanced tree of comparisons."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        middle = (a + b) // 2
        return F.when(x < F.lit(bounds[middle]), tree(a, middle)).otherwise(tree(middle + 1, b))

    return tree(0, len(bounds))


def earth_mover(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``table1, column1, table2, column2, emd``: the 1-D earth mover's distance of the columns' numbers.

    The area between the two distribution functions.  All columns' numbers are merged
    once: a row a distinct number, with each column's share of its own numbers there.
    Running sums go by ranges of the numbers (sums of the ranges below, then running sums
    within a range), and all pairs' areas are summed up in the same pass.  Columns beyond
    ``WIDE`` are taken in blocks, two at a time.
    """
    spark = counts.sparkSession
    wanted = [tuple(r) for r in pairs.select("table1", "column1", "table2", "column2").distinct().collect()]  # column pairs
    number = F.col("number") if "number" in counts.columns else number_or_null(F.col("value"))
    numbers = counts.select("table", "column", number.alias("x"), "freq").where("x is not null")
    total = {(r["table"], r["column"]): r["n"] for r in numbers.groupBy("table", "column").agg(F.sum("freq").alias("n")).collect()}
    wanted = [p for p in wanted if p[:2] in total and p[2:] in total]
    columns = sorted({c for p in wanted for c in (p[:2], p[2:])})
    size = max(1, len(columns) if len(columns) <= WIDE else WIDE // 2)
    block = {c: i // size for i, c in enumerate(columns)}
    parts: dict[tuple[int, int], list] = {}
    for p in sorted(wanted):
        parts.setdefault(tuple(sorted((block[p[:2]], block[p[2:]]))), []).append(p)
    out = None
    for own in parts.values():
        area = _areas(numbers, own, total)
        out = area if out is None else out.unionByName(area)
    return out if out is not None else spark.createDataFrame([], "table1 string, column1 string, table2 string, column2 string, emd double")


def _areas(numbers: DataFrame, pairs: list, total: dict) -> DataFrame:
    """The distances of some pairs, from their columns' merged numbers."""
    columns = sorted({c for p in pairs for c in (p[:2], p[2:])})
    place = {c: i for i, c in enumerate(columns)}
    mine = [(F.col("table") == t) & (F.col("column") == c) for t, c in columns]
    masses = [f"m{i}" for i in range(len(columns))]
    held = numbers.where(F.concat_ws(".", "table", "column").isin([".".join(c) for c in columns]))
    merged = held.groupBy("x").agg(*[F.coalesce(F.sum(F.when(m, F.col("freq"))), F.lit(0)).alias(n) for m, n in zip(mine, masses, strict=True)])
    merged = written(merged.select("x", *[(F.col(n) / F.lit(float(total[c]))).alias(n) for n, c in zip(masses, columns, strict=True)]), "numbers")
    ranges = min(256, merged.count() // RANGE_ROWS + 1)
    bounds = sorted(set(merged.agg(F.percentile_approx("x", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0])) if ranges > 1 else []
    merged = merged.withColumn("b", bucket_of(F.col("x"), bounds))
    sums = merged.groupBy("b").agg(F.min("x").alias("first"), *[F.sum(m).alias(m) for m in masses])
    order = Window.orderBy("b")  # a row a range
    below = sums.select("b", F.lead("first").over(order).alias("next"), *[F.coalesce(F.sum(m).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(f"below_{m}") for m in masses])
    inside = Window.partitionBy("b").orderBy("x")
    run = merged.join(F.broadcast(below), "b")
    run = run.select((F.coalesce(F.lead("x").over(inside), F.col("next")) - F.col("x")).alias("dx"), *[(F.col(f"below_{m}") + F.sum(m).over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias(m) for m in masses])
    areas = run.agg(*[F.coalesce(F.sum(F.abs(F.col(masses[place[p[:2]]]) - F.col(masses[place[p[2:]]])) * F.col("dx")), F.lit(0.0)).alias(f"a{i}") for i, p in enumerate(pairs)])
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(p, ("table1", "column1", "table2", "column2"), strict=True)], F.col(f"a{i}").alias("emd")) for i, p in enumerate(pairs)])
    return written(areas.select(F.explode(rows).alias("r")).select("r.*"), "areas")  # a row a pair, summed by small tasks


def overlap_sketches(counts: DataFrame, log_k: int = 12) -> DataFrame:
    """Extension: a theta sketch a column, for overlap estimates on lakes too wide for the exact index."""
    return counts.where("value is not null").groupBy("table", "column").agg(F.expr(f"theta_sketch_agg(concat(family, ':', value), {log_k})").alias("sketch"))


def sketch_overlap(sketches: DataFrame) -> DataFrame:
    """Extension: estimated overlap coefficients of all column pairs of different tables."""
    a, b = (sketches.select(*[F.col(c).alias(f"{c}{s}") for c in ("table", "column", "sketch")]) for s in ("1", "2"))
    pairs = a.join(b, F.expr("table1 < table2"))
    shared = F.expr("theta_sketch_estimate(theta_intersection(sketch1, sketch2))")
    least = F.least(F.expr("theta_sketch_estimate(sketch1)"), F.expr("theta_sketch_estimate(sketch2)"))
    return pairs.select("table1", "column1", "table2", "column2", F.coalesce(F.try_divide(shared.cast("double"), least.cast("double")), F.lit(0.0)).alias("overlap"))
