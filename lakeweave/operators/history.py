"""Operators over versions and events in time, and report aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.operators.overlap import bucket_of
from lakeweave.sources.shared import written


def order_of(keys: list[str], by: list[str], descending: bool = False):
    return Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in by])


def most_recent_flag(df: DataFrame, keys: list[str], by: list[str], column: str = "is_most_recent_record") -> DataFrame:
    """Flags the last row of each key."""
    return df.withColumn(column, F.row_number().over(order_of(keys, by, True)) == 1)


def latest(df: DataFrame, keys: list[str], by: list[str], index: str = "latest_index") -> DataFrame:
    """The last row of each key, with its index 1; the rank limit runs before the shuffle."""
    return df.withColumn(index, F.row_number().over(order_of(keys, by, True))).where(F.col(index) == 1)


def valid_intervals(df: DataFrame, keys: list[str], at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Each row's interval: from its time to the next row's; open at the end."""
    return df.withColumn(start, F.col(at)).withColumn(end, F.lead(at).over(Window.partitionBy(*keys).orderBy(at)))


def previous(df: DataFrame, keys: list[str], by: list[str], columns: list[str], prefix: str = "previous_") -> DataFrame:
    order = order_of(keys, by)
    return df.withColumns({prefix + c: F.lag(c).over(order) for c in columns})


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes elapsed."""
    return F.timestamp_diff("MINUTE", start, end)


def running_counts(df: DataFrame, outer: list[str], inner: list[str], by: list[str]) -> DataFrame:
    """Adds ``n_outer`` and ``n_inner``, the row's number within the outer keys and within both."""
    return df.withColumns({"n_outer": F.row_number().over(order_of(outer, by)), "n_inner": F.row_number().over(order_of(outer + inner, by))})


def first_last(df: DataFrame, keys: list[str], by: Column, column: str) -> DataFrame:
    """First and last value by time, and counts, of each key."""
    return df.groupBy(*keys).agg(F.min_by(column, by).alias("first_value"), F.max_by(column, by).alias("last_value"), F.count(column).alias("n_values"), F.count_distinct(column).alias("n_distinct"))


def report(df: DataFrame, grains: list[list[str]], measures: dict[str, Column]) -> DataFrame:
    """One report over several grains: grouping sets, with the number of each row's grain (``grain``)."""
    names = list(dict.fromkeys(c for g in grains for c in g))
    grouped = df.groupingSets([[F.col(c) for c in g] for g in grains], *[F.col(c) for c in names])
    out = grouped.agg(F.grouping_id(*names).alias("_id"), *[m.alias(n) for n, m in measures.items()])
    ids = {sum((c not in g) << (len(names) - 1 - i) for i, c in enumerate(names)): k for k, g in enumerate(grains)}
    place = None
    for code, k in ids.items():
        place = F.when(F.col("_id") == code, k) if place is None else place.when(F.col("_id") == code, k)
    return out.withColumn("grain", place).drop("_id")


def share_of_total(df: DataFrame, by: list[str], value: str, column: str = "share") -> DataFrame:
    """Adds each row's share of its group's total."""
    return df.withColumn(column, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*by))))


def first_or_return(df: DataFrame, who: list[str], day: str) -> DataFrame:
    """Adds ``is_first``: whether the row is of the first day of its key."""
    return df.withColumn("is_first", F.col(day) == F.min(day).over(Window.partitionBy(*who)))


def since(df: DataFrame, at: str, as_of: Column, days: int = 30) -> DataFrame:
    """Rows of the last days before a stated moment."""
    return df.where((F.col(at) > as_of - F.make_dt_interval(F.lit(days))) & (F.col(at) <= as_of))


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, on: list[str], how: str = "inner") -> DataFrame:
    """Each point with the interval of its keys that holds it; a null end is open.

    The keys are equalities, so the plan is a hash or merge join that carries the range.
    """
    right = intervals.withColumnsRenamed({k: f"_{k}" for k in on})
    equal = [points[k] == right[f"_{k}"] for k in on]
    inside = (points[at] >= right[start]) & (right[end].isNull() | (points[at] < right[end]))
    condition = inside
    for e in equal:
        condition = condition & e
    return points.join(right, condition, how).drop(*[f"_{k}" for k in on])


#: Rows of a block of points or intervals, and time buckets that are dealt out together.
BLOCK_ROWS, BUCKETS_DEALT = 256, 6


def bucketed_interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, until: Column, seconds: int = 86_400) -> DataFrame:
    """The same without keys: both sides are cut into time buckets, so that it is no nested loop.

    ``until`` closes open intervals.  Points of one bucket of ``seconds``, and intervals that begin in one
    bucket and end in one, stand in blocks, and blocks whose times overlap meet: with buckets much shorter
    than the intervals nearly all that a point meets are results, and with longer ones nearly none.  An
    interval is dealt out once for each run of ``BUCKETS_DEALT`` buckets that it touches.

    What comes of two blocks comes point by point, with the same intervals in the same order: runs of one
    value beside repeats of a short list, which Parquet files hold in a small part of the usual bytes.
    """

    def bucket(c: Column) -> Column:
        return F.floor(F.unix_seconds(c.cast("timestamp")) / F.lit(seconds))

    def run(c: Column) -> Column:
        return F.floor(bucket(c) / F.lit(BUCKETS_DEALT))

    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not coalesced: what comes out is more than what is dealt

    def blocks(df: DataFrame, low: Column, high: Column, by: list[Column], name: str) -> DataFrame:
        """``_run``, the rows of a block as array ``name``, and the bounds of their times."""
        rows = df.repartition(parts, "_run").select("_run", F.struct(*by).alias("_by"), low.alias("_low"), high.alias("_high"), F.struct(*[c for c in df.columns if c != "_run"]).alias("_row"))
        number = F.row_number().over(Window.partitionBy("_run", "_by").orderBy("_low"))
        cut = rows.withColumn("_block", F.floor((number - 1) / F.lit(BLOCK_ROWS))).groupBy("_run", "_by", "_block")
        return cut.agg(F.min("_low").alias(f"{name}_low"), F.max("_high").alias(f"{name}_high"), F.collect_list("_row").alias(name)).drop("_by", "_block")

    moment, first, stop = F.col(at), F.col(start), F.coalesce(F.col(end), until)
    left = blocks(points.where(moment.isNotNull()).withColumn("_run", run(moment)), moment, moment, [bucket(moment)], "_p")
    right = blocks(intervals.where(first < stop).withColumn("_run", F.explode(F.sequence(run(first), run(stop)))), first, stop, [bucket(first), bucket(stop)], "_i")
    met = left.join(right, "_run").where((F.col("_p_high") >= F.col("_i_low")) & (F.col("_p_low") < F.col("_i_high"))).select("_p", "_i")
    met = met.observe(f"met-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))  # generated code ends here: it keeps all that comes of one input row, so of two blocks
    both = met.select(F.explode("_i").alias("_i"), "_p").select(F.inline("_p"), "_i").select(*points.columns, "_i.*")
    return both.where((moment >= first) & (moment < stop))


def origin_flags(a: DataFrame, b: DataFrame, on: list[str], names: tuple[str, str]) -> DataFrame:
    """The keys of both sources, each with a flag a source."""
    left, right = a.select(*on).distinct().withColumn(names[0], F.lit(True)), b.select(*on).distinct().withColumn(names[1], F.lit(True))
    return left.join(right, on, "full").select(*on, *[F.coalesce(n, F.lit(False)).alias(n) for n in names])


def daylight_intervals(changes: DataFrame, zone: str = "time_zone", start: str = "daylight_start", end: str = "daylight_end", standard: str = "standard_offset", daylight: str = "daylight_offset") -> DataFrame:
    """``zone, offset, valid_from, valid_to`` from daylight periods: each, and the standard time up to the next."""
    periods = changes.select(zone, F.col(start).alias("_s"), F.col(end).alias("_e"), standard, daylight)
    order = Window.partitionBy(zone).orderBy("_s")
    both = F.array(F.struct(F.col(daylight).alias("offset"), F.col("_s").alias("valid_from"), F.col("_e").alias("valid_to")), F.struct(F.col(standard).alias("offset"), F.col("_e").alias("valid_from"), F.lead("_s").over(order).alias("valid_to")))
    return periods.select(zone, both.alias("_both")).select(zone, F.explode("_both").alias("i")).select(zone, "i.*")


def pivot_fixed(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One column for each listed name, with its first value; other names are dropped."""
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value, ignorenulls=True))


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def as_object(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Key/value rows as one map a key, ordered by name; the last of equal names counts."""
    one = df.groupBy(*keys, name).agg(F.max(value).alias(value))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), F.col(value).alias("value"))))
    return one.groupBy(*keys).agg(F.map_from_entries(pairs).alias("object"))


def exact_median(df: DataFrame, group: str, value: str, ranges: int = 64) -> DataFrame:
    """``group, median``, exact; groups without a value are absent.

    Values are counted first; the ranges of each group that hold its middle ranks are found
    from the ranges' counts, and only their values are ranked: no task holds a whole group.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counted = written(counted, "values")
    bounds = sorted(set(counted.agg(F.percentile_approx("_v", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []))
    counted = counted.withColumn("_b", bucket_of(F.col("_v"), bounds))
    whole = Window.partitionBy(group)  # a row a range
    sums = counted.groupBy(group, "_b").agg(F.sum("_n").alias("_s"))
    sums = sums.withColumns({"_all": F.sum("_s").over(whole), "_before": F.coalesce(F.sum("_s").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = sums.where((F.col("_before") <= high) & (F.col("_before") + F.col("_s") > low)).select(F.col(group).alias("_g"), F.col("_b").alias("_mb"), "_before", low.alias("_low"), high.alias("_high"))
    rows = counted.join(F.broadcast(middle), (F.col(group).eqNullSafe(F.col("_g"))) & (F.col("_b") == F.col("_mb")))  # two rows a group
    order = Window.partitionBy(group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(order), F.lit(0)))
    held = [F.max(F.when((F.col("_from") <= F.col(m)) & (F.col("_from") + F.col("_n") > F.col(m)), F.col("_v"))) for m in ("_low", "_high")]
    return rows.groupBy(group).agg(((held[0] + held[1]) / 2).alias("median"))
