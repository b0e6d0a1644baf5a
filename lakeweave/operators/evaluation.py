"""Metrics of table sets and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.operators.rank import prf


def set_metrics(predicted: DataFrame, truth: DataFrame, group: str = "query", item: str = "table") -> DataFrame:
    """Per group: counts, precision, recall, F1, and the lists of false ones; metrics are null where nothing is true."""
    a = predicted.select(group, item).distinct().withColumn("_p", F.lit(True))
    b = truth.select(group, item).distinct().withColumn("_t", F.lit(True))
    both = a.join(b, [group, item], "full").select(group, item, F.coalesce("_p", F.lit(False)).alias("p"), F.coalesce("_t", F.lit(False)).alias("t"))
    counts = both.groupBy(group).agg(
        F.count_if(F.col("p") & F.col("t")).alias("tp"),
        F.count_if(F.col("p") & ~F.col("t")).alias("fp"),
        F.count_if(~F.col("p") & F.col("t")).alias("fn"),
        F.array_sort(F.collect_set(F.when(F.col("p") & ~F.col("t"), F.col(item)))).alias("false_positives"),
        F.array_sort(F.collect_set(F.when(~F.col("p") & F.col("t"), F.col(item)))).alias("false_negatives"),
    )
    some = F.col("tp") + F.col("fn") > 0
    out = prf(counts)
    return out.withColumns({m: F.when(some, F.col(m)) for m in ("precision", "recall", "f1")})


def macro(metrics: DataFrame) -> DataFrame:
    """Means and population deviations over the groups."""
    return metrics.agg(*[f(m).alias(f"{m}_{n}") for m in ("precision", "recall", "f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def stage_deltas(metrics: DataFrame) -> DataFrame:
    """Adds the change of each mean from the stage before (``stage`` number; a row a stage)."""
    from pyspark.sql import Window

    order = Window.orderBy("stage")
    return metrics.withColumns({f"{m}_delta": F.col(m) - F.lag(m).over(order) for m in ("precision", "recall", "f1")})


def undirected(edges: DataFrame, with_columns: bool = False) -> DataFrame:
    """Edges with their sides in the order of the table names."""
    swap = F.col("table1") > F.col("table2")
    cols = [F.least("table1", "table2").alias("u"), F.greatest("table1", "table2").alias("v")]
    if with_columns:
        cols += [F.when(swap, F.col("column2")).otherwise(F.col("column1")).alias("cu"), F.when(swap, F.col("column1")).otherwise(F.col("column2")).alias("cv")]
    keep = [c for c in edges.columns if c not in ("table1", "table2", "column1", "column2")]
    return edges.select(*keep, *cols).distinct()


def edge_recall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``recall``: the share of true edges found, in any direction; 0 without a true edge."""
    found = undirected(truth.select("table1", "table2")).join(undirected(predicted.select("table1", "table2")).withColumn("_hit", F.lit(1)), ["u", "v"], "left")
    return found.agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(0.0)).alias("recall"))


def edge_f1(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: ``tp, fp, fn, precision, recall, f1`` of edges with their columns; a true table pair with wrong
    columns is a false positive of its own, and its true edge stays unfound."""
    p, t = undirected(predicted, True).select("u", "v", "cu", "cv").withColumn("_p", F.lit(True)), undirected(truth, True).select("u", "v", "cu", "cv").withColumn("_t", F.lit(True))
    both = p.join(t, ["u", "v", "cu", "cv"], "full")
    hit, only_p, only_t = F.col("_p").isNotNull() & F.col("_t").isNotNull(), F.col("_t").isNull(), F.col("_p").isNull()
    return prf(both.agg(F.count_if(hit).alias("tp"), F.count_if(only_p).alias("fp"), F.count_if(only_t).alias("fn")))


def join_conditions(frame: DataFrame, column: str = "condition") -> DataFrame:
    """Adds ``table1, column1, table2, column2`` for each equality of "a.x = b.y AND ..."."""
    one = frame.withColumn("_c", F.explode(F.split(F.col(column), r"(?i)\s+and\s+")))
    part = r"^\s*[\"`]?([\w$]+)[\"`]?\.[\"`]?([\w$]+)[\"`]?\s*=\s*[\"`]?([\w$]+)[\"`]?\.[\"`]?([\w$]+)[\"`]?\s*$"
    names = ("table1", "column1", "table2", "column2")
    return one.withColumns({n: F.regexp_extract("_c", part, i + 1) for i, n in enumerate(names)}).where("table1 <> ''").drop("_c")


def name_mapping(pairs: Column) -> tuple[Column, Column]:
    """Both directions of "a-to-b" texts, as maps."""
    sides = F.transform(pairs, lambda p: F.split(p, "-to-", 2))
    sides = F.filter(sides, lambda s: F.size(s) == 2)
    return tuple(F.map_from_arrays(F.transform(sides, _side(i)), F.transform(sides, _side(1 - i))) for i in (0, 1))


def _side(i: int):
    return lambda s: s[i]


def folder_means(metrics: DataFrame, folder: str = "folder", value: str = "f1") -> DataFrame:
    return metrics.groupBy(folder).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("average"))


def token_estimate(text: Column) -> Column:
    """Words of a text, as an estimate of its tokens."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))
