"""Join candidates: scoring column pairs, the best few a table pair, and edge weights."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.sources.shared import written

PAIR = ["table1", "column1", "table2", "column2"]
#: Weight of an edge whose probability is not positive.
NO_EDGE = 100.0


class Scorer(Protocol):
    """Adds ``prob`` to a frame of pair features."""

    def score(self, features: DataFrame) -> DataFrame: ...


class RuleScorer:
    """Default without labels: a weighted sum of containment, name likeness, header or vector likeness, and
    agreement of type and length, through a logistic curve."""

    def __init__(self, weights: tuple[float, float, float, float] = (0.5, 0.2, 0.15, 0.15), middle: float = 0.5, slope: float = 10.0):
        self.weights, self.middle, self.slope = weights, middle, slope

    def score(self, features: DataFrame) -> DataFrame:
        name = F.greatest("token_sort_ratio", "edit_ratio")
        header = F.greatest("header_jaccard", "column_similarity")
        lengths = F.coalesce(F.try_divide(F.least("length_avg1", "length_avg2"), F.greatest("length_avg1", "length_avg2")), F.lit(0.0))
        agree = F.when(F.col("is_numeric1") == F.col("is_numeric2"), lengths).otherwise(F.lit(0.0))
        total = sum((F.lit(w) * x for w, x in zip(self.weights, (F.col("max_containment"), name, header, agree), strict=True)), F.lit(0.0))
        return features.withColumn("prob", 1 / (1 + F.exp(F.lit(-self.slope) * (total - self.middle))))


def top_per_table_pair(scored: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` most probable column pairs of each table pair, probability above 0; ties by column names."""
    rank = F.row_number().over(Window.partitionBy("table1", "table2").orderBy(F.desc("prob"), "column1", "column2"))
    return scored.where("prob > 0").withColumn("rank", rank).where(F.col("rank") <= k)


def top_overall(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("prob"), *PAIR).limit(k)


def best_pair(scored: DataFrame, table1: str, table2: str) -> DataFrame:
    """The most probable column pair between two tables, whichever way they are stored."""
    either = F.expr(f"(table1 = '{table1}' and table2 = '{table2}') or (table1 = '{table2}' and table2 = '{table1}')")
    return scored.where(either).agg(F.max_by(F.struct(*PAIR, "prob"), F.struct("prob", F.lit(1))).alias("best")).select("best.*")


def pair_probability(scored: DataFrame, text: str) -> DataFrame:
    """Probability of a pair written "table1.column1 ↔ table2.column2", either way round."""
    left, right = (side.strip().split(".", 1) for side in text.replace("<->", "↔").split("↔"))
    ways = [[*left, *right], [*right, *left]]
    hit = None
    for t1, c1, t2, c2 in ways:
        this = (F.col("table1") == t1) & (F.col("column1") == c1) & (F.col("table2") == t2) & (F.col("column2") == c2)
        hit = this if hit is None else hit | this
    return scored.where(hit).select(*PAIR, "prob")


def edge_weight(prob: Column) -> Column:
    return F.when(prob > 0, -F.log(prob)).otherwise(F.lit(NO_EDGE))


def negative_pairs(profile: DataFrame, positives: DataFrame, ratio: float = 0.75, cap: int | None = 10_000, same_names: bool = False, seed: int = 42) -> DataFrame:
    """Column pairs that are no known join, drawn at random so that they make up ``ratio`` of all samples.

    Drawn by a seeded hash, so a retried task draws the same rows.
    """
    a, b = (profile.select(F.col("table").alias(f"table{s}"), F.col("column").alias(f"column{s}")) for s in ("1", "2"))
    pairs = a.join(b, F.expr("table1 < table2" + ("" if same_names else " and lower(column1) <> lower(column2)")))
    both = positives.select(*PAIR).unionByName(positives.select(F.col("table2").alias("table1"), F.col("column2").alias("column1"), F.col("table1").alias("table2"), F.col("column1").alias("column2")))
    rest = pairs.join(both, PAIR, "left_anti")
    n = round(positives.count() * ratio / (1 - ratio))
    n = n if cap is None else min(n, cap)
    return rest.orderBy(F.xxhash64(*PAIR, F.lit(seed)), *PAIR).limit(n).withColumn("label", F.lit(0))


def transitive_labels(positives: DataFrame) -> DataFrame:
    """Adds every pair of different tables within a connected component of positive column pairs."""
    nodes = positives.select(F.struct(F.col("table1").alias("t"), F.col("column1").alias("c")).alias("a"), F.struct(F.col("table2").alias("t"), F.col("column2").alias("c")).alias("b"))
    edges = nodes.unionByName(nodes.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = edges.select("a").distinct().withColumn("label", F.col("a"))
    while True:  # columns of the lake, so few; stops when no label falls
        near = edges.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, "a").select("a", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("fell"))
        new = written(new, "labels")  # cuts the rounds' lineage
        done = new.where("fell").isEmpty()
        labels = new.drop("fell")
        if done:
            break
    x, y = labels.alias("x"), labels.alias("y")
    pairs = x.join(y, F.expr("x.label = y.label and x.a.t < y.a.t"))
    return pairs.select(F.col("x.a.t").alias("table1"), F.col("x.a.c").alias("column1"), F.col("y.a.t").alias("table2"), F.col("y.a.c").alias("column2"), F.lit(1).alias("label"))
