"""Reviews of tables and edges, behind an interface, with deterministic defaults."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.names import likely_key


class Judge(Protocol):
    """Decides on tables (``query, table, columns``) and on candidate edges; frames in, frames out."""

    def keep(self, tables: DataFrame) -> DataFrame: ...

    def supplement(self, unselected: DataFrame) -> DataFrame: ...

    def edges(self, candidates: DataFrame) -> DataFrame: ...

    def excluded(self, edges: DataFrame) -> DataFrame: ...


def likely_keys(columns: DataFrame, most: int = 10) -> DataFrame:
    """``table, keys``: up to ``most`` columns that look like keys, in column order."""
    keys = columns.where(likely_key(F.col("column"))).withColumn("_r", F.row_number().over(Window.partitionBy("table").orderBy("ordinal"))).where(F.col("_r") <= most)
    return keys.groupBy("table").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "column"))), lambda k: k["column"]).alias("keys"))


class LexicalJudge:
    """Keeps tables that share a term with the request, adds tables that share two, and takes an edge for a
    join if its columns are of one family, of like lengths, and overlap in range or value."""

    def __init__(self, terms, add_terms: int = 2):
        self.terms, self.add_terms = terms, add_terms

    def shared(self) -> Column:
        words = F.flatten(F.transform(F.array_union(F.col("columns"), F.array("table")), lambda c: F.split(F.lower(c), "[^a-z0-9]+")))
        return F.size(F.array_intersect(self.terms(F.col("query")), words))

    def keep(self, tables: DataFrame) -> DataFrame:
        return tables.withColumn("keep", self.shared() > 0)

    def supplement(self, unselected: DataFrame) -> DataFrame:
        return unselected.withColumn("add", self.shared() >= self.add_terms)

    def edges(self, candidates: DataFrame) -> DataFrame:
        lengths = F.coalesce(F.try_divide(F.least("length_avg1", "length_avg2"), F.greatest("length_avg1", "length_avg2")), F.lit(0.0))
        holds = (F.col("is_numeric1") == F.col("is_numeric2")) & (lengths >= 0.5) & ((F.col("max_containment") > 0) | (F.col("range_overlap") > 0))
        return candidates.withColumn("is_join", holds)

    def excluded(self, edges: DataFrame) -> DataFrame:
        return edges.limit(0)  # kept when in doubt


def keep_step(tables: DataFrame, judge: Judge, overrides: DataFrame | None = None) -> DataFrame:
    """``query, table`` kept.  An explicit list (``query, table``) of a request goes before the decisions;
    where nothing of a request is kept, all of it is: a failed review drops no table."""
    decided = judge.keep(tables)
    if overrides is not None:
        listed = overrides.select("query").distinct().withColumn("_has", F.lit(True))
        named = overrides.select("query", "table").distinct().withColumn("_named", F.lit(True))
        decided = decided.join(listed, "query", "left").join(named, ["query", "table"], "left").withColumn("keep", F.when(F.col("_has"), F.coalesce("_named", F.lit(False))).otherwise(F.col("keep")))
    some = F.max(F.col("keep").cast("int")).over(Window.partitionBy("query"))
    return decided.withColumn("_some", some).where("keep or _some = 0").select("query", "table")


def supplement_step(selected: DataFrame, everything: DataFrame, judge: Judge, most: int = 40) -> DataFrame:
    """``query, table``: the selected ones, and those the judge adds from up to ``most`` others a request."""
    rest = everything.join(selected.select("query", "table"), ["query", "table"], "left_anti")
    rest = rest.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("table"))).where(F.col("_r") <= most).drop("_r")
    return selected.select("query", "table").unionByName(judge.supplement(rest).where("add").select("query", "table"))


def group_specs(specs: DataFrame) -> DataFrame:
    """``table1, table2, pairs``: column pairs of each table pair, however the sides are stored."""
    swap = F.col("table1") > F.col("table2")
    sides = specs.select(F.least("table1", "table2").alias("table1"), F.greatest("table1", "table2").alias("table2"), F.struct(F.when(swap, F.col("column2")).otherwise(F.col("column1")).alias("column1"), F.when(swap, F.col("column1")).otherwise(F.col("column2")).alias("column2")).alias("pair"))
    return sides.groupBy("table1", "table2").agg(F.array_sort(F.collect_set("pair")).alias("pairs"))


def join_type(overlap: Column, contained1: Column, contained2: Column, header_jaccard: Column) -> Column:
    """INNER where values overlap fully one way or both, LEFT where only part matches, UNION where the headers do."""
    return F.when(header_jaccard >= 0.8, "UNION").when((overlap > 0) & (F.greatest(contained1, contained2) >= 0.95), "INNER").when(overlap > 0, "LEFT")


def same_entity(pairs: DataFrame, left: dict[str, str], right: dict[str, str]) -> DataFrame:
    """Adds ``same``: whether both columns of a pair map to one name by two name mappings."""

    def mapped(names: dict[str, str], column: str) -> Column:
        flat: Iterable[Column] = [F.lit(x) for pair in names.items() for x in pair]
        return F.try_element_at(F.create_map(*flat), F.col(column)) if names else F.lit(None)

    return pairs.withColumn("same", F.coalesce(mapped(left, "column1") == mapped(right, "column2"), F.lit(False)))
