"""Validated key repairs over versioned tables, with a log and rollback."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from lakeweave.operators.overlap import overlap_coefficient
from lakeweave.sources.catalog import VersionedCatalog

Repair = Callable[[DataFrame], dict[str, Column]]


@dataclass
class RepairSession:
    """Repairs join keys of one catalog.  Every step is a new version; one that doesn't raise the overlap is dropped."""

    catalog: VersionedCatalog
    log: list[tuple] = field(default_factory=list)

    def overlap(self, left: str, column1: str, right: str, column2: str) -> float:
        return overlap_coefficient(self.catalog.current(left), column1, self.catalog.current(right), column2).first()["overlap"]

    def validate(self, left: str, column1: str, right: str, column2: str, repairs: list[tuple[str, str, Repair]], most: int = 10) -> float:
        """Tries ``(name, table, repair)`` in turn.  Nothing is done where values already overlap; a repair is kept
        iff the overlap rises, else only its version goes.  Each call has a step budget of its own."""
        before = self.overlap(left, column1, right, column2)
        if before > 0:
            return before
        for name, table, repair in repairs[:most]:
            df = self.catalog.current(table)
            self.catalog.add_version(table, df.withColumns(repair(df)))
            after = self.overlap(left, column1, right, column2)
            kept = after > before
            self.log.append((len(self.log) + 1, table, self.catalog.version(table), name, before, after, kept))
            if kept:
                before = after
            else:
                self.catalog.drop_latest(table)
        return before

    def log_frame(self) -> DataFrame:
        return self.catalog.spark.createDataFrame(self.log, "step int, base string, version int, op string, before double, after double, kept boolean")
