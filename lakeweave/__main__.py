"""Command line: ``python -m lakeweave COMMAND FOLDER ...`` over a folder of CSV tables."""

from __future__ import annotations

import argparse

from lakeweave.operators import candidates, features, overlap, profile
from lakeweave.plans.joinplan import sql_text, tree_edges
from lakeweave.session import session
from lakeweave.sources.catalog import VersionedCatalog, csv_text, run_sql
from lakeweave.sources.lake import load_lake
from lakeweave.sources.shared import written


def scored_pairs(tables):
    """The rule scorer's probabilities of all column pairs."""
    counts = written(profile.lake_counts(tables), "counts")
    prof = profile.profiles(counts)
    return candidates.RuleScorer().score(features.pair_features(counts, prof, profile.column_text(prof, profile.frequent_values(counts))))


def main(argv: list[str] | None = None, spark=None) -> None:
    parser = argparse.ArgumentParser(prog="lakeweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("profile", "profile all columns"), ("overlap", "overlap of two columns"), ("candidates", "best column pairs a table pair"), ("tree", "the minimal join of some tables, as SQL"), ("sql", "run a statement")):
        commands.add_parser(name, help=text).add_argument("folder")
    commands.choices["overlap"].add_argument("columns", nargs=2, metavar="TABLE.COLUMN")
    commands.choices["candidates"].add_argument("--top", type=int, default=6)
    commands.choices["tree"].add_argument("tables", nargs="+")
    commands.choices["sql"].add_argument("statement")
    commands.choices["sql"].add_argument("--output", default="direct")
    args = parser.parse_args(argv)
    spark = spark or session()
    tables, errors = load_lake(spark, args.folder)
    for name, error in errors.items():
        print(f"skipped {name}: {error}")
    if args.command == "profile":
        print(csv_text(profile.profile_lake(tables).orderBy("table", "ordinal").drop("top_values")), end="")
    elif args.command == "overlap":
        (t1, c1), (t2, c2) = (c.split(".", 1) for c in args.columns)
        print(csv_text(overlap.overlap_coefficient(tables[t1], c1, tables[t2], c2)), end="")
    elif args.command == "candidates":
        best = candidates.top_per_table_pair(scored_pairs(tables), args.top)
        print(csv_text(best.select(*candidates.PAIR, "prob", "rank").orderBy("table1", "table2", "rank")), end="")
    elif args.command == "tree":
        best = candidates.top_per_table_pair(scored_pairs(tables), 1).select(*candidates.PAIR, "prob")
        print(sql_text(tree_edges([tuple(r) for r in best.collect()], args.tables)))
    else:
        VersionedCatalog(spark, tables)
        print(run_sql(spark, args.statement, args.output), end="")


if __name__ == "__main__":
    main()
