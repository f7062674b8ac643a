"""``spark-submit`` entry: ``list`` names the queries, ``run`` writes one as Parquet, ``validate`` checks the tables that queries read."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from scoutframe.operators.validate import Guard
from scoutframe.plans import registry
from scoutframe.sources.tables import read

#: Tables that queries read, and a column of each that no row may lack.
TABLES = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id"}


def validated(spark: SparkSession, folder: str) -> Guard:
    """What the tables of a folder must hold: rows, and a key in each."""
    guard = Guard()
    for name, key in TABLES.items():
        rows = read(spark, folder, name)
        guard.expect(f"{name} has rows", not rows.isEmpty())
        guard.expect_none(f"{name} has keys", rows.where(rows[key].isNull()))
    return guard


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scoutframe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name", choices=sorted(registry.QUERIES), metavar="NAME")
    run.add_argument("folder", help="where the tables lie")
    run.add_argument("out", help="a folder that is not there yet")
    commands.add_parser("validate").add_argument("folder")
    chosen = parser.parse_args(arguments)
    if chosen.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("scoutframe").getOrCreate()
    if chosen.command == "run":
        registry.QUERIES[chosen.name](spark, chosen.folder).write.mode("errorifexists").parquet(chosen.out)
        return 0
    guard = validated(spark, chosen.folder)
    print("\n".join(guard.report()))
    return int(any(hard and not ok for _, ok, hard in guard.results))


if __name__ == "__main__":
    raise SystemExit(main())
