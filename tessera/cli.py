"""Command line: run a query of the catalog over a folder of tables, or list them."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from tessera.plans import catalog
from tessera.shared import ship


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("query", nargs="?", help="name of a query; without one, all names are listed")
    parser.add_argument("folder", nargs="?", help="folder with one Parquet table a name")
    parser.add_argument("--out", help="write the result as Parquet instead of showing it")
    parser.add_argument("--module", action="append", default=[], help="a module with more queries, as its function queries() gives them; may be repeated")
    args = parser.parse_args(argv)
    queries = catalog.queries()
    for name in args.module:
        queries |= importlib.import_module(name).queries()
    if not args.query:
        print("\n".join(queries))
        return 0
    if args.query not in queries or not args.folder:
        parser.print_help()
        return 1
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    ship(spark)
    result = queries[args.query](spark, args.folder)
    result.write.parquet(args.out) if args.out else result.show(20, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
