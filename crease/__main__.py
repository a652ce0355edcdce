"""Run reports from the command line and write them as parquet.

    spark-submit -m crease --deliveries s3://…/deliveries.csv --matches s3://…/matches.csv \\
        --format csv --out s3://…/reports [--reports top_runs,run_rate_matrix] [--list]

The session comes from the submitting environment (``getOrCreate``); the
library sets no master and no cluster configuration.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.catalog import QUERIES
from .plans.report import run_report
from .sources import files
from .sources.adapter import Tables


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="crease", description=__doc__.splitlines()[0])
    ap.add_argument("--deliveries", help="deliveries CSV file/folder or parquet folder")
    ap.add_argument("--matches", help="matches CSV file/folder or parquet folder")
    ap.add_argument("--format", choices=["csv", "parquet"], default="parquet")
    ap.add_argument("--null-value", default="NA", help="CSV text read as NULL (empty cells always are)")
    ap.add_argument("--out", help="output folder; one parquet folder per report")
    ap.add_argument("--reports", default="", help="comma-separated report names (default: all)")
    ap.add_argument("--stage", action="store_true", help="write the source once as parquet and read that in every report")
    ap.add_argument("--list", action="store_true", help="print report names and exit")
    args = ap.parse_args(argv)

    if args.list:
        print("\n".join(QUERIES))
        return 0
    if not (args.deliveries and args.matches and args.out):
        ap.error("--deliveries, --matches and --out are required")

    spark = SparkSession.builder.appName("crease").getOrCreate()
    if args.format == "csv":
        tables = Tables(files.read_deliveries_csv(spark, args.deliveries, null_value=args.null_value),
                        files.read_matches_csv(spark, args.matches, null_value=args.null_value))
    else:
        tables = Tables(spark.read.parquet(args.deliveries), spark.read.parquet(args.matches))
    names = [n for n in args.reports.split(",") if n] or None
    for name, path in run_report(spark, tables, args.out, names, stage=args.stage).items():
        print(f"{name}\t{path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
