"""Build every mart (and optionally run every check) from stored raw tables.

    spark-submit -m funnelkit --raw DIR --out DIR [--format parquet|csv] [--test]

The counterpart of running and testing the project's models: intermediates
are materialised under ``spark.checkpoint.dir``, marts (and ``dq_report``)
are written to ``--out`` with full overwrite.  The session comes from the
submitting environment (cluster master, memory); only the engine's SQL
settings are applied.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.build import build_all
from .session import configure
from .sources.raw import read_csv_tables, read_parquet_tables, rejected_lines
from .sources.tables import write_table


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="funnelkit")
    p.add_argument("--raw", required=True, help="folder of experts/funnel_events/engagements/daily_channel_spend")
    p.add_argument("--out", required=True, help="folder for the mart tables")
    p.add_argument("--format", choices=["parquet", "csv"], default="parquet", help="format of the raw tables")
    p.add_argument("--keys", default="bigint", help="type of the key columns, e.g. string")
    p.add_argument("--skip-rejects", action="store_true", help="leave out CSV lines that can't be taken and write them to OUT/rejected_lines")
    p.add_argument("--test", action="store_true", help="also write dq_report, every data-quality check")
    args = p.parse_args(argv)
    spark = configure(SparkSession.builder.appName("funnelkit").getOrCreate())
    if args.format == "csv":
        raw = read_csv_tables(spark, args.raw, args.keys, rejects="skip" if args.skip_rejects else "fail")
    else:
        raw = read_parquet_tables(spark, args.raw, args.keys)
    built = build_all(spark, raw=raw, out_dir=args.out, run_tests=args.test)
    if args.format == "csv" and args.skip_rejects:
        write_table(rejected_lines(spark, args.raw, args.keys), f"{args.out}/rejected_lines")
    print("wrote", ", ".join(sorted(built)), "to", args.out)


if __name__ == "__main__":
    main()
