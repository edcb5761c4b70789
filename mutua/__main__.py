"""Command line: ``python -m mutua detect --input trace.json [--output out]`` or ``python -m mutua query NAME FOLDER``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from mutua.operators import detector
from mutua.plans.registry import queries
from mutua.sources import readers
from mutua.storage import remove_scratch


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="mutua", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("detect", help="find clusters with boundaries in a trace")
    one.add_argument("--input", required=True)
    one.add_argument("--output")
    one.add_argument("--clusters", type=int, default=8)
    one.add_argument("--tolerance", type=float, default=0.1)
    one.add_argument("--adaptive", action="store_true")
    two = commands.add_parser("query", help="run a registered query over a folder of tables")
    two.add_argument("name", choices=sorted(queries()))
    two.add_argument("folder")
    two.add_argument("--output")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("mutua").getOrCreate()
    if args.command == "query":
        out = queries()[args.name](spark, args.folder)
    else:
        out = detector.detect(readers.read_records(spark, args.input), most=args.clusters, tolerance=args.tolerance)
        if args.adaptive:
            out = out.join(detector.choose_k(out).select("trace_id", "k"), ["trace_id", "k"], "left_semi")
    if args.output:
        print(readers.write_result(out, args.output))
    else:
        out.show(50, truncate=False)
    remove_scratch(spark)


if __name__ == "__main__":
    main()
