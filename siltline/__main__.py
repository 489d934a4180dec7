"""Runs a query over the Parquet tables of a folder: python -m siltline --tables DIR "SELECT ..."."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from siltline.plans.engine import bind, check, prepare
from siltline.plans.errors import QueryError


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="siltline", description=__doc__)
    parser.add_argument("query", nargs="?", help="the query")
    parser.add_argument("--query-file", help="a file that holds the query")
    parser.add_argument("--param", action="append", default=[], metavar="NAME=VALUE", help="a value for :NAME")
    parser.add_argument("--tables", help="the folder with NAME.parquet tables")
    parser.add_argument("--output", help="the folder to write to; without it rows are printed")
    parser.add_argument("--format", default="auto", choices=["auto", "lines", "jsonl", "csv", "tsv", "ids", "urls"])
    parser.add_argument("--filter", help="a further condition")
    parser.add_argument("--sort", help="another order")
    parser.add_argument("--desc", action="store_true", help="sort from high to low")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--rev", action="store_true", help="turn the order of the source round")
    parser.add_argument("--exclude-live", action="store_true")
    parser.add_argument("--exclude-upcoming", action="store_true")
    parser.add_argument("--check-query", action="store_true", help="print the canonical form and stop")
    parser.add_argument("--explain", action="store_true", help="print what the query means and stop")
    parser.add_argument("--explain-analyze", action="store_true", help="run it, print a report instead of rows")
    parser.add_argument("--master", default="local[*]")
    return parser


def main(argv: list[str] | None = None) -> int:
    parser = arguments()
    args = parser.parse_args(argv)
    if (args.query is None) == (args.query_file is None):
        parser.error("give either a query or --query-file")
    text = args.query if args.query is not None else Path(args.query_file).read_text(encoding="utf-8")
    if any("=" not in p for p in args.param):
        parser.error("--param needs NAME=VALUE")
    parameters = [p.split("=", 1) for p in args.param]
    if len({n.lower() for n, _ in parameters}) < len(parameters):
        parser.error("a parameter is given twice")
    try:
        if args.check_query:
            print(check(bind(text, dict(parameters))))
            return 0
        from pyspark.sql import SparkSession

        from siltline.operators import exchange
        from siltline.plans.report import analyse, report
        from siltline.sources.catalog import table_catalog

        spark = SparkSession.builder.master(args.master).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
        names = [p.name.removesuffix(".parquet") for p in sorted(Path(args.tables).glob("*.parquet"))] if args.tables else []
        shortcuts = {k: v for k, v in (("filter", args.filter), ("sort", args.sort), ("descending", args.desc), ("limit", args.limit), ("exclude_live", args.exclude_live), ("exclude_upcoming", args.exclude_upcoming)) if v}
        plan = prepare(text, table_catalog(spark, args.tables or ".", names or None), dict(parameters), reverse=args.rev, **shortcuts)
        if args.explain:
            print(json.dumps(plan.explain(), ensure_ascii=False, indent=2))
        elif args.explain_analyze:
            print(report(analyse(plan)))
        elif args.output:
            exchange.write(plan.frame(ordered=True), args.output, args.format)
        else:
            for row in exchange.as_json_lines(plan.frame(ordered=True)).toLocalIterator():
                print(row["value"])
        return 0
    except QueryError as e:
        print(e.pretty(), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
