"""``python -m siftwell URL [QUERY] [--json] [--pages PARQUET]``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftwell.plans.prune import checked, prune
from siftwell.sources.fetch import PageSource
from siftwell.sources.pages import human


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m siftwell", description="Prune a page to compact Markdown.")
    p.add_argument("url", help="page to read")
    p.add_argument("query", nargs="?", default="", help="keep the sections that fit these words")
    p.add_argument("--json", action="store_true", dest="as_json", help="print JSON")
    p.add_argument("--pages", help="Parquet table of (url, html) to read instead of the network")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = SparkSession.builder.getOrCreate()
        if args.pages:
            pages = spark.read.parquet(args.pages).where(F.col("url") == args.url)
        else:
            spark.dataSource.register(PageSource)
            pages = spark.read.format("webpage").option("urls", args.url).load()
            failed = pages.where("fetch_error IS NOT NULL").first()
            if failed:
                raise RuntimeError(failed.fetch_error)
        row = checked(prune(pages, args.query), ignore_errors=False).first()
        if row is None:
            raise ValueError(f"no page {args.url}")
    except Exception as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    result = row.asDict(recursive=True)
    print(json.dumps(result, ensure_ascii=False, indent=2) if args.as_json else human(result))
    return 0
