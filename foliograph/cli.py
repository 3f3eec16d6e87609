"""python -m foliograph.cli PATH [--out FOLDER] [--stdout]: reads files, writes results, ends with 0 (all verified), 1 (some to review) or 2 (some rejected, or none found)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from foliograph.operators.provenance import exit_code
from foliograph.plans.pipeline import process
from foliograph.sources.documents import document_files
from foliograph.sources.results import write


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("path")
    p.add_argument("--out", default="output")
    p.add_argument("--stdout", action="store_true", help="print the JSON texts instead of writing them")
    p.add_argument("--strict", action="store_true", help="raise for a file of an unknown format")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("foliograph").getOrCreate()
    done = process(spark, document_files(spark, a.path))
    if a.strict and (bad := done.docs.filter("format IS NULL").select("error").first()):
        raise ValueError(bad.error)
    if a.stdout:
        for r in done.results.select("json").toLocalIterator():
            print(r.json)
    else:
        write(done.results, a.out)
    for r in done.reports.groupBy("status").count().orderBy("status").collect():
        print(f"{r.status}: {r['count']}", file=sys.stderr)
    return int(exit_code(done.reports).first().exit_code)


if __name__ == "__main__":
    sys.exit(main())
