"""python -m tagloom.cli: the stages from the command line."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from tagloom.plans.stages import Project
from tagloom.sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tagloom", description="Barcode analytics on Spark.")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("-o", "--outputlog", help="write the log to this file")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, out: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        if out:
            c.add_argument("--outdir", required=True)
        return c

    c = command("demultiplex", "extract and count barcode combinations")
    c.add_argument("input")
    c.add_argument("--regex-file", required=True)
    c.add_argument("--barcode-file", "--barcode-hierarchy-file", required=True)
    c.add_argument("--debug", action="store_true")
    c = command("error-correct", "correct random barcodes")
    c.add_argument("--error-threshold", type=int, default=1)
    c.add_argument("--barcode-file", "--barcode-hierarchy-file", required=True)
    c.add_argument("--remove-ambigious", "--remove-ambiguous", dest="remove", action="store_true")
    c.add_argument("--keep-ambigious", "--keep-ambiguous", dest="remove", action="store_false")
    c = command("hopping-removal", "remove combinations that index hopping explains")
    c.add_argument("barcodes", nargs="+", help="sets of hopping barcodes, each joined by commas")
    c.add_argument("--threshold", type=float, default=0.05)
    c = command("threshold", "apply read thresholds")
    c.add_argument("--threshold-file", required=True)
    c = command("pvalue", "bootstrap p-values and fold changes")
    c.add_argument("--category-file", required=True)
    c.add_argument("--read-file")
    c.add_argument("--reads-column", default="reads")
    c.add_argument("--group-by", action="append")
    c.add_argument("--N", type=int, default=1_000_000)
    c.add_argument("--max-n", type=int, default=950)
    c.add_argument("--seed", type=int, default=0)
    c = command("merge", "sum several tables of combinations", out=False)
    c.add_argument("tables", nargs="+")
    c.add_argument("--out", required=True)
    for name, text in (("to-csv", "Parquet to CSV"), ("to-parquet", "CSV to Parquet")):
        c = command(name, text, out=False)
        c.add_argument("source")
        c.add_argument("target", nargs="?")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, filename=a.outputlog)
    spark = spark or SparkSession.builder.appName("tagloom").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    if a.command == "to-csv":
        tables.to_csv(spark, a.source, a.target)
    elif a.command == "to-parquet":
        tables.to_parquet(spark, a.source, a.target)
    elif a.command == "merge":
        from tagloom.operators.combos import combine

        tables.write_parquet(combine([tables.read_table(spark, t) for t in a.tables]), a.out)
    else:
        p = Project(spark, a.outdir)
        if a.command == "demultiplex":
            p.demultiplex(a.input, a.regex_file, a.barcode_file)
        elif a.command == "error-correct":
            p.error_correct(a.barcode_file, a.error_threshold, bool(a.remove))
        elif a.command == "hopping-removal":
            p.hopping_removal([s.split(",") for s in a.barcodes], a.threshold)
        elif a.command == "threshold":
            p.threshold(a.threshold_file)
        else:
            p.pvalue(a.category_file, a.read_file, a.reads_column, tuple(a.group_by or ["grna"]), a.N, a.max_n, a.seed)


if __name__ == "__main__":
    main()
