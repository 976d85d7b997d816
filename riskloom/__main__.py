"""The jobs from the command line, for ``spark-submit`` or ``python -m riskloom``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions import labels as L
from riskloom.operators import forest
from riskloom.plans import jobs, monthly
from riskloom.session import SETTINGS, temporary
from riskloom.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="riskloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    build = commands.add_parser("build", help="build the stored tables from raw Parquet tables")
    build.add_argument("users")
    build.add_argument("orders")
    build.add_argument("tables")

    load = commands.add_parser("load", help="load or correct months of the stored tables")
    load.add_argument("users")
    load.add_argument("orders")
    load.add_argument("tables")
    load.add_argument("--months", nargs="*", metavar="YYYY-MM", help="all months by default")

    report = commands.add_parser("report", help="write every figure as a table")
    report.add_argument("tables")
    report.add_argument("out")
    report.add_argument("--min-sample", type=int, default=L.MIN_SAMPLE)

    train = commands.add_parser("train", help="train, evaluate and store the model")
    train.add_argument("tables")
    train.add_argument("model")

    score = commands.add_parser("score", help="score every customer with the stored model")
    score.add_argument("tables")
    score.add_argument("model")
    score.add_argument("out")

    for command in (build, report, train, score):
        command.add_argument("--csv", action="store_true", help="the stored tables are CSV")
    return top


def show(frames: dict[str, DataFrame]) -> None:
    """Print the evaluation of a model: one row, and ten."""
    for name, df in frames.items():
        print(name)
        df.show(df.count(), truncate=False)


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("riskloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()

    if args.command == "build":
        users, orders = (spark.read.parquet(path) for path in (args.users, args.orders))
        jobs.build_tables(users, orders, args.tables, args.csv)
        return
    if args.command == "load":
        users, orders = (spark.read.parquet(path) for path in (args.users, args.orders))
        months = args.months and [date.fromisoformat(f"{month}-01") for month in args.months]
        for name, written in monthly.load_months(users, orders, args.tables, months).items():
            print(name, "all months" if written is None else " ".join(map(str, written)))
        return
    tables = jobs.load_tables(spark, args.tables, args.csv)
    clients = tables["features_modeling"]
    if args.command == "report":
        with temporary(spark):
            figures = jobs.risk_report(clients, tables["orders_modeling"], args.min_sample)
            for name, df in figures.items():
                files.write_parquet(df, f"{args.out}/{name}")
                print(f"{args.out}/{name}")
    elif args.command == "train":
        show(jobs.train_model(clients, args.model))
    else:
        model, threshold = forest.load(spark, args.model)
        files.write_parquet(forest.flag_customers(model, threshold, clients), args.out)


if __name__ == "__main__":
    main()
