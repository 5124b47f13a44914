"""Command line: ``spark-submit --py-files … martlens/__main__.py <job> …``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from martlens import jobs
from martlens.session import tune


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="martlens")
    commands = parser.add_subparsers(dest="job", required=True)

    publish = commands.add_parser("publish", help="CSV exports to published tables")
    publish.add_argument("--exports", required=True)
    publish.add_argument("--tables", required=True)
    publish.add_argument("--rejects", help="folder for malformed rows, which else stop the load")
    publish.add_argument("--max-rejected", type=float, default=0.001, help="share of a table's rows")

    reports = commands.add_parser("reports", help="write all reports and visuals")
    churn = commands.add_parser("churn", help="train, evaluate and export churn predictions")
    score = commands.add_parser("score", help="export predictions by a trained model")
    score.add_argument("--fitted", required=True, help="output folder of the churn job")
    for command in (reports, churn, score):
        command.add_argument("--tables", required=True)
        command.add_argument("--output", required=True)
        command.add_argument("--as-of", default="2024-12-31", help="reference day, ISO format")
    reports.add_argument("--predictions", help="folder of exported churn predictions")

    reports.add_argument("--cube", help="folder that keeps the partial sums of the orders")

    options = parser.parse_args(arguments)
    spark = tune(SparkSession.builder.appName(f"martlens-{options.job}").getOrCreate())
    if options.job == "publish":
        jobs.publish_exports(
            spark, options.exports, options.tables, options.rejects, options.max_rejected
        )
    elif options.job == "reports":
        jobs.write_reports(
            spark, options.tables, options.output, options.as_of, options.predictions,
            options.cube,
        )
    elif options.job == "score":
        jobs.score_customers(
            spark, options.tables, options.fitted, options.output, options.as_of
        )
    else:
        jobs.run_churn_model(spark, options.tables, options.output, options.as_of)


if __name__ == "__main__":
    main()
