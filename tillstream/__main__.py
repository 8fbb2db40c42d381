"""Command line of the job.

``PYTHONPATH=. spark-submit --packages org.apache.spark:spark-sql-kafka-0-10_2.13:4.1.2 tillstream/__main__.py``, where
the package has the version of the cluster's Spark. The master and all Spark settings come from ``spark-submit``.
"""

import argparse

from pyspark.sql import SparkSession

from tillstream.plans import run_job
from tillstream.settings import BROKER, OUTPUT_PATH


def _option(text: str) -> tuple[str, str]:
    name, equals, value = text.partition("=")
    if not name or not equals:
        raise argparse.ArgumentTypeError(f"expected NAME=VALUE, got {text!r}")
    return name, value


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tillstream", description="Invoice topic to notifications and line items")
    parser.add_argument("--broker", default=BROKER)
    parser.add_argument("--output", default=OUTPUT_PATH, help="folder of the line-item JSON files")
    parser.add_argument("--checkpoints", help="default: in the folder named by spark.checkpoint.dir")
    for end in ("source", "sink"):
        parser.add_argument(
            f"--{end}-option", type=_option, action="append", default=[], metavar="NAME=VALUE", help=f"Kafka {end} option"
        )
    return parser.parse_args(argv)


def main() -> None:
    args = arguments()
    run_job(
        SparkSession.builder.appName("tillstream").getOrCreate(),
        broker=args.broker,
        output=args.output,
        checkpoints=args.checkpoints,
        source_options=dict(args.source_option),
        sink_options=dict(args.sink_option),
    )


if __name__ == "__main__":
    main()
