"""``python -m sparkwarden TARGET``: the stages up to a target, over a ledger file or a synthetic sample."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession

from .plans.pipeline import TARGETS, Pipeline
from .sources import ledger


def main(argv: list[str] | None = None) -> Pipeline:
    parser = argparse.ArgumentParser(prog="sparkwarden", description=__doc__)
    parser.add_argument("target", choices=list(TARGETS))
    parser.add_argument("--data", help="folder of the ledger files; without it a synthetic sample is used")
    parser.add_argument("--variant", default="small", choices=list(ledger.VARIANTS))
    parser.add_argument("--rows", type=int, default=10_000, help="size of the synthetic sample")
    parser.add_argument("--out", help="folder for the results of every stage")
    parser.add_argument("--log-level", default="WARNING")
    given = parser.parse_args(argv)
    logging.basicConfig(level=given.log_level)
    spark = SparkSession.builder.appName("sparkwarden").getOrCreate()
    source = ledger.load(spark, given.data, given.variant) if given.data else ledger.synthetic(spark, given.rows)
    pipeline = Pipeline(spark, folder=given.out)
    made = pipeline.run_target(given.target, source)
    for name, value in made.items():
        print(name, "table" if isinstance(value, DataFrame) else type(value).__name__)
    return pipeline


if __name__ == "__main__":
    main()
