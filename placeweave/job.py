"""The whole run from a command line: Features in, one JSON response each out.

``spark-submit placeweave/job.py FILES... -o FOLDER [options]``; the options are those of :class:`DedupeConfig`."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from placeweave.config import DedupeConfig
from placeweave.plans.pipelines import resolve
from placeweave.session import clear_scratch
from placeweave.sources import geojson


def run(spark: SparkSession, argv: list[str]) -> None:
    config, files, out = DedupeConfig.from_args(argv)
    features = geojson.with_guid(geojson.with_uid(geojson.read_any(spark, files)))
    geojson.write_json_lines(resolve(features, config), out)


def main() -> None:
    spark = SparkSession.builder.appName("placeweave").getOrCreate()
    try:
        run(spark, sys.argv[1:])
    finally:
        clear_scratch(spark)


if __name__ == "__main__":
    main()
