"""The project's tables, one delivery per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_delivery(df: DataFrame, key: str, columns: dict[str, Column], order: str = "loaded_at") -> DataFrame:
    """One row per ``key``: the columns of its latest delivery by ``order``.

    A null key is no key and is dropped. Deliveries of the same moment are told apart by their content, the greatest
    winning, so the result does not depend on the order of rows. Nulls in other columns are kept as they are."""
    narrow = df.select(F.col(key), F.col(order).alias("__at"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("__row"))
    last = narrow.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("__at", "__row")).alias("__last"))
    return last.select(key, *[F.col(f"__last.__row.{n}").alias(n) for n in columns])


def prop(name: str) -> Column:
    """A property of a Feature, null where the map or the key is absent."""
    return F.col("properties")[name]


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone; the session's zone plays no part."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at.cast("timestamp_ntz"))
