"""Word indexes on disk: tab-separated text that other tools read too, and Parquet by tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_tfidf(frequencies: DataFrame, total: DataFrame, path: str) -> None:
    """Lines ``t:<word> TAB <df>`` and one ``N TAB <documents>``; ``total`` is one row, one column."""
    words = frequencies.select(F.concat_ws("\t", F.concat(F.lit("t:"), "word"), F.col("df").cast("string")).alias("value"))
    n = total.select(F.concat_ws("\t", F.lit("N"), F.col(total.columns[0]).cast("string")).alias("value"))
    words.unionByName(n).write.text(path)


def load_tfidf(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``word, df`` and ``n``; the counts of several indexes add up. Lines of any other form are ignored."""
    parts = spark.read.text(paths).select(F.split("value", "\t").alias("p")).filter(F.size("p") == 2).select(F.col("p")[0].alias("k"), F.col("p")[1].try_cast("bigint").alias("v")).filter("v IS NOT NULL")
    words = parts.filter(F.col("k").startswith("t:")).select(F.substr("k", F.lit(3)).alias("word"), "v").groupBy("word").agg(F.sum("v").alias("df"))
    return words, parts.filter("k = 'N'").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("n"))


def tfidf_json(frequencies: DataFrame, total: DataFrame) -> DataFrame:
    """One row ``json`` with ``N`` and ``idf_counts``. A JSON text is one value by definition: it is for small indexes."""
    body = frequencies.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "df")))).alias("idf_counts"))
    return body.select(F.to_json(F.struct(total.select(total.columns[0]).scalar().alias("N"), "idf_counts")).alias("json"))


def save_info_gain(gains: DataFrame, path: str) -> None:
    """Lines ``<word> TAB <gain>``."""
    gains.select(F.concat_ws("\t", "word", F.col("gain").cast("string")).alias("value")).write.text(path)


def load_info_gain(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    parts = spark.read.text(paths).select(F.split("value", "\t").alias("p")).filter(F.size("p") == 2)
    return parts.select(F.col("p")[0].alias("word"), F.col("p")[1].try_cast("double").alias("gain")).filter("gain IS NOT NULL")


def save_by_tile(index: DataFrame, path: str, tile: str = "geo") -> None:
    """Parquet, rows of one tile together, so that a reader of few tiles skips the rest."""
    index.repartitionByRange(tile).sortWithinPartitions(tile).write.mode("overwrite").parquet(path)
