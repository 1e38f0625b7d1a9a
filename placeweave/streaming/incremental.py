"""Word indexes kept up to date as documents arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from placeweave.operators.word_index import doc_frequency, merged_counts
from pyspark.sql import functions as F


def frequency_updater(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch's document frequencies under ``path/batch=<id>``. A batch that is
    delivered again after a failure replaces its own folder, so nothing counts twice; the index is the sum over batches."""

    def update(batch: DataFrame, batch_id: int) -> None:
        words = doc_frequency(batch).unionByName(batch.filter(F.size("tokens") > 0).agg(F.count("*").alias("df")).select(F.lit(None).cast("string").alias("word"), "df"))
        words.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return update


def keep_frequencies(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start the upkeep for a stream of ``uid, tokens``."""
    return docs.writeStream.foreachBatch(frequency_updater(path)).option("checkpointLocation", checkpoint).start()


def current_frequencies(docs_spark, path: str) -> tuple[DataFrame, DataFrame]:
    """``word, df`` and the number of documents as of now."""
    every = docs_spark.read.parquet(path)
    words = every.filter("word IS NOT NULL").groupBy("word").agg(F.sum("df").alias("df"))
    return words, every.filter("word IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"))


__all__ = ["current_frequencies", "frequency_updater", "keep_frequencies", "merged_counts"]
