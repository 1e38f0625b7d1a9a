"""A multiset of documents in which each source has its share of all tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.tokenizer import DEFAULT_RANKS, token_counts
from placeweave.session import materialize

#: Sources are few; a table of more targets than this is taken for a mistake.
MAX_SOURCES = 10_000


def rates(sizes: DataFrame, targets: DataFrame, source: str = "source", share: str = "target_share", cap: str = "max_repeats", total_tokens: float | None = None) -> list[tuple[str, float, int, float]]:
    """``source, target share, cap, rate`` per target. The rate is how often a source's documents are used on average:
    share x total / the source's tokens, with the largest total that keeps every rate within its cap, or ``total_tokens``
    if that is smaller. A source without tokens cannot contribute: its rate is 0 and the others keep their proportions."""
    rows = targets.filter(F.col(source).isNotNull()).groupBy(source).agg(F.max(share).alias(share), F.max(cap).alias(cap)).join(sizes, source, "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    able = [r for r in rows if (r["tokens"] or 0) > 0 and (r[share] or 0) > 0 and (r[cap] or 0) > 0]
    total = min([r[cap] * r["tokens"] / r[share] for r in able] + ([total_tokens] if total_tokens else []), default=0.0)
    return [(r[source], float(r[share] or 0), int(r[cap] or 0), min(float(r[cap]), r[share] * total / r["tokens"]) if r in able else 0.0) for r in rows]


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: str = "target_share", cap: str = "max_repeats", ranks: str = DEFAULT_RANKS, total_tokens: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mixed multiset, one row ``key, source, copy, n_tokens, target_share, actual_share`` per use of a document, and
    the report ``source, target_share, actual_share, max_repeats, rate, tokens, documents, uses, most_uses``.

    Each document is used floor(rate) times, and once more with the rate's fraction as probability, decided by a hash of
    its key and the seed, never by chance of execution: a rerun or a lost executor gives the same rows. No use count
    exceeds the cap. Documents of a source without target, or with a null source or key, are not used. Null and empty
    texts have no tokens and are used like their source's others. Repeated rows of one key count as documents each and are
    used alike.

    Tokens are counted once, for all documents, and written narrow; sums are combined before the shuffle; what is
    broadcast has one row per target."""
    spark = documents.sparkSession
    counted = materialize(token_counts(documents.filter(F.col(key).isNotNull() & F.col(source).isNotNull()), key, text, (source,), ranks), "token-counts")
    sizes = counted.groupBy(source).agg(F.sum("n_tokens").alias("tokens"))
    rate = spark.createDataFrame(rates(sizes, targets, source, share, cap, total_tokens), f"`{source}` string, target_share double, max_repeats int, rate double")
    uniform = F.xxhash64(F.lit(seed), F.col(key).cast("string")).bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))
    fraction = F.col("rate") - F.floor("rate")
    uses = F.least(F.floor("rate") + F.when(uniform < fraction, 1).otherwise(0), F.col("max_repeats")).cast("int")
    used = counted.join(F.broadcast(rate), source).withColumn("uses", uses)
    report = used.groupBy(source, "target_share", "max_repeats", "rate").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    # One row per target: collected, so that the rows of the mix need no second look at the counts.
    got = report.collect()
    everything = sum(r["tokens"] for r in got) or 1
    actual = [(r[source], r["target_share"], r["tokens"] / everything, r["max_repeats"], r["rate"], r["tokens"], r["documents"], r["uses"], r["most_uses"]) for r in got]
    report = spark.createDataFrame(actual, f"`{source}` string, target_share double, actual_share double, max_repeats int, rate double, tokens bigint, documents bigint, uses bigint, most_uses int")
    rows = used.filter("uses > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    rows = rows.join(F.broadcast(report.select(source, "actual_share")), source)
    return rows.select(key, source, "copy", "n_tokens", "target_share", "actual_share"), report
