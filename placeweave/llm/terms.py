"""How distinctive a term is for one record against the whole collection: the log-likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms_of(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased, in order, repeats kept; null stays null."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)


def llr(a: Column, in_record: Column, in_all: Column, total: Column) -> Column:
    """Signed log-likelihood ratio of the two-by-two table of a term: ``a`` of the record's ``in_record`` terms, ``in_all``
    of the collection's ``total`` terms, the record included. Negative where the term is rarer here than elsewhere."""
    a, r, t, n = (c.cast("double") for c in (a, in_record, in_all, total))
    b, c, d = t - a, r - a, n - t - r + a

    def part(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen * n / (row * column))).otherwise(0.0)

    g2 = 2 * (part(a, r, t) + part(b, n - r, t) + part(c, r, n - t) + part(d, n - r, n - t))
    return F.when(a * n >= r * t, g2).otherwise(-g2)


def term_scores(records: DataFrame, key: str, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """``key, term, tf, in_all, score`` for each distinct term of each record (of those in ``wanted``, by the same key).

    One row per key is expected (repeated rows count as records of their own). Null keys and null, empty or letterless texts give no rows and count for nothing; a term
    repeated in a record counts as often as it stands there; texts of any length are read whole; ties keep equal scores;
    other columns are ignored. The collection's counts always cover every record, whatever is wanted.

    The counts are combined before their one shuffle. The wanted records' terms meet them in an equi-join, whose hot keys
    (a word in a third of all names) adaptive execution splits on the records' side, the counts having one row a term."""
    named = records.select(F.col(key).alias("k"), terms_of(F.col(text)).alias("terms")).filter(F.col("k").isNotNull() & (F.size("terms") > 0))
    counts = named.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("in_all"))
    total = counts.agg(F.sum("in_all")).scalar()
    if wanted is not None:
        named = named.join(wanted.select(F.col(key).alias("k")).distinct(), "k", "left_semi")
    # Names are short: the term frequencies come from the array itself, without a shuffle by record.
    distinct = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda o: o == t)).alias("tf")))
    own = named.select("k", F.size("terms").alias("length"), F.explode(distinct).alias("x")).select("k", "length", "x.term", "x.tf")
    scored = own.join(counts, "term").withColumn("score", llr(F.col("tf"), F.col("length"), F.col("in_all"), total))
    return scored.select(F.col("k").alias(key), "term", "tf", "in_all", "score")


def top_term(scores: DataFrame, key: str) -> DataFrame:
    """``key, term``: the term with the highest score of each record; of equal ones the first in code point order."""
    best = scores.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "term")).alias("best"))
    return best.select(key, F.col("best.term").alias("term"))
