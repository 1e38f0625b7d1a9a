"""Scores of words and vectors of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tfidf_score(tf: Column | int, df: Column, n: Column) -> Column:
    """ln(tf + 1) * ln(n / df)."""
    tf = F.lit(tf) if isinstance(tf, int) else tf
    return F.ln(tf + 1) * F.ln(n / df)


def _scaled(v: Column, total: Column) -> Column:
    return F.when(F.size(v) == 0, v).when(total < 1e-12, F.transform(v, lambda x: 1.0 / F.size(v))).otherwise(F.transform(v, lambda x: x / total))


def l1_normalized(v: Column) -> Column:
    """Entries over their sum; a zero sum gives 1/n each, no entries give none."""
    return _scaled(v, F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x))


def l2_normalized(v: Column) -> Column:
    """Entries over their norm; a zero norm gives 1/n each, no entries give none."""
    return _scaled(v, F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens, repeats counting; null if both lists are empty or either is null."""
    count = lambda v, t: F.size(F.filter(v, lambda x: x == t))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, t: acc + F.least(count(a, t), count(b, t)))
    return shared / F.nullif(F.size(a) + F.size(b) - shared, F.lit(0))
