"""Per-key results when a few keys hold most rows: counts, and exact quantiles by refining histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placeweave.session import materialize, small_side


def key_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n``: the rank total of each key, counted before the shuffle, so a hot key sends one row per task.
    Rows with a null in any key have no key and are left out."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return rows.filter(whole).groupBy(*keys).agg(F.count("*").alias("n"))


def heavy_keys(rows: DataFrame, keys: list[str], share: float, bits: int = 12) -> DataFrame:
    """``keys, n`` of the keys that hold at least ``share`` of all rows, those without a key included in "all".

    The refinement of :func:`exact_quantiles`, with the hashes of the keys as the values: rows are counted per bin of the hash,
    which a task sends as one count a bin; a heavy key's bin is as heavy as the key, so only the bins with ``share`` of all
    rows (at most 1/share) are looked into again, with bins ``2^bits`` times as fine, until each holds one hash. The keys
    that are left are then counted by themselves. Neither the rows of a key nor the list of all keys are ever gathered.
    Null keys are no keys; an empty table has none; for shares under one in 100,000 counting all keys is the better way."""
    if share < 1e-5:
        total = rows.agg(F.count("*")).scalar()
        return key_counts(rows, keys).filter(F.col("n") >= F.lit(share) * total)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    hashed = materialize(rows.select(*keys, F.when(whole, F.xxhash64(*keys)).alias("__h")), "keys-hashed")
    binned = F.shiftright("__h", 64 - bits).alias("bin")
    spark, shift = rows.sparkSession, 64 - bits
    seen = hashed.groupBy(binned).agg(F.count("*").alias("n"), F.min("__h").alias("lo"), F.max("__h").alias("hi")).collect()
    least = share * sum(r["n"] for r in seen)
    open_ = [r for r in seen if r["bin"] is not None and r["n"] >= least]
    found: list[int] = []
    while open_:
        found += [r["lo"] for r in open_ if r["lo"] == r["hi"]]
        open_ = [r for r in open_ if r["lo"] != r["hi"]]
        if not open_:
            break
        bins = F.broadcast(spark.createDataFrame([(r["bin"],) for r in open_], "bin bigint"))
        finer = max(shift - bits, 0)
        inside = hashed.withColumn("bin", F.shiftright("__h", shift)).join(bins, "bin", "left_semi")
        seen = inside.groupBy(F.shiftright("__h", finer).alias("bin")).agg(F.count("*").alias("n"), F.min("__h").alias("lo"), F.max("__h").alias("hi")).filter(F.col("n") >= least).collect()
        open_, shift = seen, finer
    hashes = F.broadcast(spark.createDataFrame([(h,) for h in found], "__h bigint"))
    # Two keys of one hash are told apart by the keys themselves.
    return hashed.join(hashes, "__h", "left_semi").groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _ordered(v: Column) -> Column:
    """A double as a long in the same order: its bits, those of negative numbers turned."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + 0.0).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def _double_of(o: Column) -> Column:
    bits = F.when(o < 0, o.bitwiseXOR(F.lit(2**63 - 1))).otherwise(o)
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float], hot_share: float = 1e-3, bins: int = 512, rounds: int = 12, hot_rows: int = 200_000) -> DataFrame:
    """``keys, n, q<100p>...``: per key the number of values and, for each probability p, the smallest value whose rank is
    at least ``p * n`` (the discrete quantile), exact.

    Null values and rows with a null key are left out; NaN is refused by being left out too; ties share ranks as usual; a
    key whose values are all null gives no row; an empty table gives an empty result. The value column is cast to double
    and must be exact as one (integers up to 2^53).

    Keys with under ``hot_share`` of all rows and under ``hot_rows`` are aggregated directly, with value counts merged before
    and after one shuffle. For the others no task ever gets their values: each round counts values per
    (key, probability, bin) of the interval that still holds the wanted rank, with the bin's least and greatest value;
    the bin where the rank falls is the next interval, until least equals greatest. Bins cut the bits of the doubles, not
    their magnitudes, so each round leaves a ``bins``-th of an interval of at most 2^64 and the eighth ends all; with fewer
    than 512 bins that takes longer, and after ``rounds`` rounds 512 are used. The intervals are a table in the shared folder: nothing is held by the driver,
    and where there are many hot keys they are joined like any table."""
    v = F.col(value).cast("double")
    whole = v.isNotNull() & ~F.isnan(v)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    narrow = materialize(rows.filter(whole).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], v.alias("v")), "quantile-values")
    ks = [f"k{i}" for i in range(len(keys))]
    names = [f"q{100 * p:g}".replace(".", "_") for p in probs]
    counts = materialize(narrow.groupBy(*ks).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = small_side(counts.filter(F.col("n") >= max(min(hot_share * total, hot_rows), 1)), "quantile-hot-keys")
    asked = [F.expr(f"percentile_disc({p!r}) WITHIN GROUP (ORDER BY v)").alias(q) for p, q in zip(probs, names)]
    held = not hot.isEmpty()
    cold_rows = narrow.join(hot, ks, "left_anti") if held else narrow
    result = cold_rows.groupBy(*ks).agg(F.count("*").alias("n"), *asked)
    if held:
        # Values as ordered longs, worked out once.
        values = materialize(narrow.join(hot.select(*ks), ks, "left_semi").select(*ks, _ordered(F.col("v")).alias("o")), "quantile-hot-values")
        ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.greatest(F.ceil(F.lit(p) * F.col("n") - 1e-9), F.lit(1)).alias("rank")) for i, p in enumerate(probs)])
        state = hot.select(*ks, _ordered(F.col("lo")).alias("lo"), _ordered(F.col("hi")).alias("hi"), F.explode(ranks).alias("x")).select(*ks, "x.i", "x.rank", "lo", "hi")
        done: list[DataFrame] = []
        turn = 0
        while True:
            state = materialize(state, "quantile-intervals")
            done.append(state.filter("lo = hi"))
            if state.filter("lo <> hi").isEmpty():
                break
            state = _refined(values, small_side(state.filter("lo <> hi"), "quantile-open"), ks, bins if turn < rounds else max(bins, 512))
            turn += 1
        ends = done[0]
        for d in done[1:]:
            ends = ends.unionByName(d)
        got = ends.groupBy(*ks).agg(*[F.max(F.when(F.col("i") == i, F.col("lo"))).alias(q) for i, q in enumerate(names)])
        result = result.unionByName(hot.select(*ks, "n").join(got, ks).select(*ks, "n", *[_double_of(F.col(q)).alias(q) for q in names]))
    return result.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "n", *names)


def _refined(values: DataFrame, intervals: DataFrame, ks: list[str], bins: int) -> DataFrame:
    """The next intervals: of each open one the bin that holds its rank, from the bin's least to its greatest value.

    A bin is what the values share above a bit: the lowest such that at most ``bins`` (one more where the interval lies
    across) are between the interval's ends. The window runs over the bins of one interval."""
    # Bits that the ends differ in; the halves keep the difference within a long.
    spread = F.shiftright("hi", 1) - F.shiftright("lo", 1) + 1
    cut = F.greatest(F.ceil(F.log2(spread.cast("double"))) + 1 - int(math.log2(bins)), F.lit(0)).cast("int")
    asked = intervals.withColumn("cut", cut)
    met = values.join(asked, ks).filter(F.col("o").between(F.col("lo"), F.col("hi")))
    by = [*ks, "i", "rank"]
    hist = met.groupBy(*by, F.call_function("shiftright", F.col("o"), F.col("cut")).alias("bin")).agg(F.count("*").alias("n"), F.min("o").alias("lo"), F.max("o").alias("hi"))
    hist = hist.withColumn("upto", F.sum("n").over(W.partitionBy(*ks, "i").orderBy("bin"))).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return hist.select(*ks, "i", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi")


def postcode_key(c: Column) -> Column:
    """Upper case, no white space, nothing after a hyphen; empty where nothing is left."""
    return F.upper(F.regexp_replace(c, r"(?U)\s+|(?s)-.*$", ""))


def city_key(c: Column) -> Column:
    """Lower case, trimmed, single spaces; empty where nothing is left."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
