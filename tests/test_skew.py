import math
import random

from placeweave.operators.skew import city_key, exact_quantiles, heavy_keys, key_counts, postcode_key
from pyspark.sql import functions as F

SCHEMA = "k string, c string, v double"


def disc(values, p):
    vs = sorted(values)
    return vs[max(1, math.ceil(p * len(vs) - 1e-9)) - 1]


def test_quantiles_equal_sorting_for_hot_and_cold_keys(spark):
    rng = random.Random(5)
    rows = [("hot", "x", rng.choice([rng.gauss(0, 1), rng.uniform(-1e9, 1e9), 3.0])) for _ in range(4000)]
    rows += [(f"cold{rng.randrange(40)}", "x", float(rng.randrange(10))) for _ in range(800)]
    rows += [("ties", "y", 7.0)] * 900 + [("one", "y", -1.5), (None, "x", 1.0), ("hot", None, 1.0), ("hot", "x", None), ("null", "x", None), ("nan", "x", float("nan"))]
    by = {}
    for k, c, v in rows:
        if k is not None and c is not None and v is not None and not math.isnan(v):
            by.setdefault((k, c), []).append(v)
    got = exact_quantiles(spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("n", F.lit(2)), ["k", "c"], "v", [0.0, 0.1, 0.5, 0.999, 1.0], hot_share=0.05, bins=16)
    out = {(r["k"], r["c"]): tuple(r)[2:] for r in got.collect()}
    assert out == {k: (len(v), *(disc(v, p) for p in (0.0, 0.1, 0.5, 0.999, 1.0))) for k, v in by.items()}


def test_values_over_hundreds_of_magnitudes_are_resolved(spark):
    rows = [("a", "b", 10.0**e) for e in range(-150, 151)]
    got = exact_quantiles(spark.createDataFrame(rows, SCHEMA), ["k", "c"], "v", [0.25, 0.5], hot_share=0.001, bins=4, rounds=3).collect()
    assert [tuple(r) for r in got] == [("a", "b", 301, disc([r[2] for r in rows], 0.25), 1.0)]


def test_counts_and_heavy_keys(spark):
    rows = [("a", "x", 1.0)] * 60 + [("b", "x", 1.0)] * 39 + [(None, "x", 1.0)] * 901
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in key_counts(df, ["k", "c"]).collect()} == {("a", "x", 60), ("b", "x", 39)}
    assert [tuple(r) for r in heavy_keys(df, ["k", "c"], 0.06).collect()] == [("a", "x", 60)]


def test_nothing_gives_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_quantiles(df, ["k"], "v", [0.5]).collect() == []
    assert heavy_keys(df, ["k"], 0.1).collect() == []


def test_keys(spark):
    df = spark.createDataFrame([(" 90403-1234 ", "  Kestrel \t BAY "), ("zk9 4jv", None), ("-1", " ")], "p string, c string")
    assert [tuple(r) for r in df.select(postcode_key(F.col("p")), city_key(F.col("c"))).collect()] == [("90403", "kestrel bay"), ("ZK94JV", None), ("", "")]
