"""Average-linkage clustering of a sparse similarity graph, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.session import materialize


def average_linkage(links: DataFrame, threshold: float) -> DataFrame:
    """``node, cluster`` for every node that was merged; the others are clusters of their own.

    ``links`` has ``a < b`` (long) and ``sim``; pairs that are missing have similarity 0; self-links and nulls are
    dropped, of repeated links the greatest counts. Two clusters are as similar as their members are on average, and the
    most similar are merged while any reach ``threshold``.

    Every round merges all pairs of clusters that are each other's nearest: average linkage is reducible, so the result is
    that of merging one pair at a time, in few rounds, each a handful of aggregations over the links that are left.
    Of equally near ones the lower ids come first, which makes the order total, the result repeatable and the end
    certain. The cluster's id is its least node. Nothing but the test for "any left" reaches the driver."""
    e = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("sim").isNotNull() & (F.col("a") != F.col("b")))
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("s"))
    e = materialize(e.withColumns({"na": F.lit(1).cast("bigint"), "nb": F.lit(1).cast("bigint")}), "linkage")
    parents: DataFrame | None = None
    rounds = 0
    while True:
        near = e.withColumn("avg", F.col("s") / (F.col("na") * F.col("nb"))).filter(F.col("avg") >= threshold)
        if near.isEmpty():
            break
        ends = near.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("node"), F.struct("avg", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"), (F.col("na") + F.col("nb")).alias("n")).alias("best"))
        best = ends.groupBy("node").agg(F.max("best").alias("best")).select((-F.col("best.x")).alias("a"), (-F.col("best.y")).alias("b"), F.col("best.n").alias("n"))
        merged = materialize(best.groupBy("a", "b", "n").agg(F.count("*").alias("k")).filter("k = 2").select("a", "b", "n"), "linkage-merged")
        step = merged.select(F.col("b").alias("node"), F.col("a").alias("parent"))
        parents = step if parents is None else parents.unionByName(step)
        moved = merged.select(F.explode(F.array(F.struct(F.col("a").alias("old"), F.col("a").alias("new"), "n"), F.struct(F.col("b").alias("old"), F.col("a").alias("new"), "n"))).alias("m")).select("m.*")
        at = lambda end: moved.select(F.col("old").alias(end), F.col("new").alias(f"new_{end}"), F.col("n").alias(f"n_{end}"))
        r = e.join(at("a"), "a", "left").join(at("b"), "b", "left")
        r = r.select(F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b"), "s", F.coalesce("n_a", "na").alias("na"), F.coalesce("n_b", "nb").alias("nb")).filter("a != b")
        swap = F.col("a") > F.col("b")
        r = r.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        e = materialize(r.groupBy("a", "b").agg(F.sum("s").alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb")), "linkage")
        rounds += 1
    if parents is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("cluster")).limit(0)
    # A node is merged away once, so parents form a forest no deeper than the rounds: halve its depth until it is flat.
    for _ in range(max(1, rounds).bit_length()):
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = materialize(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")), "linkage-forest")
    roots = parents.select(F.col("parent").alias("node")).distinct().withColumn("cluster", F.col("node"))
    return parents.select("node", F.col("parent").alias("cluster")).unionByName(roots)
