"""Canonical flags and the nested response of each record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.config import LIKELY_DUPLICATE, NEEDS_REVIEW, DedupeConfig
from placeweave.operators.classify import class_name


def dupes(pairs: DataFrame) -> DataFrame:
    """``uid`` of the records with an exact or likely duplicate of lower uid."""
    return pairs.filter(F.col("status") >= LIKELY_DUPLICATE).select(F.col("uid1").alias("uid")).distinct()


def canonicals(pairs: DataFrame) -> DataFrame:
    """``uid`` of the records that others point to and that are no duplicates themselves."""
    return pairs.select(F.col("uid2").alias("uid")).distinct().join(dupes(pairs), "uid", "left_anti")


def best_match(pairs: DataFrame) -> DataFrame:
    """``uid1, status, sim, uid2``: each record's best verdict; of equal ones the lowest partner."""
    best = pairs.groupBy("uid1").agg(F.max(F.struct("status", "sim", (-F.col("uid2")).alias("other"))).alias("b"))
    return best.select("uid1", "b.status", "b.sim", (-F.col("b.other")).alias("uid2"))


def unique_records(recs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The records without those that are duplicates."""
    return recs.join(dupes(pairs), "uid", "left_anti")


def response_lists(pairs: DataFrame) -> DataFrame:
    """``uid1, uid2, classification, similarity, is_canonical, is_sure``: what the responses list, flat. ``is_sure`` tells
    exact and likely duplicates from those to be reviewed."""
    first = canonicals(pairs).withColumn("is_canonical", F.lit(True))
    out = pairs.filter(F.col("status") >= NEEDS_REVIEW).join(first.withColumnRenamed("uid", "uid2"), "uid2", "left")
    return out.select("uid1", "uid2", class_name(F.col("status")).alias("classification"), F.least("sim", F.lit(1.0)).alias("similarity"), F.coalesce("is_canonical", F.lit(False)).alias("is_canonical"), (F.col("status") >= LIKELY_DUPLICATE).alias("is_sure"))


def responses(features: DataFrame, pairs: DataFrame, config: DedupeConfig) -> DataFrame:
    """``uid, response``: one JSON text per record, with ``object`` (the record with its guid), ``is_dupe`` and, where there
    are any, ``same_as`` and ``possibly_same_as``, the latter by falling similarity. ``features`` has ``uid, guid, type,
    geometry, properties``. With ``dupes_only`` the records without lists are left out.

    The objects are joined to the pairs by uid; a list holds the records that one record points to."""
    properties = F.map_concat(F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, v: k != "lieu:guid"), F.create_map(F.lit("lieu:guid"), F.col("guid")))
    objects = features.select("uid", F.struct("type", "geometry", properties.alias("properties")).alias("object"))
    explain = F.struct(F.lit("address").alias("type"), F.lit(config.with_unit).alias("with_unit")) if config.address_only else F.struct(F.lit("name+address").alias("type"), F.lit(config.name_dupe_threshold).alias("name_likely_dupe_threshold"), F.lit(config.name_review_threshold).alias("name_needs_review_threshold"), F.lit(config.with_unit).alias("with_unit"))
    listed = response_lists(pairs).join(objects.select(F.col("uid").alias("uid2"), "object"), "uid2")
    entry = F.struct("is_canonical", "classification", "object", "similarity", explain.alias("explain"))
    keyed = F.struct((-F.col("similarity")).alias("order"), "uid2", entry.alias("entry"))
    # By falling similarity, then by uid; objects hold maps, which have no order of their own.
    in_order = lambda x, y: F.when(x["order"] < y["order"], -1).when(x["order"] > y["order"], 1).when(x["uid2"] < y["uid2"], -1).when(x["uid2"] > y["uid2"], 1).otherwise(0)
    lists = listed.groupBy(F.col("uid1").alias("uid")).agg(
        F.array_sort(F.collect_list(F.when(F.col("is_sure"), keyed)), in_order).alias("sure"),
        F.array_sort(F.collect_list(F.when(~F.col("is_sure"), keyed)), in_order).alias("unsure"),
    )
    out = objects.join(lists, "uid", "inner" if config.dupes_only else "left")
    entries = lambda c: F.when(F.size(c) > 0, F.transform(c, lambda x: x["entry"]))
    body = F.struct("object", F.coalesce(F.size("sure") > 0, F.lit(False)).alias("is_dupe"), entries("sure").alias("same_as"), entries("unsure").alias("possibly_same_as"))
    return out.select("uid", F.to_json(body).alias("response"))
