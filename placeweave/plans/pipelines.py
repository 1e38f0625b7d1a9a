"""The whole pipelines: deduplication by address or by name and address, linkage, geocoding, responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placeweave.config import LIKELY_DUPLICATE, DedupeConfig
from placeweave.functions.similarity import soft_tfidf
from placeweave.functions.text import tokens
from placeweave.operators import word_index as wi
from placeweave.operators.blocking import area_columns, block_keys, candidate_pairs, join_pairs, link_pairs, star_pairs
from placeweave.operators.classify import address_code, address_sim, geo_blend, is_sub_building_dupe, match_keys, name_address_verdicts
from placeweave.operators.responses import responses, unique_records
from placeweave.session import materialize, ship
from placeweave.sources.records import records

_ADDRESS_KEYS = ["uid", "street", "number", "base", "has_road", "has_number", "unit_key", "floor_key"]


def judged_addresses(pairs: DataFrame, recs: DataFrame, config: DedupeConfig, right: DataFrame | None = None) -> DataFrame:
    """``uid1, uid2, status, sim`` of the pairs with one address, exact or likely."""
    both = join_pairs(pairs, match_keys(recs).select(*_ADDRESS_KEYS), None if right is None else match_keys(right).select(*_ADDRESS_KEYS))
    both = both.withColumn("status", address_code(config.fuzzy_street_names, keyed=True)).filter(F.col("status") >= LIKELY_DUPLICATE)
    if config.with_unit:
        both = both.filter(is_sub_building_dupe(keyed=True))
    return both.select("uid1", "uid2", "status", address_sim(F.col("status")).alias("sim"))


def dedupe_addresses(recs: DataFrame, config: DedupeConfig) -> DataFrame:
    """Address mode. Star pairing judges k-1 pairs of a block before it looks at those left over. The records are used several
    times and written once."""
    recs = materialize(recs.select("uid", "road", "house_number", "house_number_base", "unit", "floor", "house", "phone", "country", "lat", "lon", *area_columns(config)), "recs")
    if config.pairing == "star":
        # Both passes start from the keys, several times.
        return star_pairs(materialize(block_keys(recs, config, around=True), "block-keys"), lambda pairs: judged_addresses(pairs, recs, config))
    return judged_addresses(candidate_pairs(recs, config), recs, config)


def name_docs(recs: DataFrame) -> DataFrame:
    return recs.select("uid", tokens(F.col("house")).alias("tokens"), "lat", "lon")


def name_similarity(pairs: DataFrame, recs: DataFrame, config: DedupeConfig) -> DataFrame:
    """``uid1, uid2, fuzzy``: Soft-TFIDF of the names with TF-IDF or information gain, blended with that of the tile."""
    # Every branch below starts from the documents: they are written once, which also keeps the plan small.
    docs = materialize(name_docs(recs).filter(F.size("tokens") > 0), "name-docs")
    if config.index_type == "tfidf":
        scores = wi.tfidf_scores(docs, config.min_word_docs)
    else:
        scores = wi.info_gain(docs, config.min_word_docs).withColumnRenamed("gain", "score")
    ship(recs.sparkSession)
    soft = soft_tfidf()
    used = docs.join(pairs.select(F.explode(F.array("uid1", "uid2")).alias("uid")).distinct(), "uid", "left_semi")
    both = join_pairs(pairs.select("uid1", "uid2"), wi.scored_docs(used, scores))
    out = both.select("uid1", "uid2", soft("tokens1", "scores1", "tokens2", "scores2").alias("everywhere"))
    if not config.geo_model:
        return out.withColumnRenamed("everywhere", "fuzzy")
    located = docs.filter("lat IS NOT NULL AND lon IS NOT NULL")
    by_tile = wi.docs_by_tile(located, config.model_precision)
    by_tile = materialize(by_tile, "tiles")
    aliases = materialize(wi.tile_aliases(by_tile, config.min_tile_docs, config.model_precision), "tile-aliases")
    if config.index_type == "tfidf":
        near = wi.geo_tfidf_scores(located, config.min_tile_docs, config.model_precision, config.min_word_docs, (by_tile, aliases))
    else:
        near = wi.geo_info_gain(located, config.min_tile_docs, config.model_precision, config.min_word_docs, (by_tile, aliases)).withColumnRenamed("gain", "score")
    here = wi.own_tile(used.filter("lat IS NOT NULL AND lon IS NOT NULL"), aliases, config.model_precision)
    both = join_pairs(pairs.select("uid1", "uid2"), wi.scored_docs(here, near, keys=("geo",)))
    geo = both.select("uid1", "uid2", soft("tokens1", "scores1", "tokens2", "scores2").alias("geo"))
    out = out.join(geo, ["uid1", "uid2"], "left")
    return out.select("uid1", "uid2", geo_blend(F.col("geo"), F.col("everywhere"), config.geo_model_proportion).alias("fuzzy"))


def dedupe_names(recs: DataFrame, config: DedupeConfig) -> DataFrame:
    """Name and address mode: ``uid1, uid2, status, sim`` of exact and likely duplicates and of pairs to be reviewed. The
    candidate pairs are used several times and written once."""
    named = materialize(recs.filter(F.trim("house") != ""), "named")
    pairs = materialize(candidate_pairs(named, config), "candidates")
    sims = name_similarity(pairs, named, config)
    return name_address_verdicts(join_pairs(pairs, match_keys(named)).join(sims, ["uid1", "uid2"], "left"), config)


def match(canonical: DataFrame, to_match: DataFrame, config: DedupeConfig) -> DataFrame:
    """Linkage: records of ``to_match`` (uid1) at the address of records of ``canonical`` (uid2)."""
    return judged_addresses(link_pairs(canonical, to_match, config), to_match, config, canonical)


def unique(recs: DataFrame, config: DedupeConfig) -> DataFrame:
    return unique_records(recs, dedupe_addresses(recs, config))


def geocode(recs: DataFrame, config: DedupeConfig) -> DataFrame:
    """``uid1, uid2, status, sim``: each record without a location and the best located record of its address; of equal
    ones the lowest uid. Keys come from names of areas or the postcode, never from the location."""
    from dataclasses import replace

    keys = replace(config, use_latlon=False, use_postal_code=config.use_postal_code or not config.use_city)
    has = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    judged = judged_addresses(link_pairs(recs.filter(has), recs.filter(~has), keys), recs.filter(~has), keys, recs.filter(has))
    order = W.partitionBy("uid1").orderBy(F.desc("status"), F.desc("sim"), "uid2")
    return judged.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def resolve(features: DataFrame, config: DedupeConfig) -> DataFrame:
    """``uid, response`` of Features with ``uid`` and ``guid``."""
    recs = records(features)
    if config.geocode:
        pairs = geocode(recs, config)
    else:
        pairs = dedupe_addresses(recs, config) if config.address_only else dedupe_names(recs, config)
    return responses(features, materialize(pairs, "pairs"), config)
