"""Blocking keys and the pairs they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.config import DedupeConfig
from placeweave.functions.text import OPTIONAL_WORDS, fold, house_key, joined, tokens, zip5
from placeweave.functions.tiles import coarse_cells, near_tiles, tile, tile_and_neighbors
from placeweave.session import materialize
from placeweave.sources.records import number_variants


#: Streets of so many letters may differ by one edit (the verdict's own bound).
FUZZY_LETTERS = 8


def _address_parts(config: DedupeConfig, around: bool, fuzzy: bool) -> Column:
    """The keys of house number and street; with ``fuzzy`` those of streets one edit apart too, for streets without digits.

    One edit leaves one half of a street as it was. On the side that has the tiles around it a street has its two halves as keys,
    with its length; on the other it asks for the halves that streets of its length, one less and one more would share.
    Reads the columns of :func:`_keyed`."""
    number, street = F.col("number"), F.col("street")
    exact = F.when(number.isNotNull() & street.isNotNull(), F.concat_ws("|", F.lit("ao"), number, street)).when(number.isNotNull(), F.concat_ws("|", F.lit("an"), number)).when(street.isNotNull(), F.concat_ws("|", F.lit("as"), street))
    if not fuzzy:
        return F.array(exact)
    n = F.length(street)

    def half(length: Column, first: bool) -> Column:
        cut = F.floor(length / 2).cast("int")
        text = F.substr(street, F.lit(1), cut) if first else F.substr(street, n - (length - cut) + 1, length - cut)
        return F.concat_ws("|", F.lit("af"), F.coalesce(number, F.lit("")), length.cast("string"), F.lit("1" if first else "2"), text)

    keys = [half(n + d, first) for d in ((0,) if around else (-1, 0, 1)) for first in (True, False)]
    halves = F.when((n >= FUZZY_LETTERS) & ~street.rlike("[0-9]"), F.array(*keys))
    return F.concat(F.array(exact), F.coalesce(halves, F.array().cast("array<string>")))


def _parts(config: DedupeConfig, around: bool, fuzzy: bool) -> Column:
    """The name and address part of the keys of a record, without its place."""
    if config.address_only or config.address_only_candidates:
        return _address_parts(config, around, fuzzy)
    names = F.col("names")
    if config.name_only:
        # Names meet on any of their words, and on words that one letter left out makes equal.
        shorter = F.flatten(F.transform(names, lambda w: F.when(F.length(w) >= 6, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.lit("nf|"), F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))))
        return F.concat(F.transform(names, lambda w: F.concat(F.lit("no|"), w)), F.transform(names, lambda w: F.concat(F.lit("nf|"), w)), F.array_distinct(shorter)) if fuzzy else F.transform(names, lambda w: F.concat(F.lit("no|"), w))
    # Whatever the order and the spelling of their words, names at one address meet, and the verdict on names decides.
    return F.when(F.size(names) > 0, _address_parts(config, around, fuzzy))


def _areas(config: DedupeConfig) -> list[Column]:
    """The names of containing areas on demand, each as an array of one."""
    out = []
    named: list[tuple[str, str]] = []
    if config.use_city:
        named += [("c", c) for c in ("city", "city_district", "suburb", "island")]
    if config.use_small_containing:
        named += [("d", "state_district")]
    for mark, c in named:
        out.append(F.array(F.concat(F.lit(mark), F.nullif(F.trim(fold(F.col(c))), F.lit("")))))
    if config.use_postal_code:
        code = zip5(F.col("postcode")) if config.use_zip5 else F.col("postcode")
        out.append(F.array(F.concat(F.lit("p"), F.nullif(F.trim(fold(code)), F.lit("")))))
    return out


def _places(config: DedupeConfig, around: bool) -> Column:
    """The place part: the tile (with those around it on one side), and the names of containing areas on demand."""
    lat, lon = F.col("lat"), F.col("lon")
    out = []
    if config.use_latlon:
        p = config.block_precision
        tiles = tile_and_neighbors(lat, lon, p) if around else F.array(tile(lat, lon, p))
        out.append(F.when(lat.isNotNull() & lon.isNotNull(), F.transform(tiles, lambda t: F.concat(F.lit("g"), t.cast("string")))))
    out += _areas(config)
    return F.array_compact(F.flatten(F.array_compact(F.array(*out)))) if out else F.array(F.lit(""))


def _keyed(recs: DataFrame, config: DedupeConfig, *places: Column) -> DataFrame:
    """A row per record and house number: ``uid, number, street, names`` as the keys need them, and ``places``. They are columns
    of their own, so that each text is normalized once and not wherever a key names it."""
    recs = recs.select("uid", *[c for c in ("house", "road", "lat", "lon", "house_number", "house_number_base", *area_columns(config)) if c in recs.columns])
    named = not (config.address_only or config.address_only_candidates)
    texts = recs.withColumns({"street": F.lit(None).cast("string") if config.name_only and named else joined(F.col("road")), "words": tokens(F.col("house")) if named else F.array().cast("array<string>")})
    texts = texts.withColumn("own", F.filter("words", lambda w: ~w.isin(OPTIONAL_WORDS)))
    texts = texts.select("uid", "house_number", "house_number_base", "street", F.array_distinct(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("words"))).alias("names"), *places)
    return number_variants(texts).withColumn("number", house_key(F.col("house_number"))).drop("house_number", "house_number_base")


def area_columns(config: DedupeConfig) -> list[str]:
    """The columns that the keys of areas read."""
    return ["city", "city_district", "suburb", "island"] * config.use_city + ["state_district"] * config.use_small_containing + ["postcode"] * config.use_postal_code


def block_keys(recs: DataFrame, config: DedupeConfig, around: bool = False, fuzzy: bool = False) -> DataFrame:
    """``block_key, uid``, distinct. A record without text, or without any place, has no key; a record with a base house
    number has keys for both numbers. ``around`` adds the tiles around its own; ``fuzzy`` adds keys under which
    spellings one edit apart meet, if one side has ``around`` and the other has not."""
    parts = _keyed(recs, config, _places(config, around).alias("places")).select("uid", F.array_compact(_parts(config, around, fuzzy)).alias("parts"), "places")
    keys = parts.select("uid", F.explode("parts").alias("part"), "places").select("uid", "part", F.explode("places").alias("place"))
    return keys.select(F.concat_ws("@", "part", "place").alias("block_key"), "uid").distinct()


def block_sizes(keys: DataFrame) -> DataFrame:
    """``block_key, size`` of the blocks with two or more members."""
    return keys.groupBy("block_key").agg(F.count("*").alias("size")).filter("size > 1")


def _placed(recs: DataFrame, config: DedupeConfig) -> DataFrame:
    """The records of :func:`_keyed` with ``tile``, null without a location, and ``areas``."""
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.lit(config.use_latlon)
    areas = _areas(config)
    if not config.use_latlon and not areas:
        areas = [F.array(F.lit(""))]
    names = F.array_compact(F.flatten(F.array_compact(F.array(*areas)))) if areas else F.array().cast("array<string>")
    return _keyed(recs, config, F.when(located, tile(F.col("lat"), F.col("lon"), config.block_precision)).alias("tile"), names.alias("areas"))


def _meeting_keys(placed: DataFrame, config: DedupeConfig, around: bool) -> DataFrame:
    """``key, uid, tile``: a number for each part of a record at each of its places, which are cells of four by four tiles
    (``around``: all cells that the nine tiles touch) and areas. ``tile`` is null where the place is an area."""
    cells = F.transform(coarse_cells(F.col("tile"), config.block_precision, around), lambda c: F.concat(F.lit("g"), c.cast("string")))
    places = F.concat(F.coalesce(cells, F.array().cast("array<string>")), "areas")
    each = placed.select("uid", "tile", F.array_compact(_parts(config, around, config.fuzzy_street_names)).alias("parts"), places.alias("places"))
    # The outer form, since a filter on the size of the parts would work them out a second time.
    each = each.select("uid", "tile", "places", F.explode_outer("parts").alias("part")).filter("part IS NOT NULL").select("uid", "tile", "part", F.explode("places").alias("place"))
    return each.select(F.xxhash64("part", "place").alias("key"), "uid", F.when(F.col("place").startswith("g"), F.col("tile")).alias("tile"))


def _met(asking: DataFrame, around: DataFrame, config: DedupeConfig, ordered: bool) -> DataFrame:
    """``uid1`` of ``asking`` with ``uid2`` of ``around``, distinct, where they share a part and a place.

    The join is on a 64-bit number of part and place; that the tiles are neighbours is compared itself, so two different parts
    would have to have one number within the same few tiles."""
    a = _meeting_keys(asking, config, False).select("key", F.col("uid").alias("uid1"), F.col("tile").alias("tile1"))
    b = _meeting_keys(around, config, True).select("key", F.col("uid").alias("uid2"), F.col("tile").alias("tile2"))
    near = F.coalesce(near_tiles(F.col("tile1"), F.col("tile2"), config.block_precision), F.col("tile1").isNull() & F.col("tile2").isNull())
    on = (a["key"] == b["key"]) & near
    # Each record has many keys, which Spark's estimate of a small side does not know.
    a = a.hint("merge")
    return a.join(b, on & (F.col("uid1") > F.col("uid2")) if ordered else on).select("uid1", "uid2").distinct()


def candidate_pairs(recs: DataFrame, config: DedupeConfig) -> DataFrame:
    """``uid1 > uid2``, distinct: records that share a key, one side's tile being any of the other's nine.

    An equi-join on the key with the order as residual condition; a hot key is split by adaptive execution. The number of
    pairs of a block is quadratic by definition of the operator; :func:`block_sizes` shows which keys are too coarse.
    What the keys are made of is written once."""
    placed = materialize(_placed(recs, config), "placed")
    return _met(placed, placed, config, True)


def link_pairs(canonical: DataFrame, to_match: DataFrame, config: DedupeConfig) -> DataFrame:
    """``uid1`` of ``to_match`` with ``uid2`` of ``canonical`` where they share a key."""
    return _met(_placed(to_match, config), _placed(canonical, config), config, False)


def star_first(keys: DataFrame) -> DataFrame:
    """``uid1, uid2``: each record with the least uid of each of its blocks."""
    centre = keys.groupBy("block_key").agg(F.min("uid").alias("uid2"))
    return keys.join(centre, "block_key").filter("uid > uid2").select(F.col("uid").alias("uid1"), "uid2").distinct()


def star_second(keys: DataFrame, matched: DataFrame) -> DataFrame:
    """``uid1 > uid2``: the records that the first pass left without a match (``matched`` has the others as ``uid1``), each
    with every member of its blocks but the least."""
    centre = keys.groupBy("block_key").agg(F.min("uid").alias("least"))
    rest = keys.join(centre, "block_key").filter("uid > least").select("block_key", "uid")
    left = rest.join(matched.select(F.col("uid1").alias("uid")).distinct(), "uid", "left_anti")
    met = left.select("block_key", F.col("uid").alias("x")).join(rest.select("block_key", F.col("uid").alias("y")), "block_key").filter("x <> y")
    return met.select(F.greatest("x", "y").alias("uid1"), F.least("x", "y").alias("uid2")).distinct()


def star_pairs(keys: DataFrame, judge) -> DataFrame:
    """The pairs of both passes that ``judge`` (pairs to judged pairs) keeps."""
    first = materialize(judge(star_first(keys)), "star-pass-1")
    return first.unionByName(judge(star_second(keys, first))).distinct()


def join_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Pairs with both sides' columns, as ``<column>1`` and ``<column>2``."""
    right = left if right is None else right
    one = left.select(*[F.col(c).alias(f"{c}1") for c in left.columns])
    two = right.select(*[F.col(c).alias(f"{c}2") for c in right.columns])
    return pairs.join(one, "uid1").join(two, "uid2")
