"""Features to canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.coords import valid_latitude, wrapped_longitude
from placeweave.functions.text import zip5

_PLACES = ("", "addr:", "is_in:")

# The properties that fill a tag, the first present one winning.
ALIASES: dict[str, list[str]] = {
    "house": ["name", "wof:name", "house", "addr:housename"],
    "house_number": ["addr:housenumber", "addr:house_number", "house_number", "housenumber"],
    "house_number_base": ["addr:housenumber:base"],
    "road": ["addr:street", "street"],
    "floor": ["addr:floor", "addr:level", "level", "floor"],
    "unit": ["addr:unit", "unit"],
    "suburb": [p + w for w in ("neighborhood", "neighbourhood", "barangay", "suburb") for p in _PLACES],
    "city": [p + w for w in ("city", "municipality", "locality") for p in _PLACES],
    "city_district": [p + w for w in ("city_district", "quarter") for p in _PLACES],
    "state_district": [p + w for w in ("county", "state_district") for p in _PLACES],
    "island": [p + "island" for p in _PLACES],
    "state": [p + w for w in ("state", "governorate", "province", "region") for p in _PLACES],
    "postcode": [p + w for w in ("postcode", "postal_code", "zipcode", "zip_code", "zip", "postalcode") for p in _PLACES[:2]],
    "country": ["iso:country", "country_code", "addr:country_code", "is_in:country_code", "country", "addr:country", "is_in:country"],
    "country_region": [p + "country_region" for p in _PLACES],
    "world_region": [p + "world_region" for p in _PLACES],
    "phone": ["phone", "telephone", "sg:phone", "contact:phone"],
    "website": ["sg:website", "website", "contact:website"],
    "email": ["email", "contact:email"],
}


def alias_value(tag: str, properties: Column) -> Column:
    """The value of the tag's first property that is present; a property named as the tag itself counts first."""
    names = [tag, *[a for a in ALIASES[tag] if a != tag]] if tag in ALIASES[tag] else ALIASES[tag]
    return F.coalesce(*[properties[a] for a in names])


def records(features: DataFrame) -> DataFrame:
    """Canonical records of Features (``uid, geometry, properties``): a nullable column per tag, lat and lon.

    The first two ordinates count; unless both are usable both are null. Null properties or geometry are missing values."""
    at = F.col("geometry.coordinates")
    lat, lon = valid_latitude(F.get(at, 1)), wrapped_longitude(F.get(at, 0))
    both = lat.isNotNull() & lon.isNotNull()
    tags = [alias_value(t, F.col("properties")).alias(t) for t in ALIASES]
    return features.select("uid", *tags, F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"))


def with_languages(recs: DataFrame, default: str = "en") -> DataFrame:
    """``languages``: those the record gives, without repeats, or the default."""
    given = F.array_distinct(F.col("languages")) if "languages" in recs.columns else F.lit(None).cast("array<string>")
    return recs.withColumn("languages", F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(default))))


def labels_and_values(recs: DataFrame, use_zip5: bool = False) -> Column:
    """The non-blank text fields as a map, the postcode cut to five digits on demand."""
    tags = [t for t in ALIASES if t in recs.columns]
    value = lambda t: zip5(F.col(t)) if use_zip5 and t == "postcode" else F.col(t)
    every = F.map_from_arrays(F.array(*[F.lit(t) for t in tags]), F.array(*[value(t) for t in tags]))
    return F.map_filter(every, lambda k, v: v.isNotNull() & (F.trim(v) != ""))


def number_variants(recs: DataFrame) -> DataFrame:
    """A row per house number a record can be found under: its own, and its base number where that is another."""
    both = F.array_distinct(F.array_compact(F.array("house_number", "house_number_base")))
    return recs.withColumn("house_number", F.explode_outer(both))


def missing_on_one_side(a: Column, b: Column) -> Column:
    """Whether just one of two fields is null or blank."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return blank(a) != blank(b)


def combined_languages(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))
