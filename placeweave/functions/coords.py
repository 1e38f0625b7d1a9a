"""Coordinates from text: one grammar for decimals and degrees-minutes-seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The signs that stand behind degrees, minutes and seconds, and the directions.
DEGREE_SIGNS, MINUTE_SIGNS, SECOND_SIGNS, DIRECTIONS = ":°ºd", ":'′m", '"″s', "NSEWnsew"

_NUMBER = r"[0-9]{1,3}(?:\.[0-9]+)?"
_SIXTIETHS = r"[0-5]?[0-9](?:\.[0-9]+)?"


def _ends_with(signs: str) -> str:
    """A part ends with its sign, a space, the text's end or before a direction."""
    return rf"\s*(?:[{signs}]\s*|\s+|$|(?=[{DIRECTIONS}]))"


# Optional sign, degrees, then optional minutes and seconds, then an optional direction, between text without digits and directions.
_GRAMMAR = rf"^[^0-9\-{DIRECTIONS}]*(-?)({_NUMBER}){_ends_with(DEGREE_SIGNS)}(?:({_SIXTIETHS}){_ends_with(MINUTE_SIGNS)})?(?:({_SIXTIETHS})\s*[{SECOND_SIGNS}]?\s*)?([{DIRECTIONS}]?)[^0-9{DIRECTIONS}]*$"


def degrees(text: Column) -> Column:
    """Signed decimal degrees of a coordinate text, null if it is none. Outer blanks, commas, semicolons and bars are
    ignored, a decimal comma counts as a point, S and W (and a minus sign) make the value negative.

    What the grammar does not read is tried as one number between other text (Latitude: 40.7, 40.7 degrees, W74.001); a
    single letter S or W before or after all makes it negative there too."""
    t = F.replace(F.regexp_replace(text, r"^[\s,;|]+|[\s,;|]+$", ""), F.lit(","), F.lit("."))
    part = lambda i: F.coalesce(F.regexp_extract(t, _GRAMMAR, i).try_cast("double"), F.lit(0.0))
    magnitude = part(2) + part(3) / 60 + part(4) / 3600
    negative = (F.regexp_extract(t, _GRAMMAR, 1) == "-") | F.lower(F.regexp_extract(t, _GRAMMAR, 5)).isin("s", "w")
    number = F.regexp_extract(t, r"^[^0-9\-]*(-?[0-9]+(?:\.[0-9]+)?)[^0-9]*$", 1).try_cast("double")
    other = F.when(t.rlike(r"(?i)^[sw](?![a-z])|(?<![a-z])[sw]$"), -F.abs(number)).otherwise(number)
    return F.when(t.rlike(_GRAMMAR), F.when(negative, -magnitude).otherwise(magnitude)).otherwise(other)


def valid_latitude(lat: Column) -> Column:
    """The latitude, null unless it is finite and within ±90; the poles themselves come a little nearer, as ±89.9999."""
    at_pole = F.abs(F.abs(lat) - 90) <= 1e-9 * 90
    inside = lat.isNotNull() & ~F.isnan(lat) & (F.abs(lat) <= 90 + 1e-7)
    return F.when(inside & at_pole, F.signum(lat) * 89.9999).when(inside & (F.abs(lat) < 90), lat)


def wrapped_longitude(lon: Column) -> Column:
    """The longitude in (-180, 180], null unless finite."""
    finite = lon.isNotNull() & ~F.isnan(lon) & (F.abs(lon) < float("inf"))
    return F.when(finite, 180 - F.pmod(180 - lon, F.lit(360.0)))


def close_to(a: Column, b: Column, relative: float = 1e-9, absolute: float = 0.0) -> Column:
    """Equality within a relative or an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
