"""Telephone numbers as calling code and national number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.functions.text import map_literal

# Calling codes by ISO country.
CALLING_CODES = {"US": "1", "CA": "1", "GB": "44", "IE": "353", "FR": "33", "DE": "49", "AT": "43", "CH": "41", "IT": "39", "ES": "34", "PT": "351", "NL": "31", "BE": "32", "DK": "45", "NO": "47", "SE": "46", "FI": "358", "PL": "48", "CZ": "420", "AU": "61", "NZ": "64", "JP": "81", "CN": "86", "IN": "91", "BR": "55", "MX": "52", "ZA": "27", "FJ": "679"}


def calling_code(country: Column) -> Column:
    return F.try_element_at(map_literal(CALLING_CODES), F.upper(F.trim(country)))


def national_number(phone: Column, code: Column) -> Column:
    """The national digits of a number under a calling code; null unless seven or more are left. Extensions, signs, the
    international prefix with the code, and trunk zeros are taken off; an eleven-digit number under code 1 may begin with
    the code."""
    # One chain in which every step is named once, since Catalyst inlines steps wherever they are named.
    s = F.regexp_replace(F.lower(phone), r"(?:ext\.?|x)\s*[0-9]+\s*$", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^0-9+]", ""), "^00", "+")
    s = F.regexp_replace(s, F.concat(F.lit(r"^\+"), code, F.when(code == "1", r"|^1(?=[0-9]{10}$)").otherwise("")), F.lit(""))
    return F.get(F.regexp_extract_all(F.regexp_replace(s, "^0+", ""), F.lit("^[0-9]{7,}$"), F.lit(0)), 0)
