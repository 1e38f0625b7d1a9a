"""Text normalization and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the letters that stand for them.
_MARKED = "àáâãäåāăąçćčďđèéêëēėęěğìíîïīįłñńňòóôõöøōőŕřśşšťţùúûüūůűųýÿźżž"
_PLAIN = "aaaaaaaaacccddeeeeeeeegiiiiiilnnnoooooooorrsssttuuuuuuuuyyzzz"


def filled(c: Column) -> Column:
    """The text without outer white space, null where nothing is left."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(t != "", t)


def fold(c: Column) -> Column:
    """Lower case, marks of Latin letters removed, ß as ss, æ as ae, œ as oe."""
    t = F.translate(F.lower(c), _MARKED, _PLAIN)
    return F.replace(F.replace(F.replace(t, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))


def map_literal(entries: dict[str, str]) -> Column:
    """A map of plain words as one expression, parsed by Spark at once and folded to a constant."""
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in entries.items()) + ")")


def words(c: Column) -> Column:
    """Runs of letters and digits, with ``&`` and ``#`` as tokens of their own; apostrophes vanish inside words."""
    t = F.regexp_replace(fold(c), r"['’`]", "")
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+|[&#]"), F.lit(0))


# Short forms of words in streets, places and names.
EXPANSIONS = {
    "ave": "avenue", "av": "avenue", "st": "street", "str": "street", "rd": "road", "ln": "lane", "blvd": "boulevard", "boul": "boulevard", "dr": "drive", "drv": "drive", "ct": "court", "crt": "court", "pl": "place", "ter": "terrace", "terr": "terrace", "pkwy": "parkway", "pky": "parkway",
    "n": "north", "s": "south", "e": "east", "w": "west", "so": "south", "apt": "apartment", "ste": "suite", "fl": "floor", "strasse": "street", "hwy": "highway", "sq": "square",
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th", "eleventh": "11th", "twelfth": "12th",
    "ctr": "center", "centre": "center", "mkt": "market", "hse": "house", "intl": "international", "natl": "national", "bros": "brothers", "assoc": "associates", "corp": "corporation", "inc": "incorporated", "ltd": "limited", "co": "company",
}
# Words that names may lack.
OPTIONAL_WORDS = ["the", "and", "of", "incorporated", "limited", "corporation", "company", "llc", "pllc", "&"]


def tokens(c: Column) -> Column:
    """The words of a text with short forms written out; repeats and order kept, null stays null."""
    return F.transform(words(c), lambda w: F.coalesce(F.try_element_at(map_literal(EXPANSIONS), w), w))


def joined(c: Column) -> Column:
    """The tokens without spaces between: Sea Grape Ln and Seagrape Lane agree. Empty becomes null."""
    return F.nullif(F.array_join(tokens(c), ""), F.lit(""))


def zip5(c: Column) -> Column:
    """The first five digits of a nine-digit US postcode, anything else unchanged."""
    pattern = r"^\s*([0-9]{5})-?[0-9]{4}\s*$"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)


def house_key(c: Column) -> Column:
    """House number and letter in lower case; null where there is no digit."""
    pattern = r"([0-9]+)\s*-?\s*([a-z]?)"
    t = F.lower(c)
    return F.nullif(F.concat(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)), F.lit(""))


def unit_key(c: Column) -> Column:
    """A unit or floor without its designator: Apt 1C, #1C and Apt No. 1 C agree, as do Fl 1, 1st Floor and 1/F."""
    t = F.regexp_replace(fold(c), r"\b(?:apartment|apt|unit|suite|ste|room|rm|floor|fl|level|no|number)\b|/f\b|#", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\b([0-9]+)(?:st|nd|rd|th)\b", "$1"), r"[^\p{L}\p{N}]+", "")
    return F.nullif(t, F.lit(""))
