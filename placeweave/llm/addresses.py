"""Address records that denote the same location although they are written differently."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.ngrams import settled, similar
from placeweave.session import discard, materialize, ship, small_side

# Kinds of streets and how they are written.
KINDS = {
    "avenue": "av ave aven avenu avn avnue", "street": "st str strt strasse", "road": "rd", "parkway": "pkwy pky parkwy pkway", "court": "ct crt", "terrace": "ter terr tce",
    "boulevard": "blvd boul bvd boulv", "lane": "ln", "place": "pl plc platz", "drive": "dr drv", "square": "sq", "highway": "hwy", "circle": "cir circ", "alley": "aly", "way": "wy", "close": "cl", "crescent": "cres", "trail": "trl", "row": "", "walk": "", "plaza": "plz", "gasse": "", "weg": "", "allee": "",
}
GERMAN_ENDS = {"strasse": "street", "str": "street", "gasse": "gasse", "weg": "weg", "platz": "place", "pl": "place", "allee": "allee"}
DIRECTIONS = {"north": "n no nth", "south": "s so sth", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}
UNITS = "apartment apt unit suite ste floor fl room rm"
ORDINALS = ["zeroth", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth"]

_KIND = {w: k for k, ws in KINDS.items() for w in [k, *ws.split()]}
_DIRECTION = {w: k for k, ws in DIRECTIONS.items() for w in [k, *ws.split()]}
_ORDINAL = {w: str(i) for i, w in enumerate(ORDINALS)}
_UNIT = re.compile(r"[\s,]*(?:\b(?:" + "|".join(UNITS.split()) + r")\b\.?|#)\s*(?:no\.?\s*)?[\w-]*\s*$")
_NUMBER = re.compile(r"(\d+)\s*-?\s*([a-z])?\b")
_LEAD = re.compile(r"^\s*(\d+)\s*-?\s*([a-z])?\s+(?=\S)")
_TRAIL = re.compile(r"[\s,]+(?:no\.?|nr\.?|#)?\s*(\d+)(?:\s*-?\s*([a-z]))?\s*$")
_WORD = re.compile(r"[^\W_]+")
_NUMERAL = re.compile(r"^(\d+)(?:st|nd|rd|th)?$")
_MARKS = str.maketrans({"à": "a", "á": "a", "â": "a", "ä": "a", "ã": "a", "å": "a", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ò": "o", "ó": "o", "ô": "o", "ö": "o", "õ": "o", "ø": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ç": "c", "ñ": "n", "ß": "ss", "æ": "ae", "œ": "oe"})


class Slips:
    """Finds the known word that one edit (two neighbours changing places included) makes of a word of four letters or
    more. Words one edit apart share a form with at most one letter left out, so known words are kept under theirs."""

    def __init__(self, known: set[str]):
        self.known = frozenset(known)
        self.under: dict[str, list[str]] = {}
        for k in sorted(known):
            for form in {k, *self._shorter(k)}:
                self.under.setdefault(form, []).append(k)

    @staticmethod
    def _shorter(word: str) -> list[str]:
        return [word[:i] + word[i + 1 :] for i in range(len(word))]

    def __call__(self, word: str) -> str | None:
        if word in self.known:
            return word
        if len(word) < 4:
            return None
        under = self.under
        if found := under.get(word):
            return found[0]
        for form in self._shorter(word):
            for k in under.get(form, ()):
                if len(k) != len(word) or _one_slip(word, k):
                    return k
        return None


def _one_slip(word: str, k: str) -> bool:
    """For words of one length: whether one letter or the order of two neighbours differs."""
    if abs(len(k) - len(word)) > 1:
        return False
    i = 0
    while i < len(k) and k[i] == word[i]:
        i += 1
    return word[i + 1 :] == k[i + 1 :] or (word[i : i + 2] == k[i : i + 2][::-1] and word[i + 2 :] == k[i + 2 :])


# Kinds that a slip of the pen turns into other words (alley, valley) are only read as they are.
_slipped_kind = Slips({k for k in KINDS if len(k) >= 5 and k not in ("alley", "close", "trail", "gasse", "allee")})
_slipped_direction = Slips({k for k in DIRECTIONS if len(k) >= 5})


def read_street(street: str | None, number: str | None) -> tuple[str, str, str, str] | None:
    """``house number with letter, name, kind, direction`` as read from the two properties, kind and direction empty where
    none is given; None if no street name or no house number can be read.

    The name is in lower case without marks, spaces and signs, ordinals as numbers. Units, suites and floors are taken
    off. Without a readable number property, a number before or after the street is the house number; a number that is
    all the name there is (10 St) stays the name."""
    s = (street or "").lower().strip()
    if not s.isascii():
        s = s.translate(_MARKS)
    s = _UNIT.sub("", s).strip(" ,")
    m = _NUMBER.search((number or "").lower())
    house = m[1] + (m[2] or "") if m else ""

    def words(text: str) -> list[str]:
        return _WORD.findall(text.replace("'", "").replace("’", ""))

    if not house:
        for found in (_LEAD.match(s), _TRAIL.search(s)):
            if not found:
                continue
            rest = (s[found.end() :] if found.re is _LEAD else s[: found.start()]).strip(" ,")
            if any(w not in _KIND and w not in _DIRECTION for w in words(rest)):
                house, s = found[1] + (found[2] or ""), rest
                break
    house = house.lstrip("0")
    if not house or not house[0].isdigit():
        return None
    head, _, tail = s.partition(",")
    direction = ""
    ws, after = words(head), words(tail)
    if after and len(after) == 1 and after[0] in _DIRECTION:
        direction = _DIRECTION[after[0]]
    else:
        ws += after
    if len(ws) > 1 and not direction:
        if (d := _DIRECTION.get(ws[0]) or _slipped_direction(ws[0])) and any(w not in _KIND for w in ws[1:]):
            direction, ws = d, ws[1:]
        elif (d := _DIRECTION.get(ws[-1])) and any(w not in _KIND for w in ws[:-1]):
            direction, ws = d, ws[:-1]
    kind = ""
    if len(ws) > 1 and (k := _KIND.get(ws[-1]) or _slipped_kind(ws[-1])):
        kind, ws = k, ws[:-1]
    if not ws:
        return None
    if len(ws) > 1 and ws[0] in ("st", "sankt", "ste"):
        ws[0] = "saint"
    ws = [_ORDINAL.get(w) or (n[1].lstrip("0") or "0" if (n := _NUMERAL.match(w)) else w) for w in ws]
    name = "".join(ws)
    if not kind:
        for end, k in GERMAN_ENDS.items():
            if name.endswith(end) and len(name) > len(end) + 3:
                kind, name = k, name[: -len(end)]
                break
    return house, name, kind, direction


# How the first word of a town's name is shortened.
_TOWN_WORDS = {"st": "saint", "sankt": "saint", "ste": "saint", "snt": "saint", "pt": "port", "prt": "port", "mt": "mount", "ft": "fort", "n": "north", "s": "south", "e": "east", "w": "west"}


def read_city(city: str | None) -> str:
    """A town's name in lower case without marks and signs, its first word written out; empty where nothing is left."""
    words = _WORD.findall((city or "").lower().translate(_MARKS))
    if len(words) > 1:
        words[0] = _TOWN_WORDS.get(words[0], words[0])
    return " ".join(words)


def read_postcode(code: str | None) -> str:
    """Upper case, no white space, nothing after a hyphen; empty where nothing is left."""
    return "".join((code or "").upper().split()).partition("-")[0]


def _parsed(rows: DataFrame) -> DataFrame:
    """``id, house, name, kind, direction, city, postcode`` of the rows whose street and number can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, town, code = lru_cache(200_000)(read_street), lru_cache(50_000)(read_city), lru_cache(50_000)(read_postcode)
        for b in batches:
            cities, codes = list(map(town, b.column("city").to_pylist())), list(map(code, b.column("postcode").to_pylist()))
            got = list(map(read, b.column("street").to_pylist(), b.column("number").to_pylist()))
            at = [i for i, g in enumerate(got) if g and (cities[i] or codes[i])]
            parts = list(zip(*[(*got[i], cities[i], codes[i]) for i in at])) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int32())), *[pa.array(p, pa.string()) for p in parts]], ["id", "house", "name", "kind", "direction", "city", "postcode"])

    ship(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, house string, name string, kind string, direction string, city string, postcode string")


#: The least cosine of two spellings of one street or town.
ALIKE = 0.6


def settled_cities(rows: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """``rows`` (with ``city`` as of :func:`read_city` and ``postcode``) with the column ``town``: the city in its
    established spelling; where no city is given, the city most rows of the postcode name; where that is unknown too, the
    postcode itself. Null if neither is given.

    A spelling stands for a more frequent one that is like it (:func:`similar`), unless the postcodes tell them apart: a town
    of its own has postcodes of its own, so it is kept if most of its rows with a postcode are where the other is not the
    more frequent of the two.

    The vocabularies have a row per spelling and per postcode; they are counted with partial sums and joined back by
    broadcast while they are small, otherwise on the spelling, where adaptive execution splits a hot city."""
    codes = materialize(rows.filter(F.col("city") != "").groupBy("city", "postcode").agg(F.count("*").alias("n")), "city-postcodes")
    seen = codes.groupBy(F.lit(0).alias("block"), F.col("city").alias("text")).agg(F.sum("n").alias("n"))
    links = materialize(similar(seen, threshold), "city-links")
    coded = codes.filter(F.col("postcode") != "")
    own = coded.join(links.select(F.col("text").alias("city"), "to"), "city")
    there = coded.select(F.col("city").alias("to"), "postcode", F.col("n").alias("there"))
    own = own.join(there, ["to", "postcode"], "left").groupBy("city", "to").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("there") > F.col("n"), F.col("n")).otherwise(0)).alias("shared"))
    apart = own.filter("2 * shared < n").select(F.col("city").alias("text"), "to")
    better = small_side(settled(links.join(apart, ["text", "to"], "left_anti")).select(F.col("text").alias("city"), F.col("to").alias("city_to")), "city-slips")
    named = rows.join(better, "city", "left")
    named = named.withColumn("town", F.coalesce("city_to", F.nullif("city", F.lit("")))).drop("city_to")
    zone = codes.filter(F.col("postcode") != "").join(better, "city", "left").groupBy("postcode", F.coalesce("city_to", "city").alias("town")).agg(F.sum("n").alias("n"))
    zone = zone.groupBy("postcode").agg(F.max(F.struct("n", "town")).alias("most")).select("postcode", F.col("most.town").alias("zone_town"))
    out = named.join(small_side(zone, "postcode-towns"), "postcode", "left")
    return out.withColumn("town", F.coalesce("town", "zone_town", F.concat(F.lit("#"), F.nullif("postcode", F.lit(""))))).drop("zone_town")


def located(records: DataFrame, key: str, street: Column, number: Column, city: Column, postcode: Column) -> DataFrame:
    """``id, town, house, name, kind, direction, street``: each readable address, ``street`` being the name in its settled
    spelling. Rows without city and postcode, or whose street or number cannot be read, are left out."""
    rows = records.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), street.alias("street"), number.alias("number"), city.alias("city"), postcode.alias("postcode"))
    rows = rows.filter(F.col("street").isNotNull())
    read = materialize(_parsed(rows), "addresses-read")
    placed = materialize(settled_cities(read).select("id", "town", "house", "kind", "direction", "name", F.col("name").alias("street")), "addresses-settled")
    discard(read)
    return resolved_streets(placed)


def resolved_streets(rows: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """``rows`` (with ``town, house, street``) with ``street`` replaced by the spelling it stands for in its town.

    All different spellings of a town, however many rows bear them, are compared through an index of their
    gapped grams, with the cosine and the number of edits tested (:func:`similar`); each stands for the most frequent it is
    like, step by step. Numbered streets (4th) are nobody's slip. A street's spellings are far fewer than its rows, so
    the comparison costs little beside the reading; house numbers are compared when the addresses are joined."""
    spelt = rows.filter((F.col("house") != "") & ~F.col("street").rlike(r"^\d+$")).groupBy(F.col("town").alias("block"), F.col("street").alias("text")).agg(F.count("*").alias("n"))
    best = settled(similar(materialize(spelt, "street-spellings"), threshold))
    slips = small_side(best.select(F.col("block").alias("town"), F.col("text").alias("street"), F.col("to").alias("resolved")), "street-slips")
    return rows.join(slips, ["town", "street"], "left").withColumn("street", F.coalesce("resolved", "street")).drop("resolved")


def same_address_pairs(places: DataFrame, key: str) -> DataFrame:
    """``<key>_a < <key>_b`` of the rows of :func:`located` that denote one address.

    House number with letter, town and direction must be equal, and so must the kind where both give one. The names are
    equal if their settled spellings are.

    Rows are joined on the whole address, so a join key holds the rows of one building; adaptive execution splits a
    hot one. Every pair is a case to be found, hence the result is as large as the number of cases."""
    a, b = places.alias("a"), places.alias("b")
    at = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("town", "house", "direction")]
    kinds = (F.col("a.kind") == F.col("b.kind")) | (F.col("a.kind") == "") | (F.col("b.kind") == "")
    ids = (F.least("a.id", "b.id").alias(f"{key}_a"), F.greatest("a.id", "b.id").alias(f"{key}_b"))
    return a.join(b, [*at, F.col("a.street") == F.col("b.street"), F.col("a.id") < F.col("b.id"), kinds]).select(*ids)


def match_addresses(records: DataFrame, key: str = "uid", street: str = "street", number: str = "number", city: str = "city", postcode: str = "postcode") -> DataFrame:
    """Pairs ``<key>_a < <key>_b`` of records of one postal address.

    One row per key is expected (repeated rows repeat their pairs). A record takes part if street and house number can be
    read and a city or postcode is there; null keys, nulls and blanks take part in nothing; very long texts are read whole; repeated addresses pair like
    any others; an empty table gives no pairs; further columns are ignored."""
    placed = materialize(located(records, key, F.col(street), F.col(number), F.col(city), F.col(postcode)), "addresses")
    return same_address_pairs(placed, key)
