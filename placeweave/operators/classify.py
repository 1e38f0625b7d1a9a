"""Verdicts on pairs. All functions take columns ``<field>1`` and ``<field>2`` and give a struct (status, sim), which orders
by status, then by similarity; null is the verdict "not a pair"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.config import CLASS_NAMES, EXACT_DUPLICATE, LIKELY_DUPLICATE, NEEDS_REVIEW, NON_DUPLICATE, DedupeConfig
from placeweave.functions.phones import calling_code, national_number
from placeweave.functions.text import OPTIONAL_WORDS, house_key, joined, tokens, unit_key


def verdict(status: int | Column, sim: float | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(status).cast("int").alias("status"), lit(sim).cast("double").alias("sim"))


NON = (NON_DUPLICATE, 0.0)


def class_name(status: Column) -> Column:
    """The status in words; none for pairs that are no duplicates."""
    out = F.lit(None).cast("string")
    for number, name in CLASS_NAMES.items():
        out = F.when(status == number, name).otherwise(out)
    return out


def match_keys(recs: DataFrame) -> DataFrame:
    """``uid`` and what the verdicts compare, worked out once per record instead of once per pair: the written-out street,
    house number, unit, floor and name."""
    core = lambda t: F.array_sort(F.array_distinct(F.filter(t, lambda w: ~w.isin(OPTIONAL_WORDS))))
    keys = recs.select("uid", *[k.alias(n) for n, k in address_keys("").items()], tokens(F.col("house")).alias("words"), F.col("phone"), F.col("country"))
    return keys.withColumn("core", core(F.col("words")))


def address_keys(s: str) -> dict[str, Column]:
    """The keys of an address from the columns ``road<s>, house_number<s>, house_number_base<s>, unit<s>, floor<s>``."""
    c = lambda f: F.col(f"{f}{s}")
    return {
        "street": joined(c("road")), "number": house_key(c("house_number")), "base": house_key(c("house_number_base")), "has_road": _present(c("road")), "has_number": _present(c("house_number")), "unit_key": unit_key(c("unit")), "floor_key": unit_key(c("floor")),
    }


def _keyed(s: str) -> dict[str, Column]:
    return {n: F.col(f"{n}{s}") for n in ("street", "number", "base", "has_road", "has_number", "unit_key", "floor_key")}


def _street(x: Column, y: Column, fuzzy: bool) -> Column:
    close = verdict(*NON)
    if fuzzy:
        d = F.levenshtein(x, y, 2)  # -1 beyond
        words = ~x.rlike("[0-9]") & ~y.rlike("[0-9]") & (d >= 0)
        shorter = F.least(F.length(x), F.length(y))
        close = F.when(words & (d <= 1) & (shorter >= 8), verdict(LIKELY_DUPLICATE, 0.9)).when(words & (shorter >= 12), verdict(NEEDS_REVIEW, 0.5)).otherwise(close)
    return F.when(x.isNull() | y.isNull(), verdict(*NON)).when(x == y, verdict(EXACT_DUPLICATE, 1.0)).otherwise(close)


def street_status(a: Column, b: Column, fuzzy: bool = False) -> Column:
    """EXACT (1.0) if the written-out streets agree but for spaces; fuzzy: LIKELY (0.9) within one edit in eight letters
    or more, numbers excepted, NEEDS_REVIEW (0.5) within two in twelve; NON otherwise, and where a side has no word."""
    return _street(joined(a), joined(b), fuzzy)


def _house_number(a: Column, b: Column, base1: Column, base2: Column) -> Column:
    based = (base1.isNotNull() | base2.isNotNull()) & (F.coalesce(base1, a) == F.coalesce(base2, b))
    return F.when(a == b, verdict(EXACT_DUPLICATE, 1.0)).when(based, verdict(LIKELY_DUPLICATE, 0.9)).otherwise(verdict(*NON))


def house_number_status(n1: Column, n2: Column, base1: Column, base2: Column) -> Column:
    """EXACT if the numbers agree; LIKELY (0.9) if they do once a base number stands for the full one where it is given."""
    return _house_number(*map(house_key, (n1, n2, base1, base2)))


def _present(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def address_code(fuzzy: bool = False, keyed: bool = False) -> Column:
    """The status of :func:`address_status`, on which its similarity depends (:func:`address_sim`). A plain number named once, since
    Catalyst inlines a verdict wherever one of its two fields is read."""
    x, y = (_keyed(s) if keyed else address_keys(s) for s in "12")
    same, likely, none = F.lit(EXACT_DUPLICATE), F.lit(LIKELY_DUPLICATE), F.lit(NON_DUPLICATE)
    a, b = x["street"], y["street"]
    # Streets to be reviewed are no duplicates here. The cheap conditions stand first.
    street = F.when(a == b, same)
    if fuzzy:
        street = street.when((F.abs(F.length(a) - F.length(b)) <= 1) & (F.length(a) >= 8) & (F.length(b) >= 8) & (F.levenshtein(a, b, 1) >= 0) & ~a.rlike("[0-9]") & ~b.rlike("[0-9]"), likely)
    based = (x["base"].isNotNull() | y["base"].isNotNull()) & (F.coalesce(x["base"], x["number"]) == F.coalesce(y["base"], y["number"]))
    number = F.when(x["number"] == y["number"], same).when(based, likely).otherwise(none)
    # The least of what is compared: a part that both lack is null, which least() passes over.
    least = F.least(F.when(x["has_road"] & y["has_road"], street.otherwise(none)), F.when(x["has_number"] & y["has_number"], number))
    return F.when((x["has_road"] == y["has_road"]) & (x["has_number"] == y["has_number"]), least)


def address_sim(status: Column) -> Column:
    return F.when(status == EXACT_DUPLICATE, 1.0).when(status == LIKELY_DUPLICATE, 0.9).when(status == NON_DUPLICATE, 0.0)


def address_status(fuzzy: bool = False, keyed: bool = False) -> Column:
    """The verdict on street and house number; null where one side lacks what the other has, or both lack both. ``keyed``
    takes the columns of :func:`match_keys` instead of the record's."""
    status = address_code(fuzzy, keyed)
    return F.when(status.isNotNull(), verdict(status, address_sim(status)))


def is_sub_building_dupe(keyed: bool = False) -> Column:
    """Units agree where both are given, and so do floors."""
    if keyed:
        sides = [(F.col(f"{f}_key1"), F.col(f"{f}_key2")) for f in ("unit", "floor")]
    else:
        sides = [(unit_key(F.col(f"{f}1")), unit_key(F.col(f"{f}2"))) for f in ("unit", "floor")]
    out = F.lit(True)
    for a, b in sides:
        out = out & F.coalesce(a == b, F.lit(True))
    return out


def is_address_dupe(with_unit: bool = True, fuzzy: bool = False, keyed: bool = False) -> Column:
    good = F.coalesce(address_code(fuzzy, keyed) >= LIKELY_DUPLICATE, F.lit(False))
    return good & is_sub_building_dupe(keyed) if with_unit else good


def name_status_of(x: Column, y: Column, u: Column, v: Column) -> Column:
    """:func:`name_status` of the ``words`` and ``core`` of :func:`match_keys`."""
    shared = F.size(F.array_intersect(u, v)) / F.nullif(F.size(F.array_union(u, v)), F.lit(0))
    none = F.lit(None).cast("int")
    return F.when((F.coalesce(F.size(x), F.lit(0)) <= 0) | (F.coalesce(F.size(y), F.lit(0)) <= 0), none).when(x == y, EXACT_DUPLICATE).when((F.size(u) > 0) & (u == v), LIKELY_DUPLICATE).when(shared >= 0.5, NEEDS_REVIEW).otherwise(NON_DUPLICATE)


def name_status(a: Column, b: Column) -> Column:
    """EXACT if the written-out names agree in order; LIKELY if their words do, whatever their order, without optional
    ones; NEEDS_REVIEW if half of the words are shared; NON otherwise; null where a side has no word."""
    core = lambda t: F.array_sort(F.array_distinct(F.filter(t, lambda w: ~w.isin(OPTIONAL_WORDS))))
    x, y = tokens(a), tokens(b)
    return name_status_of(x, y, core(x), core(y))


def class_of(sim: Column, likely: float = 0.9, review: float = 0.7) -> Column:
    """The status of a similarity by thresholds; null stays null."""
    return F.when(sim >= likely, LIKELY_DUPLICATE).when(sim >= review, NEEDS_REVIEW).when(sim.isNotNull(), NON_DUPLICATE)


def geo_blend(geo: Column, everywhere: Column, proportion: float = 0.6) -> Column:
    """The weighted similarity; the global one where there is none for the place."""
    return F.coalesce(proportion * geo + (1 - proportion) * everywhere, everywhere)


def phone_agreement(s: tuple[str, str] = ("1", "2"), default_country: str = "US") -> Column:
    """Whether both phones are one number; null unless both can be read and the countries, where given, agree."""
    c1, c2 = (F.nullif(F.upper(F.trim(F.col(f"country{x}"))), F.lit("")) for x in s)
    code = calling_code(F.coalesce(c1, c2, F.lit(default_country)))
    n1, n2 = (national_number(F.col(f"phone{x}"), code) for x in s)
    return F.when(F.coalesce(c1 == c2, F.lit(True)), n1 == n2)


def phone_revised(status: Column, agree: Column) -> Column:
    """NEEDS_REVIEW with one number becomes LIKELY, LIKELY with two numbers NEEDS_REVIEW; everything else stays."""
    return F.when((status == NEEDS_REVIEW) & agree, LIKELY_DUPLICATE).when((status == LIKELY_DUPLICATE) & ~agree, NEEDS_REVIEW).otherwise(status)


def name_address_verdicts(pairs: DataFrame, config: DedupeConfig) -> DataFrame:
    """``uid1, uid2, status, sim`` of the pairs with one name and one address (and unit, on demand), or with names to be
    reviewed. ``pairs`` has both sides' :func:`match_keys` and ``fuzzy``, the soft similarity, null where there is none.

    Names that are not equal take the class of the soft similarity where it is at least that of the plain comparison; the
    phones then revise it. The similarity is that of the deciding comparison, capped at 1. The steps are columns of their own,
    so that each is worked out once."""
    if not config.name_only:
        pairs = pairs.filter(is_address_dupe(config.with_unit, config.fuzzy_street_names, keyed=True))
    plain = name_status_of(*[F.col(c) for c in ("words1", "words2", "core1", "core2")])
    phones = ["phone1", "phone2", "country1", "country2"]
    out = pairs.select("uid1", "uid2", plain.alias("plain"), class_of(F.col("fuzzy"), config.name_dupe_threshold, config.name_review_threshold).alias("soft"), "fuzzy", *phones)
    # The phones turn no duplicate into none and none into one, so the pairs that are none go before they are read.
    out = out.filter((F.col("plain") > NON_DUPLICATE) | ((F.col("plain") == NON_DUPLICATE) & (F.col("soft") > NON_DUPLICATE)))
    softer = (F.col("plain") < EXACT_DUPLICATE) & F.coalesce(F.col("soft") >= F.col("plain"), F.lit(False))
    plain_sim = F.when(F.col("plain") == EXACT_DUPLICATE, 1.0).when(F.col("plain") == LIKELY_DUPLICATE, config.name_dupe_threshold).when(F.col("plain") == NEEDS_REVIEW, config.name_review_threshold).otherwise(0.0)
    agree = phone_agreement() if config.use_phone_numbers else F.lit(None).cast("boolean")
    out = out.select("uid1", "uid2", agree.alias("agree"), F.when(softer, F.col("soft")).otherwise(F.col("plain")).alias("status"), F.when(softer, F.least("fuzzy", F.lit(1.0))).otherwise(plain_sim).alias("sim"))
    return out.select("uid1", "uid2", phone_revised(F.col("status"), F.col("agree")).alias("status"), "sim")
