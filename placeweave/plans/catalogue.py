"""The reference operators as queries over the project's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.config import LIKELY_DUPLICATE, DedupeConfig
from placeweave.functions.coords import degrees, valid_latitude, wrapped_longitude
from placeweave.functions.phones import CALLING_CODES, calling_code, national_number
from placeweave.functions.similarity import soft_tfidf
from placeweave.functions.text import _MARKED, _PLAIN, EXPANSIONS, OPTIONAL_WORDS, tokens, zip5
from placeweave.functions.tiles import geohash, tile, tile_and_neighbors
from placeweave.functions.vectors import multiset_jaccard
from placeweave.operators import blocking, classify, responses
from placeweave.operators import word_index as wi
from placeweave.plans import pipelines
from placeweave.session import materialize, own_scratch, ship
from placeweave.sources.geojson import read_any, with_guid
from placeweave.sources.records import records
from placeweave.sources.tables import latest_delivery, table

ADDRESS = DedupeConfig(address_only=True, geohash_precision=6, fuzzy_street_names=True)
NAMES = DedupeConfig(index_type="tfidf", geo_model=False)
TILE_DOCS = 100

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- the records, in Spark and in SQL ---------------------------------------------------------------------------------
_TEXT = ("house", "house_number", "road", "unit", "floor", "suburb", "city", "postcode", "country", "phone")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One canonical record per place. The base number is the house number without its letter."""
    lat, lon = valid_latitude(F.col("lat")), wrapped_longitude(F.col("lon"))
    rows = latest_delivery(table(spark, sf_dir, "places"), "uid", {c: F.col(c) for c in _TEXT} | {"lat": lat, "lon": lon})
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    base = F.nullif(F.regexp_extract("house_number", "^([0-9]+)[A-Za-z]$", 1), F.lit(""))
    absent = [F.lit(None).cast("string").alias(c) for c in ("city_district", "island", "state_district")]
    return rows.select("uid", *_TEXT, base.alias("house_number_base"), *absent, F.when(both, F.col("lat")).alias("lat"), F.when(both, F.col("lon")).alias("lon"))


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One canonical record per Feature: venues told by several feeds, hence with duplicates. The base number as in :func:`places`."""
    base = F.nullif(F.regexp_extract("house_number", r"^([0-9]+)\s*-?\s*[A-Za-z]$", 1), F.lit(""))
    return records(_features(spark, sf_dir)).withColumn("house_number_base", base)


def _sql_tokens(x: str) -> str:
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in EXPANSIONS.items())
    folded = f"replace(replace(replace(translate(lower({x}), '{_MARKED}', '{_PLAIN}'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"
    return f"list_transform(regexp_extract_all(regexp_replace({folded}, '[''’`]', '', 'g'), '[\\p{{L}}\\p{{N}}]+|[&#]'), lambda w: coalesce(MAP {{{pairs}}}[w], w))"


def _pmod(x: str, n: int) -> str:
    return f"CASE WHEN ({x}) % {n} < 0 THEN (({x}) % {n} + {n}) % {n} ELSE ({x}) % {n} END"


_LAT = "CASE WHEN isnan(lat) OR abs(lat) > 90.0000001 THEN NULL WHEN abs(abs(lat) - 90) <= 9e-8 THEN sign(lat) * 89.9999 WHEN abs(lat) < 90 THEN lat END"
_LON = f"CASE WHEN isfinite(lon) THEN 180 - ({_pmod('180 - lon', 360)}) END"
REC = f"""
r0 AS (SELECT uid, arg_max(struct_pack({', '.join(f'{c} := {c}' for c in _TEXT)}, lat := {_LAT}, lon := {_LON}), loaded_at) AS s FROM places WHERE uid IS NOT NULL GROUP BY uid),
rec AS (SELECT uid, {', '.join(f's.{c} AS {c}' for c in _TEXT)}, nullif(regexp_extract(s.house_number, '^([0-9]+)[A-Za-z]$', 1), '') AS house_number_base,
  CASE WHEN s.lon IS NOT NULL THEN s.lat END AS lat, CASE WHEN s.lat IS NOT NULL THEN s.lon END AS lon FROM r0)"""
_ALIASED = {"house": ("house", "name", "wof:name", "addr:housename"), "house_number": ("house_number", "addr:housenumber", "addr:house_number", "housenumber"), "road": ("addr:street", "street"), "unit": ("unit", "addr:unit"), "floor": ("floor", "addr:floor", "addr:level", "level"), "city": ("city", "addr:city", "is_in:city"), "postcode": ("postcode", "addr:postcode"), "phone": ("phone", "telephone")}
FREC = f"""
f0 AS (SELECT uid, arg_max(struct_pack(p := properties, g := geometry), loaded_at) AS s FROM features WHERE uid IS NOT NULL GROUP BY uid),
f1 AS (SELECT uid, {', '.join(f"coalesce({', '.join(f"s.p['{a}']" for a in names)}) AS {c}" for c, names in _ALIASED.items())}, NULL::VARCHAR AS country, s.g.coordinates[2] AS lat, s.g.coordinates[1] AS lon FROM f0),
rec AS (SELECT * REPLACE (CASE WHEN ({_LON}) IS NOT NULL THEN {_LAT} END AS lat, CASE WHEN ({_LAT}) IS NOT NULL THEN {_LON} END AS lon), nullif(regexp_extract(house_number, '^([0-9]+)\\s*-?\\s*[A-Za-z]$', 1), '') AS house_number_base FROM f1)"""
DOCS = REC + f""",
docs AS (SELECT uid, {_sql_tokens('house')} AS tokens, lat, lon FROM rec),
tok AS (SELECT uid, unnest(range(len(tokens)))::INTEGER AS pos, unnest(tokens) AS word FROM docs),
n AS (SELECT count(*)::DOUBLE AS n FROM docs WHERE len(tokens) > 0),
df AS (SELECT word, count(DISTINCT uid) AS df FROM tok GROUP BY word)"""
COOC = DOCS + """,
dw AS (SELECT DISTINCT uid, word FROM tok),
co AS (SELECT a.word, b.word AS other, count(*) AS n FROM dw a JOIN dw b ON a.uid = b.uid AND a.word <> b.word GROUP BY ALL),
mp AS (SELECT word, df, df / n AS p FROM df, n)"""
GAIN = COOC + """,
sh AS (SELECT word, other, n / sum(n) OVER (PARTITION BY word) AS share FROM co),
gain AS (SELECT mp.word, coalesce(g.gain, log2(1 / p)) AS gain FROM mp LEFT JOIN (SELECT sh.word, greatest(sum(share * log2(share / p)), 0) AS gain FROM sh JOIN mp ON sh.other = mp.word GROUP BY sh.word) g ON g.word = mp.word)"""


def _xy(p: int, lat: str = "lat", lon: str = "lon") -> str:
    xb, yb = (5 * p + 1) // 2, 5 * p // 2
    return f"least(greatest(floor(({lon} + 180) / 360 * {2**xb})::BIGINT, 0), {2**xb - 1}) AS x, least(greatest(floor(({lat} + 90) / 180 * {2**yb})::BIGINT, 0), {2**yb - 1}) AS y"


def _around(p: int, source: str) -> str:
    xb, yb = (5 * p + 1) // 2, 5 * p // 2
    return f"SELECT DISTINCT t.*, ((x + dx + {2**xb}) % {2**xb}) * {2**yb} + y + dy AS geo FROM {source} t, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) WHERE y + dy BETWEEN 0 AND {2**yb - 1}"


GEO = DOCS + f""",
xy AS (SELECT uid, tokens, {_xy(4)} FROM docs WHERE lat IS NOT NULL AND lon IS NOT NULL AND tokens IS NOT NULL),
nine AS ({_around(4, 'xy')}),
bt AS (SELECT geo, count(*) AS num_docs FROM nine GROUP BY geo),
al AS (SELECT s.geo, arg_max(d.geo, (d.num_docs, d.geo)) AS alias FROM bt s JOIN bt d ON s.num_docs < {TILE_DOCS} AND d.num_docs >= {TILE_DOCS} AND s.geo <> d.geo
  AND abs(s.geo % 1024 - d.geo % 1024) <= 1 AND (s.geo // 1024 - d.geo // 1024 + 1025) % 1024 <= 2 GROUP BY s.geo),
fold AS (SELECT coalesce(alias, bt.geo) AS geo, sum(num_docs)::BIGINT AS num_docs FROM bt LEFT JOIN al ON al.geo = bt.geo GROUP BY 1),
here AS (SELECT uid, tokens, coalesce(alias, nine.geo) AS geo FROM nine LEFT JOIN al ON al.geo = nine.geo),
gdf AS (SELECT geo, word, count(*) AS df FROM (SELECT geo, unnest(list_distinct(tokens)) AS word FROM here) GROUP BY ALL)"""
_HOUSE = "nullif(regexp_extract(lower({0}), '([0-9]+)\\s*-?\\s*([a-z]?)', 1) || regexp_extract(lower({0}), '([0-9]+)\\s*-?\\s*([a-z]?)', 2), '')"
_JOINED = "nullif(array_to_string(" + _sql_tokens("{0}").replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}") + ", ''), '')"
_PART = "CASE WHEN num IS NOT NULL AND street IS NOT NULL THEN 'ao|' || num || '|' || street WHEN num IS NOT NULL THEN 'an|' || num WHEN street IS NOT NULL THEN 'as|' || street END"
KEYS = FREC + f""",
var AS (SELECT DISTINCT uid, num FROM (SELECT uid, house_number AS num FROM rec WHERE house_number IS NOT NULL UNION ALL SELECT uid, house_number_base FROM rec WHERE house_number_base IS NOT NULL UNION ALL SELECT uid, NULL FROM rec WHERE house_number IS NULL AND house_number_base IS NULL)),
prt AS (SELECT uid, {_PART} AS part, lat, lon FROM (SELECT v.uid, {_HOUSE.format('v.num')} AS num, {_JOINED.format('road')} AS street, lat, lon FROM var v JOIN rec USING (uid))),
kxy AS (SELECT DISTINCT uid, part, {_xy(6)} FROM prt WHERE part IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL),
own AS (SELECT uid, part, x * 32768 + y AS geo FROM kxy),
kall AS (SELECT DISTINCT uid, part, geo FROM ({_around(6, 'kxy')})),
fst AS (SELECT v.uid, coalesce({_HOUSE.format('v.num')}, '') AS num, {_JOINED.format('road')} AS street, {_xy(6)} FROM var v JOIN rec USING (uid) WHERE lat IS NOT NULL AND lon IS NOT NULL),
fz AS (SELECT *, length(street) AS n FROM fst WHERE length(street) >= 8 AND NOT regexp_matches(street, '[0-9]')),
fask AS (SELECT DISTINCT uid, num || '|' || (n + d) || '|' || h || '|' || CASE h WHEN 1 THEN substr(street, 1, (n + d) // 2) ELSE substr(street, n - (n + d - (n + d) // 2) + 1) END AS part, x * 32768 + y AS geo FROM fz, (VALUES (-1), (0), (1)) e(d), (VALUES (1), (2)) g(h)),
fcell AS (SELECT DISTINCT uid, num || '|' || n || '|' || h || '|' || CASE h WHEN 1 THEN substr(street, 1, n // 2) ELSE substr(street, n // 2 + 1) END AS part, x, y FROM fz, (VALUES (1), (2)) g(h)),
fall AS (SELECT DISTINCT uid, part, geo FROM ({_around(6, 'fcell')}))"""
_MEET = "SELECT a.uid AS uid1, b.uid AS uid2 FROM own a JOIN kall b ON a.part = b.part AND a.geo = b.geo AND {0} UNION SELECT a.uid, b.uid FROM fask a JOIN fall b ON a.part = b.part AND a.geo = b.geo AND {0}"
PAIRS = KEYS + ",\npairs AS (" + _MEET.format("a.uid > b.uid") + ")"


def _street(a: str, b: str) -> str:
    """Status and similarity of two written-out streets, as a struct."""
    return f"""CASE WHEN {a} IS NULL OR {b} IS NULL THEN {{'status': 0, 'sim': 0.0::DOUBLE}} WHEN {a} = {b} THEN {{'status': 3, 'sim': 1.0::DOUBLE}}
  WHEN NOT regexp_matches({a}, '[0-9]') AND NOT regexp_matches({b}, '[0-9]') AND levenshtein({a}, {b}) <= 1 AND least(length({a}), length({b})) >= 8 THEN {{'status': 2, 'sim': 0.9::DOUBLE}}
  WHEN NOT regexp_matches({a}, '[0-9]') AND NOT regexp_matches({b}, '[0-9]') AND levenshtein({a}, {b}) <= 2 AND least(length({a}), length({b})) >= 12 THEN {{'status': 1, 'sim': 0.5::DOUBLE}}
  ELSE {{'status': 0, 'sim': 0.0::DOUBLE}} END"""


_JUDGED = f""",
f AS (SELECT uid, {_JOINED.format('road')} AS street, {_HOUSE.format('house_number')} AS num, coalesce({_HOUSE.format('house_number_base')}, {_HOUSE.format('house_number')}) AS bnum, house_number_base IS NOT NULL AS based,
  coalesce(trim(road) <> '', false) AS hs, coalesce(trim(house_number) <> '', false) AS hn, lat IS NOT NULL AS located FROM rec),
v AS (SELECT uid1, uid2, a.hs AND b.hs AS s2, a.hn AND b.hn AS n2, a.hs <> b.hs OR a.hn <> b.hn OR (NOT a.hs AND NOT a.hn) AS none, {_street('a.street', 'b.street')} AS st,
  CASE WHEN a.num = b.num THEN {{'status': 3, 'sim': 1.0::DOUBLE}} WHEN (a.based OR b.based) AND a.bnum = b.bnum THEN {{'status': 2, 'sim': 0.9::DOUBLE}} ELSE {{'status': 0, 'sim': 0.0::DOUBLE}} END AS nu
  FROM pairs JOIN f a ON a.uid = uid1 JOIN f b ON b.uid = uid2),
w AS (SELECT uid1, uid2, CASE WHEN none THEN NULL WHEN s2 AND st.status < 2 THEN {{'status': 0, 'sim': 0.0::DOUBLE}} WHEN n2 AND nu.status < 2 THEN {{'status': 0, 'sim': 0.0::DOUBLE}} WHEN s2 AND n2 THEN least(st, nu) WHEN s2 THEN st ELSE nu END AS v FROM v),
judged AS (SELECT uid1, uid2, v.status AS status, v.sim AS sim FROM w WHERE v.status >= 2)"""
JUDGED = PAIRS + _JUDGED
DUPES = JUDGED + ",\ndup AS (SELECT DISTINCT uid1 AS uid FROM judged),\ncan AS (SELECT DISTINCT uid2 AS uid FROM judged WHERE uid2 NOT IN (SELECT uid FROM dup))"


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select("uid", tokens(F.col("house")).alias("tokens"), "lat", "lon").filter(F.col("tokens").isNotNull())


# --- projections and scalars ------------------------------------------------------------------------------------------
@query(
    """WITH u AS (SELECT uid, arg_max(properties, loaded_at) AS p FROM features WHERE uid IS NOT NULL GROUP BY uid)
SELECT uid, coalesce(p['house'], p['name'], p['wof:name'], p['addr:housename']) AS house, coalesce(p['house_number'], p['addr:housenumber'], p['addr:house_number'], p['housenumber']) AS house_number, coalesce(p['addr:street'], p['street']) AS road,
coalesce(p['unit'], p['addr:unit']) AS unit, coalesce(p['city'], p['addr:city'], p['is_in:city']) AS city, coalesce(p['postcode'], p['addr:postcode']) AS postcode, coalesce(p['state'], p['addr:state']) AS state, coalesce(p['phone'], p['telephone']) AS phone, p['website'] AS website, p['email'] AS email FROM u"""
)
def q_alias_coalesce(spark, d):
    rows = _features(spark, d)
    return records(rows).select("uid", "house", "house_number", "road", "unit", "city", "postcode", "state", "phone", "website", "email")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery per uid. A map has no order in SQL, so the properties travel as sorted entries while rows are compared."""
    entries = F.sort_array(F.map_entries("properties"))
    rows = latest_delivery(table(spark, sf_dir, "features"), "uid", {"type": F.col("feature_type"), "geometry": F.col("geometry"), "entries": entries})
    return rows.select("uid", "type", "geometry", F.map_from_entries("entries").alias("properties"))


@query(with_(REC, "SELECT uid, lat IS NOT NULL AS located, round(lat, 9) AS lat, round(lon, 9) AS lon FROM rec"))
def q_have_latlon_valid(spark, d):
    return places(spark, d).select("uid", F.col("lat").isNotNull().alias("located"), F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(
    """SELECT s_suppkey, round(CASE WHEN s_suppkey % 2 = 1 THEN -1 ELSE 1 END * (s_suppkey % 90 + (s_suppkey * 7 % 60) / 60.0 + (s_suppkey * 13 % 60) / 3600.0), 9) AS lat,
round(CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END * ((s_suppkey * 11 % 180) + (s_suppkey % 1000) / 1000.0), 9) + 0.0 AS lon FROM supplier"""
)
def q_latlon_parse_dms(spark, d):
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    dms = F.concat(text(k % 90), F.lit("°"), text(k * 7 % 60), F.lit("′"), text(k * 13 % 60), F.lit("″"), F.when(k % 2 == 1, "S").otherwise("N"))
    decimal = F.concat(text(k * 11 % 180), F.lit(","), F.lpad(text(k % 1000), 3, "0"), F.lit(" "), F.when(k % 3 == 0, "W").otherwise("E"))
    return table(spark, d, "supplier").select("s_suppkey", F.round(degrees(dms), 9).alias("lat"), F.round(degrees(decimal), 9).alias("lon"))


@query(f"SELECT c_custkey, round(180 - ({_pmod('180 - (c_custkey * 7.25 - 5000)::DOUBLE', 360)}), 6) AS lon FROM customer")
def q_lon_wrap(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(wrapped_longitude((F.col("c_custkey") * F.lit(7.25) - 5000).cast("double")), 6).alias("lon"))


@query(with_(REC + f",\nxy AS (SELECT uid, {_xy(4)} FROM rec WHERE lat IS NOT NULL)", "SELECT uid, x * 1024 + y AS tile, " + " || ".join(f"('0123456789bcdefghjkmnpqrstuvwxyz')[1 + (" + " + ".join(f"(({'x' if k % 2 == 0 else 'y'} >> {9 - k // 2}) & 1) * {2 ** (5 * i + 4 - k)}" for k in range(5 * i, 5 * i + 5)) + ")]" for i in range(4)) + " AS geohash FROM xy"))
def q_geohash4(spark, d):
    at = places(spark, d).filter("lat IS NOT NULL")
    return at.select("uid", tile(F.col("lat"), F.col("lon"), 4).alias("tile"), geohash(F.col("lat"), F.col("lon"), 4).alias("geohash"))


@query(with_(REC + f",\nxy AS (SELECT uid, {_xy(6)} FROM rec WHERE lat IS NOT NULL)", f"SELECT uid, geo FROM ({_around(6, 'xy')})"))
def q_geohash_neighbors(spark, d):
    return places(spark, d).filter("lat IS NOT NULL").select("uid", F.explode(tile_and_neighbors(F.col("lat"), F.col("lon"), 6)).alias("geo"))


@query(with_(REC, "SELECT uid, CASE WHEN regexp_matches(postcode, '^\\s*([0-9]{5})-?[0-9]{4}\\s*$') THEN regexp_extract(postcode, '([0-9]{5})', 1) ELSE postcode END AS zip5 FROM rec"))
def q_zip5(spark, d):
    return places(spark, d).select("uid", zip5(F.col("postcode")).alias("zip5"))


@query(with_(DOCS, "SELECT uid, pos, word FROM tok"))
def q_tokens(spark, d):
    return wi.doc_words(docs(spark, d))


@query(f"SELECT c_custkey, CASE WHEN length(n) >= 7 THEN n END AS national FROM (SELECT c_custkey, ltrim(CASE c_custkey % 4 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d ELSE NULL END, '0') AS n FROM (SELECT c_custkey, (2000000000 + c_custkey * 7919)::VARCHAR AS d FROM customer))")
def q_phone_normalize(spark, d):
    n = (F.lit(2000000000) + F.col("c_custkey") * 7919).cast("string")
    kind = F.col("c_custkey") % 4
    dotted = F.concat_ws(".", n.substr(1, 3), n.substr(4, 3), n.substr(7, 9))
    written = F.when(kind == 0, F.concat(F.lit("+1 "), dotted)).when(kind == 1, F.concat(F.lit("1-"), dotted)).when(kind == 2, F.concat(F.lit("("), n.substr(1, 3), F.lit(") "), n.substr(4, 9), F.lit(" ext. 7"))).otherwise(F.concat(F.lit("+44 "), dotted))
    return table(spark, d, "customer").select("c_custkey", national_number(written, calling_code(F.lit("us"))).alias("national"))


# --- word indexes -----------------------------------------------------------------------------------------------------
@query(with_(DOCS, "SELECT word, df FROM df"))
def q_doc_frequency(spark, d):
    return wi.doc_frequency(docs(spark, d))


@query(with_(DOCS, "SELECT uid, word, count(*) AS tf FROM tok GROUP BY ALL"))
def q_doc_word_counts(spark, d):
    return wi.doc_word_counts(docs(spark, d))


@query(with_(DOCS, "SELECT word, df FROM df WHERE df >= 2"))
def q_min_count_filter(spark, d):
    return wi.with_min_count(wi.doc_frequency(docs(spark, d)), 2)


@query(with_(DOCS, "SELECT word, round(ln(2) * ln(n / df), 9) AS score FROM df, n"))
def q_tfidf_scores(spark, d):
    return wi.tfidf_scores(docs(spark, d)).withColumn("score", F.round("score", 9))


@query(with_(DOCS, """, s AS (SELECT uid, pos, word, ln(2) * ln(n / df) AS s FROM tok JOIN df USING (word), n), z AS (SELECT uid, sqrt(sum(s * s)) AS norm, count(*) AS k FROM s GROUP BY uid)
SELECT uid, pos, word, round(CASE WHEN norm < 1e-12 THEN 1.0 / k ELSE s / norm END, 9) AS score FROM s JOIN z USING (uid)""".lstrip()))
def q_tfidf_l2(spark, d):
    x = docs(spark, d)
    scored = wi.scored_docs(x, wi.tfidf_scores(x))
    return scored.select("uid", F.posexplode(F.arrays_zip("tokens", "scores")).alias("pos", "x")).select("uid", "pos", F.col("x.tokens").alias("word"), F.round("x.scores", 9).alias("score"))


SQL["q_tfidf_l2"] = SQL["q_tfidf_l2"].replace("df AS (SELECT word, count(DISTINCT uid) AS df FROM tok GROUP BY word)\n, s AS", "df AS (SELECT word, count(DISTINCT uid) AS df FROM tok GROUP BY word),\ns AS")


@query(with_(COOC, "SELECT word, other, n FROM co"))
def q_cooccurrence(spark, d):
    return wi.cooccurrences(docs(spark, d))


@query(with_(COOC, "SELECT word, df, round(p, 12) AS p FROM mp"))
def q_marginals(spark, d):
    return wi.marginals(docs(spark, d)).withColumn("p", F.round("p", 12))


@query(with_(GAIN, "SELECT word, round(gain, 6) AS gain FROM gain"))
def q_info_gain(spark, d):
    return wi.info_gain(docs(spark, d)).withColumn("gain", F.round("gain", 6))


@query(with_(DOCS, "SELECT word, df FROM df"))
def q_index_merge(spark, d):
    """The index of two batches added up is that of all."""
    x = docs(spark, d)
    return wi.merged_counts(wi.doc_frequency(x.filter("uid % 2 = 0")), wi.doc_frequency(x.filter("uid % 2 <> 0")), ["word"], "df")


@query(with_(GEO, "SELECT geo, num_docs FROM bt"))
def q_geo_doc_totals(spark, d):
    return wi.docs_by_tile(docs(spark, d))


@query(with_(GEO, "SELECT geo, alias FROM al"))
def q_geo_aliases(spark, d):
    return wi.tile_aliases(wi.docs_by_tile(docs(spark, d)), TILE_DOCS)


@query(with_(GEO, "SELECT geo, num_docs FROM fold"))
def q_geo_alias_fold(spark, d):
    by_tile = wi.docs_by_tile(docs(spark, d))
    return wi.folded_tiles(by_tile, wi.tile_aliases(by_tile, TILE_DOCS))


@query(with_(GEO, "SELECT geo, word, round(ln(2) * ln(num_docs / df), 9) AS score FROM gdf JOIN fold USING (geo)"))
def q_geo_tfidf(spark, d):
    return wi.geo_tfidf_scores(docs(spark, d), TILE_DOCS).withColumn("score", F.round("score", 9))


GEO_GAIN = GEO + f""",
reach AS (SELECT x * 1024 + y AS tile, coalesce(alias, r.geo) AS geo FROM ({_around(4, '(SELECT DISTINCT x, y FROM xy)')}) r LEFT JOIN al ON al.geo = r.geo),
dw AS (SELECT row_number() OVER () AS k, x * 1024 + y AS tile, list_distinct(tokens) AS t FROM xy),
ew AS (SELECT k, tile, unnest(t) AS word FROM dw),
co0 AS (SELECT a.tile, a.word, b.word AS other, count(*) AS n FROM ew a JOIN ew b ON a.k = b.k AND a.word <> b.word GROUP BY ALL),
gco AS (SELECT geo, word, other, sum(n) AS n FROM co0 JOIN reach USING (tile) GROUP BY ALL),
gsh AS (SELECT geo, word, other, n / sum(n) OVER (PARTITION BY geo, word) AS share FROM gco),
gmp AS (SELECT geo, word, df / num_docs AS p FROM gdf JOIN fold USING (geo)),
gg AS (SELECT gsh.geo, gsh.word, greatest(sum(share * log2(share / p)), 0) AS gain FROM gsh JOIN gmp ON gsh.other = gmp.word AND gsh.geo = gmp.geo GROUP BY ALL),
ggain AS (SELECT gmp.geo, gmp.word, coalesce(gain, log2(1 / p)) AS gain FROM gmp LEFT JOIN gg ON gg.geo = gmp.geo AND gg.word = gmp.word)"""


@query(with_(GEO_GAIN, "SELECT geo, word, round(gain, 6) AS gain FROM ggain"))
def q_geo_info_gain(spark, d):
    return wi.geo_info_gain(docs(spark, d), TILE_DOCS).withColumn("gain", F.round("gain", 6))


# --- blocking ---------------------------------------------------------------------------------------------------------
@query(with_(KEYS, "SELECT part || '@g' || geo AS block_key, count(*) AS size FROM own GROUP BY ALL HAVING count(*) > 1"))
def q_block_sizes(spark, d):
    return blocking.block_sizes(blocking.block_keys(venues(spark, d), ADDRESS))


@query(with_(PAIRS, "SELECT uid1, uid2 FROM pairs"))
def q_candidate_pairs(spark, d):
    return blocking.candidate_pairs(venues(spark, d), ADDRESS)


@query(with_(KEYS, "SELECT DISTINCT k.uid AS uid1, c.uid2 FROM kall k JOIN (SELECT part, geo, min(uid) AS uid2 FROM kall GROUP BY ALL) c USING (part, geo) WHERE k.uid > c.uid2"))
def q_star_pass1(spark, d):
    return blocking.star_first(blocking.block_keys(venues(spark, d), ADDRESS, around=True))


_STAR = KEYS + """,
cen AS (SELECT part, geo, min(uid) AS c FROM kall GROUP BY ALL),
pairs AS (SELECT DISTINCT k.uid AS uid1, c AS uid2 FROM kall k JOIN cen USING (part, geo) WHERE k.uid > c)""" + _JUDGED + """,
rest AS (SELECT part, geo, uid FROM kall JOIN cen USING (part, geo) WHERE uid > c),
two AS (SELECT DISTINCT greatest(l.uid, r.uid) AS uid1, least(l.uid, r.uid) AS uid2 FROM rest l JOIN rest r USING (part, geo) WHERE l.uid <> r.uid AND l.uid NOT IN (SELECT uid1 FROM judged))"""


@query(with_(_STAR, "SELECT uid1, uid2 FROM two"))
def q_star_pass2(spark, d):
    recs = venues(spark, d)
    keys = materialize(blocking.block_keys(recs, ADDRESS, around=True), "block-keys")
    first = pipelines.judged_addresses(blocking.star_first(keys), recs, ADDRESS)
    return blocking.star_second(keys, first)


_SECOND = _JUDGED[_JUDGED.index("\nv AS") :].replace("\nv AS", "\nv2 AS").replace("FROM pairs JOIN", "FROM two JOIN").replace("\nw AS", "\nw2 AS").replace("FROM v)", "FROM v2)").replace("\njudged AS", "\njudged2 AS").replace("FROM w WHERE", "FROM w2 WHERE")


@query(with_(_STAR + "," + _SECOND, "SELECT uid1, uid2, status, sim FROM judged UNION SELECT uid1, uid2, status, sim FROM judged2"))
def q_star_pairs(spark, d):
    from dataclasses import replace

    return pipelines.dedupe_addresses(venues(spark, d), replace(ADDRESS, pairing="star"))


@query(with_(KEYS + ",\npairs AS (" + _MEET.format("a.uid % 2 <> 0 AND b.uid % 2 = 0") + ")" + _JUDGED, "SELECT uid1, uid2, status, sim FROM judged"))
def q_link_match(spark, d):
    """Two data sets: the records of even and of odd uid."""
    recs = venues(spark, d)
    return pipelines.match(recs.filter("uid % 2 = 0"), recs.filter("uid % 2 <> 0"), ADDRESS)


# --- classification ---------------------------------------------------------------------------------------------------
def _narrow(spark, d, *fields: str) -> DataFrame:
    """The venues with what their pairs are found by and ``fields``, written once."""
    return materialize(venues(spark, d).select("uid", *dict.fromkeys(("road", "house_number", "house_number_base", "lat", "lon", *fields))), "venues")


def _pairs(spark, d, *fields: str, keys: dict[str, Column] | None = None) -> DataFrame:
    """The candidate pairs with both sides' ``fields`` and ``keys``; the latter are worked out once per record, not per pair."""
    recs = _narrow(spark, d, *fields)
    own = recs.select("uid", *fields) if keys is None else recs.select("uid", *[k.alias(n) for n, k in keys.items()])
    return blocking.join_pairs(blocking.candidate_pairs(recs, ADDRESS), own)


@query(with_(PAIRS + f", st AS (SELECT uid, {_JOINED.format('road')} AS street FROM rec)", f"SELECT uid1, uid2, s.status AS status, s.sim AS sim FROM (SELECT uid1, uid2, {_street('a.street', 'b.street')} AS s FROM pairs JOIN st a ON a.uid = uid1 JOIN st b ON b.uid = uid2)"))
def q_street_status(spark, d):
    v = classify.street_status(F.col("road1"), F.col("road2"), fuzzy=True)
    return _pairs(spark, d, "road").withColumn("v", v).select("uid1", "uid2", "v.status", "v.sim")


@query(with_(JUDGED, "SELECT uid1, uid2, v.status AS status, v.sim AS sim FROM w"))
def q_address_status(spark, d):
    v = classify.address_status(fuzzy=True, keyed=True)
    return _pairs(spark, d, "unit", "floor", keys=classify.address_keys("")).withColumn("v", v).select("uid1", "uid2", "v.status", "v.sim")


def _unit_sql(c: str) -> str:
    folded = f"replace(replace(replace(translate(lower({c}), '{_MARKED}', '{_PLAIN}'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"
    return f"nullif(regexp_replace(regexp_replace(regexp_replace({folded}, '\\b(?:apartment|apt|unit|suite|ste|room|rm|floor|fl|level|no|number)\\b|/f\\b|#', ' ', 'g'), '\\b([0-9]+)(?:st|nd|rd|th)\\b', '\\1', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"


@query(with_(PAIRS + f", un AS (SELECT uid, {_unit_sql('unit')} AS u, {_unit_sql('floor')} AS f FROM rec)", "SELECT uid1, uid2, coalesce(a.u = b.u, true) AND coalesce(a.f = b.f, true) AS same FROM pairs JOIN un a ON a.uid = uid1 JOIN un b ON b.uid = uid2"))
def q_sub_building(spark, d):
    return _pairs(spark, d, "unit", "floor").select("uid1", "uid2", classify.is_sub_building_dupe().alias("same"))


_NAMED = PAIRS + f", nm AS (SELECT uid, {_sql_tokens('house')} AS t FROM rec), np AS (SELECT uid1, uid2, a.t AS a, b.t AS b FROM pairs JOIN nm a ON a.uid = uid1 JOIN nm b ON b.uid = uid2)"


@query(with_(_NAMED + ", k AS (SELECT uid1, uid2, len(a) + len(b) AS total, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))) AS shared FROM np WHERE a IS NOT NULL AND b IS NOT NULL)", "SELECT uid1, uid2, round(coalesce(shared, 0) / nullif(total - coalesce(shared, 0), 0), 9) AS jaccard FROM k"))
def q_jaccard_multiset(spark, d):
    both = _pairs(spark, d, "house").filter("house1 IS NOT NULL AND house2 IS NOT NULL")
    return both.select("uid1", "uid2", F.round(multiset_jaccard(tokens(F.col("house1")), tokens(F.col("house2"))), 9).alias("jaccard"))


_OPTIONAL = ", ".join(f"'{w}'" for w in OPTIONAL_WORDS)


_CLASSED = _NAMED + f", c AS (SELECT uid1, uid2, a, b, list_sort(list_distinct(list_filter(a, lambda w: w NOT IN ({_OPTIONAL})))) AS u, list_sort(list_distinct(list_filter(b, lambda w: w NOT IN ({_OPTIONAL})))) AS v FROM np), cl AS (SELECT uid1, uid2, CASE WHEN a IS NULL OR b IS NULL OR len(a) = 0 OR len(b) = 0 THEN NULL WHEN a = b THEN 3 WHEN len(u) > 0 AND u = v THEN 2 WHEN len(list_intersect(u, v)) / nullif(len(list_distinct(list_concat(u, v))), 0) >= 0.5 THEN 1 ELSE 0 END AS status FROM c)"


@query(with_(_CLASSED, "SELECT uid1, uid2, status FROM cl"))
def q_name_class(spark, d):
    return _pairs(spark, d, "house").select("uid1", "uid2", classify.name_status(F.col("house1"), F.col("house2")).alias("status"))


_SOFT = PAIRS + f""",
docs AS (SELECT uid, {_sql_tokens('house')} AS tokens FROM rec),
tok AS (SELECT uid, unnest(range(len(tokens)))::INTEGER AS pos, unnest(tokens) AS word FROM docs),
n AS (SELECT count(*)::DOUBLE AS n FROM docs WHERE len(tokens) > 0),
df AS (SELECT word, count(DISTINCT uid) AS df FROM tok GROUP BY word),
s AS (SELECT uid, pos, word, ln(2) * ln(n / df) AS s FROM tok JOIN df USING (word), n),
z AS (SELECT uid, sqrt(sum(s * s)) AS norm, count(*) AS k FROM s GROUP BY uid),
sc AS (SELECT uid, pos, word, k, CASE WHEN norm < 1e-12 THEN 1.0 / k ELSE s / norm END AS s FROM s JOIN z USING (uid)),
m AS (SELECT uid1, uid2, CASE WHEN a.k > b.k THEN b.pos ELSE a.pos END AS i, CASE WHEN a.k > b.k THEN a.pos ELSE b.pos END AS j, jaro_winkler_similarity(a.word, b.word) AS jw, a.s * b.s AS w FROM pairs JOIN sc a ON a.uid = uid1 JOIN sc b ON b.uid = uid2),
b AS (SELECT uid1, uid2, i, max(jw) AS jw, arg_max(w, (jw, j)) AS w FROM m GROUP BY uid1, uid2, i),
soft AS (SELECT uid1, uid2, sum(CASE WHEN jw >= 0.95 THEN jw * w ELSE 0 END) AS sim FROM b GROUP BY uid1, uid2)"""


@query(with_(_SOFT, "SELECT uid1, uid2, round(sim, 6) AS sim FROM soft"))
def q_soft_tfidf(spark, d):
    ship(spark)
    recs = _narrow(spark, d, "house")
    x = materialize(pipelines.name_docs(recs).filter(F.size("tokens") > 0), "name-docs")
    both = blocking.join_pairs(blocking.candidate_pairs(recs, ADDRESS), wi.scored_docs(x, wi.tfidf_scores(x)))
    return both.select("uid1", "uid2", F.round(soft_tfidf()("tokens1", "scores1", "tokens2", "scores2"), 6).alias("sim"))


@query()
def q_geo_blend(spark, d):
    """Names by the model of their tile and the global one, blended."""
    from dataclasses import replace

    recs = venues(spark, d).filter(F.trim("house") != "")
    config = replace(NAMES, geo_model=True, min_tile_docs=TILE_DOCS)
    pairs = materialize(blocking.candidate_pairs(recs, ADDRESS), "candidates")
    sims = pipelines.name_similarity(pairs, recs, config)
    return sims.select("uid1", "uid2", F.round("fuzzy", 6).alias("similarity"), classify.class_of(F.col("fuzzy")).alias("status"))


_CODES = ", ".join(f"'{k}': '{v}'" for k, v in CALLING_CODES.items())


def _national(p: str) -> str:
    s = f"regexp_replace(regexp_replace(regexp_replace(lower({p}), '(?:ext\\.?|x)\\s*[0-9]+\\s*$', ''), '[^0-9+]', '', 'g'), '^00', '+')"
    t = f"CASE WHEN code IS NULL THEN NULL WHEN starts_with({s}, '+' || code) THEN substr({s}, length(code) + 2) WHEN code = '1' AND regexp_matches({s}, '^1[0-9]{{10}}$') THEN substr({s}, 2) ELSE {s} END"
    return f"nullif(regexp_extract(ltrim({t}, '0'), '^[0-9]{{7,}}$'), '')"


_REVISED = _CLASSED + f""",
ct AS (SELECT uid, nullif(upper(trim(country)), '') AS c, phone FROM rec),
ph AS (SELECT uid1, uid2, status AS before, a.c AS c1, b.c AS c2, a.phone AS p1, b.phone AS p2, MAP {{{_CODES}}}[coalesce(a.c, b.c, 'US')] AS code FROM cl JOIN ct a ON a.uid = uid1 JOIN ct b ON b.uid = uid2),
ag AS (SELECT uid1, uid2, before, CASE WHEN coalesce(c1 = c2, true) THEN {_national('p1')} = {_national('p2')} END AS agree FROM ph)"""


@query(with_(_REVISED, "SELECT uid1, uid2, before, agree, CASE WHEN before = 1 AND agree THEN 2 WHEN before = 2 AND NOT agree THEN 1 ELSE before END AS after FROM ag"))
def q_phone_revision(spark, d):
    """The status of each pair of names before and after the phones are compared."""
    recs = _narrow(spark, d, "house", "phone", "country", "unit", "floor")
    named = classify.match_keys(recs).select("uid", "words", "core", "phone", "country")
    both = blocking.join_pairs(blocking.candidate_pairs(recs, ADDRESS), named)
    before = classify.name_status_of(*[F.col(c) for c in ("words1", "words2", "core1", "core2")])
    both = both.select("uid1", "uid2", before.alias("before"), "phone1", "phone2", "country1", "country2")
    return both.select("uid1", "uid2", "before", classify.phone_agreement().alias("agree")).withColumn("after", classify.phone_revised(F.col("before"), F.col("agree")))


@query(with_(PAIRS, "SELECT uid1, uid2 FROM pairs JOIN rec a ON a.uid = uid1 JOIN rec b ON b.uid = uid2 WHERE a.house = b.house"))
def q_exact_dupes(spark, d):
    return _pairs(spark, d, "house").filter("house1 = house2").select("uid1", "uid2")


# --- pipelines --------------------------------------------------------------------------------------------------------
@query(with_(JUDGED, "SELECT uid1, uid2, status, sim FROM judged"))
def q_dedupe_addresses(spark, d):
    return pipelines.dedupe_addresses(venues(spark, d), ADDRESS)


@query(with_(DUPES, "SELECT uid FROM rec WHERE uid NOT IN (SELECT uid FROM dup)"))
def q_unique(spark, d):
    return pipelines.unique(venues(spark, d), ADDRESS).select("uid")


@query(with_(DUPES, "SELECT uid FROM can"))
def q_canonical_flags(spark, d):
    return responses.canonicals(materialize(pipelines.dedupe_addresses(venues(spark, d), ADDRESS), "pairs"))


@query(with_(JUDGED, "SELECT uid1, max(struct_pack(status := status, sim := sim, o := -uid2)).status AS status, max(struct_pack(status := status, sim := sim, o := -uid2)).sim AS sim, -max(struct_pack(status := status, sim := sim, o := -uid2)).o AS uid2 FROM judged GROUP BY uid1"))
def q_best_dupe(spark, d):
    return responses.best_match(pipelines.dedupe_addresses(venues(spark, d), ADDRESS))


@query(with_(DUPES, "SELECT uid1, uid2, CASE status WHEN 3 THEN 'exact_dupe' WHEN 2 THEN 'likely_dupe' WHEN 1 THEN 'needs_review' END AS classification, least(sim, 1.0) AS similarity, uid2 IN (SELECT uid FROM can) AS is_canonical, status >= 2 AS is_sure FROM judged"))
def q_responses(spark, d):
    """What the responses list, flat."""
    return responses.response_lists(materialize(pipelines.dedupe_addresses(venues(spark, d), ADDRESS), "pairs"))


@query(with_(DUPES, "SELECT uid FROM dup"))
def q_dupes_only(spark, d):
    return responses.dupes(pipelines.dedupe_addresses(venues(spark, d), ADDRESS))


_GEOCODE = REC + f""",
gp AS (SELECT uid, {_PART} || '@p' || trim(replace(replace(replace(translate(lower(CASE WHEN regexp_matches(postcode, '^\\s*([0-9]{{5}})-?[0-9]{{4}}\\s*$') THEN regexp_extract(postcode, '([0-9]{{5}})', 1) ELSE postcode END), '{_MARKED}', '{_PLAIN}'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')) AS k, lat IS NOT NULL AS located, postcode
  FROM (SELECT uid, postcode, lat, {_HOUSE.format('num')} AS num, {_JOINED.format('road')} AS street FROM (SELECT uid, postcode, lat, road, unnest(list_distinct(CASE WHEN house_number IS NULL THEN [NULL] WHEN house_number_base IS NULL THEN [house_number] ELSE [house_number, house_number_base] END)) AS num FROM rec WHERE house_number IS NOT NULL
  UNION ALL SELECT uid, postcode, lat, road, NULL FROM rec WHERE house_number IS NULL)) WHERE trim(postcode) <> ''),
pairs AS (SELECT DISTINCT a.uid AS uid1, b.uid AS uid2 FROM gp a JOIN gp b ON a.k = b.k AND NOT a.located AND b.located)""" + _JUDGED


@query(with_(_GEOCODE, "SELECT uid1, uid2, status, sim FROM (SELECT *, row_number() OVER (PARTITION BY uid1 ORDER BY status DESC, sim DESC, uid2) AS k FROM judged) WHERE k = 1"))
def q_geocode_link(spark, d):
    from dataclasses import replace

    return pipelines.geocode(places(spark, d), replace(ADDRESS, use_zip5=True))


@query("""WITH u AS (SELECT uid, arg_max(struct_pack(p := properties, g := geometry), loaded_at) AS s FROM features WHERE uid IS NOT NULL GROUP BY uid)
SELECT uid, s.p['name'] AS name, s.p['addr:street'] AS street, s.g.coordinates[1] AS lon, s.g.coordinates[2] AS lat FROM u""")
def q_read_features(spark, d):
    """The Features written as JSON lines and read again."""
    rows = _features(spark, d).withColumn("properties", F.map_concat("properties", F.create_map(F.lit("uid"), F.col("uid").cast("string"))))
    path = f"{own_scratch(spark)}/features-{uuid.uuid4().hex}"
    rows.select(F.to_json(F.struct("type", "geometry", "properties")).alias("value")).write.text(path)
    p = F.col("properties")
    return read_any(spark, path).select(p["uid"].cast("bigint").alias("uid"), p["name"].alias("name"), p["addr:street"].alias("street"), F.get("geometry.coordinates", 0).alias("lon"), F.get("geometry.coordinates", 1).alias("lat"))


@query()
def q_dedupe_names(spark, d):
    """Names and addresses with the blended information-gain model and phones, as the options are by default."""
    from dataclasses import replace

    out = pipelines.dedupe_names(venues(spark, d), replace(DedupeConfig(), min_tile_docs=TILE_DOCS))
    return out.select("uid1", "uid2", "status", F.round("sim", 6).alias("sim"))


@query()
def q_resolve(spark, d):
    """The whole way from Features to one JSON response each, by name and address."""
    features = with_guid(_features(spark, d))
    return pipelines.resolve(features, DedupeConfig())


assert LIKELY_DUPLICATE == 2 and CALLING_CODES["US"] == "1"  # as the SQL has them
