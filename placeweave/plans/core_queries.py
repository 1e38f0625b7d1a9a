"""Queries of the problems in the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.operators.proximity import near_pairs, points_in_regions
from placeweave.operators.skew import city_key, exact_quantiles, heavy_keys, postcode_key
from placeweave.sources.tables import latest_delivery, micros, prop, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(latest_delivery(table(spark, sf_dir, "places"), "uid", {"lat": F.col("lat"), "lon": F.col("lon")}), 30.0)


def p3_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions each place lies in: a rhomb for each nation, over 14.4 degrees of longitude either way, overlapping its neighbours."""
    x = F.col("n_nationkey") * 14.4 - 172.8
    y = F.col("n_nationkey") % 5 * 15.0 - 30.0
    vertex = lambda dx, dy: F.array(x + dx, y + dy)
    # The ends of the first and the last stay within 180 degrees.
    wide = F.least(F.lit(14.4), 180 - F.abs(x))
    regions = table(spark, sf_dir, "nation").select("n_nationkey", F.array(vertex(-wide, 0.0), vertex(0.0, -60.0), vertex(wide, 0.0), vertex(0.0, 60.0)).alias("ring"))
    at = latest_delivery(table(spark, sf_dir, "places"), "uid", {"lat": F.col("lat"), "lon": F.col("lon")})
    return points_in_regions(at, regions, region="n_nationkey").withColumnRenamed("region", "n_nationkey")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The update time only has to be a number here: an unknown one counts as 0, so that every feature is counted.
    columns = {"postcode": postcode_key(prop("addr:postcode")), "city": city_key(prop("addr:city")), "at": F.coalesce(micros(F.col("updated_at")), F.lit(0))}
    rows = latest_delivery(table(spark, sf_dir, "features"), "uid", columns)
    return rows.select(F.nullif("postcode", F.lit("")).alias("postcode"), F.nullif("city", F.lit("")).alias("city"), "at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(_keyed(spark, sf_dir).select("postcode", "city"), ["postcode", "city"], 0.01).select("postcode", "city")


def p5_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = exact_quantiles(_keyed(spark, sf_dir), ["postcode", "city"], "at", [0.1, 0.5, 0.9])
    return q.select("postcode", "city", "n", *[F.col(c).cast("bigint").alias(c) for c in ("q10", "q50", "q90")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (p3_found, p3_regions, p5_found, p5_quantiles)}

_P5 = """
WITH d AS (SELECT uid, arg_max(properties['addr:postcode'], loaded_at) AS p, arg_max(properties['addr:city'], loaded_at) AS c, coalesce(arg_max(epoch_us(updated_at), loaded_at), 0) AS ts FROM features GROUP BY uid),
k AS (SELECT upper(split_part(regexp_replace(p, '\\s+', '', 'g'), '-', 1)) AS postcode, lower(trim(regexp_replace(c, '\\s+', ' ', 'g'))) AS city, ts FROM d)
"""
SQL: dict[str, str] = {
    "p3_found": """
WITH d AS (SELECT uid, arg_max(struct_pack(lat := lat, lon := lon), loaded_at) AS s FROM places GROUP BY uid),
p AS (SELECT uid, s.lat AS lat, s.lon - 360 * floor(s.lon / 360) AS lon FROM d WHERE s.lat BETWEEN -90 AND 90 AND isfinite(s.lon) AND NOT isnan(s.lat) AND NOT (s.lat = 0 AND s.lon = 0))
SELECT a.uid AS uid_a, b.uid AS uid_b FROM p a JOIN p b ON a.uid < b.uid AND floor(a.lat * 1000) BETWEEN floor(b.lat * 1000) - 1 AND floor(b.lat * 1000) + 1
WHERE 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 30
""",
    "p3_regions": """
WITH d AS (SELECT uid, arg_max(struct_pack(lat := lat, lon := lon), loaded_at) AS s FROM places WHERE uid IS NOT NULL GROUP BY uid),
p AS (SELECT uid, s.lat AS lat, s.lon + 180 - 360 * floor((s.lon + 180) / 360) - 180 AS lon FROM d WHERE s.lat BETWEEN -90 AND 90 AND isfinite(s.lon) AND NOT isnan(s.lat) AND NOT (s.lat = 0 AND s.lon = 0)),
r AS (SELECT n_nationkey, n_nationkey * 14.4::DOUBLE - 172.8::DOUBLE AS x, n_nationkey % 5 * 15.0::DOUBLE - 30 AS y FROM nation)
SELECT uid, n_nationkey FROM p JOIN r ON abs(lon - x) / least(14.4::DOUBLE, 180 - abs(x)) + abs(lat - y) / 60 <= 1
""",
    "p5_found": _P5 + "SELECT postcode, city FROM k WHERE postcode <> '' AND city <> '' GROUP BY ALL HAVING count(*) >= 0.01 * (SELECT count(*) FROM k)",
    "p5_quantiles": _P5 + "SELECT postcode, city, count(*) AS n, quantile_disc(ts, 0.1)::BIGINT AS q10, quantile_disc(ts, 0.5)::BIGINT AS q50, quantile_disc(ts, 0.9)::BIGINT AS q90 FROM k WHERE postcode <> '' AND city <> '' AND ts IS NOT NULL GROUP BY ALL",
}
