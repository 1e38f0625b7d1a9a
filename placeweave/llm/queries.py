"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm import addresses, fusion, mixing, names, subjects, terms, tokenizer
from placeweave.sources.tables import latest_delivery, prop, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = latest_delivery(table(spark, sf_dir, "features"), "uid", {"name": prop("name")})
    return terms.top_term(terms.term_scores(names, "uid", "name", wanted=table(spark, sf_dir, "name_probes")), "uid")


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = latest_delivery(table(spark, sf_dir, "features"), "uid", {"name": prop("name")})
    return terms.term_scores(names, "uid", "name").withColumn("score", F.round("score", 4))


def _venues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict]:
    columns = {"guid": prop("lieu:guid"), "feed": F.col("feed"), "updated_at": F.col("updated_at")} | {f: prop(f) for f in ("name", "phone", "website")}
    features = table(spark, sf_dir, "features").filter(prop("lieu:guid").isNotNull())
    return latest_delivery(features, "uid", columns), table(spark, sf_dir, "feeds"), {f: F.col(f) for f in ("name", "phone", "website")}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, feeds, fields = _venues(spark, sf_dir)
    return fusion.survivors(records, feeds, "guid", fields)


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, feeds, fields = _venues(spark, sf_dir)
    return fusion.fuse(records, feeds, "guid", fields)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"street": prop("addr:street"), "number": prop("addr:housenumber"), "city": prop("addr:city"), "postcode": prop("addr:postcode")}
    return addresses.match_addresses(latest_delivery(table(spark, sf_dir, "features"), "uid", columns))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"name": prop("name"), "wof": prop("wof:name"), "street": prop("addr:street"), "number": prop("addr:housenumber"), "city": prop("addr:city"), "postcode": prop("addr:postcode")}
    return names.match_names(latest_delivery(table(spark, sf_dir, "features"), "uid", columns), other_name="wof")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents"))


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's ids decode to its text."""
    # Texts are compared by their digests, so that none crosses the network.
    there = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.coalesce("text", F.lit(""))).alias("text"))
    back = tokenizer.decode(p7_ids(spark, sf_dir)).select("doc_id", F.sha1("text").alias("decoded"))
    return back.join(there, "doc_id").select("doc_id", (F.col("decoded") == F.col("text")).alias("exact"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return subjects.assign(documents, subjects.fit(documents, table(spark, sf_dir, "subject_examples")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (p1_found, p1_scores, p2_found, p2_values, p4_found, p6_found, p7_ids, p7_roundtrip, p8_mix, p8_shares, p9_found)}

_P1 = """
WITH d AS (SELECT uid, arg_max(properties['name'], loaded_at) AS name FROM features WHERE uid IS NOT NULL GROUP BY uid),
t AS (SELECT uid, lower(unnest(regexp_extract_all(name, '[\\p{L}\\p{N}]+'))) AS term FROM d),
r AS (SELECT uid, term, count(*)::DOUBLE AS a FROM t GROUP BY ALL),
l AS (SELECT uid, sum(a) AS r FROM r GROUP BY uid),
c AS (SELECT term, count(*)::DOUBLE AS t FROM t GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM t),
x AS (SELECT uid, term, a, r, t, n, t - a AS b, r - a AS c, n - t - r + a AS d FROM r JOIN l USING (uid) JOIN c USING (term), n),
s AS (SELECT uid, term, a::INTEGER AS tf, t::BIGINT AS in_all, CASE WHEN a * n >= r * t THEN 1 ELSE -1 END * 2 * (
  CASE WHEN a > 0 THEN a * ln(a * n / (r * t)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b * n / ((n - r) * t)) ELSE 0 END +
  CASE WHEN c > 0 THEN c * ln(c * n / (r * (n - t))) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d * n / ((n - r) * (n - t))) ELSE 0 END) AS score FROM x)
"""
_P2 = """
WITH u AS (SELECT uid, arg_max(properties['lieu:guid'], loaded_at) AS guid, arg_max(feed, loaded_at) AS feed, arg_max(updated_at, loaded_at) AS ts,
  arg_max(properties['name'], loaded_at) AS name, arg_max(properties['phone'], loaded_at) AS phone, arg_max(properties['website'], loaded_at) AS website
  FROM features WHERE properties['lieu:guid'] IS NOT NULL GROUP BY uid),
m AS (SELECT guid FROM u WHERE trim(guid) <> '' GROUP BY guid HAVING count(*) > 1),
v AS (SELECT uid, guid, feed, ts, trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS name,
  regexp_replace(regexp_replace(regexp_replace(lower(phone), '(ext|x)[. ]*[0-9]*$', ''), '[^0-9+]', '', 'g'), '^(\\+49|0049|\\+1|001)', '') AS phone,
  regexp_replace(regexp_replace(regexp_replace(lower(trim(website)), '^https?://', ''), '[/?#].*$', ''), '^www\\.', '') AS website FROM u JOIN m USING (guid)),
w AS (SELECT uid, guid, feed, ts, name, website, CASE WHEN length(phone) = 11 AND phone[1] IN ('0', '1') THEN phone[2:] ELSE phone END AS phone FROM v),
x AS (SELECT guid, 'name' AS field, uid, feed, ts FROM w WHERE name <> '' AND name NOT IN ('n a', 'name', 'no name', 'no name given', 'tbd', 'test', 'unknown', 'unnamed', 'xxx')
  UNION ALL SELECT guid, 'phone', uid, feed, ts FROM w WHERE regexp_matches(phone, '^[0-9]{10}$') AND phone <> '1234567890' AND phone <> repeat(phone[1], 10)
  UNION ALL SELECT guid, 'website', uid, feed, ts FROM w WHERE regexp_matches(website, '^[^@\\s.]+(\\.[^@\\s.]+)+$'))
SELECT guid, field, arg_min(uid, (trust_rank, -epoch_us(ts), uid)) AS uid FROM x JOIN feeds USING (feed) GROUP BY guid, field
"""
SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT uid, arg_min(term, (-score, term)) AS term FROM s WHERE uid IN (SELECT uid FROM name_probes) GROUP BY uid",
    "p1_scores": _P1 + "SELECT uid, term, tf, in_all, round(score, 4) AS score FROM s",
    "p2_found": _P2,
    "p7_roundtrip": "SELECT doc_id, true AS exact FROM documents",
}
