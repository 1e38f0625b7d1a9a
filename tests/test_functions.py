import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeweave.functions.coords import close_to, degrees, valid_latitude, wrapped_longitude
from placeweave.functions.phones import calling_code, national_number
from placeweave.functions.similarity import jaro_winkler, soft_tfidf
from placeweave.functions.text import house_key, joined, tokens, unit_key, zip5
from placeweave.functions.tiles import geohash, tile, tile_and_neighbors
from placeweave.functions.vectors import l1_normalized, l2_normalized, multiset_jaccard


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_coordinate_texts(spark):
    texts = ["40°42′46″N", "74°00′21″W", "40,74 N", "74,001 W", "-37.5", "37.5 S", "-37.5 S", " ;12.25|", "122.4 W", "7 d 30 m E", "abc", "", None, "40:30:00"]
    want = [40 + 42 / 60 + 46 / 3600, -(74 + 21 / 3600), 40.74, -74.001, -37.5, -37.5, -37.5, 12.25, -122.4, 7.5, None, None, None, 40.5]
    assert one(spark, texts, degrees) == [w if w is None else pytest.approx(w) for w in want]


def test_coordinates_within_other_text(spark):
    texts = ["Latitude: 40.7", "40.7 degrees", "40.7 deg N", "W74.001", "S 12", "south"]
    assert one(spark, texts, degrees) == [40.7, 40.7, 40.7, -74.001, -12.0, None]


def test_latitudes_and_longitudes(spark):
    assert one(spark, [90.0, -90.0, 90.5, 45.0, None, float("nan"), float("inf")], valid_latitude, "double") == [89.9999, -89.9999, None, 45.0, None, None, None]
    assert one(spark, [180.0, -180.0, 540.0, 190.0, -190.0, float("inf"), None], wrapped_longitude, "double") == [180.0, 180.0, 180.0, -170.0, 170.0, None, None]
    assert one(spark, [1.0 + 1e-12, 1.1], lambda c: close_to(c, F.lit(1.0)), "double") == [True, False]


def test_known_geohashes_and_edges(spark):
    df = spark.createDataFrame([(42.605, -5.603), (57.64911, 10.40744), (89.9999, 180.0)], "lat double, lon double")
    got = [tuple(r) for r in df.select(geohash(F.col("lat"), F.col("lon"), 5), F.size(tile_and_neighbors(F.col("lat"), F.col("lon"), 5))).collect()]
    assert got[:2] == [("ezs42", 9), ("u4pru", 9)] and got[2][1] == 6
    near = spark.createDataFrame([(10.0, 179.9999, -179.9999)], "lat double, a double, b double")
    assert near.select(F.array_contains(tile_and_neighbors(F.col("lat"), F.col("a"), 6), tile(F.col("lat"), F.col("b"), 6))).first()[0]


def test_vectors(spark):
    vs = [[3.0, 4.0], [], [0.0, 0.0], None]
    assert one(spark, vs, l2_normalized, "array<double>") == [[0.6, 0.8], [], [0.5, 0.5], None]
    assert one(spark, vs, l1_normalized, "array<double>")[0] == [pytest.approx(3 / 7), pytest.approx(4 / 7)]


def test_multiset_jaccard(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "b"]), ([], []), (["a"], []), (None, ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(multiset_jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(2 / 3), None, 0.0, None]


def test_written_forms_agree(spark):
    for a, b in (("Main St", "Main Street"), ("W 149th St", "West 149th Street"), ("Sea Grape Ln", "Seagrape Lane"), ("Third Avenue", "3rd Ave")):
        x, y = one(spark, [a, b], joined)
        assert x == y, (a, b)
    assert len(set(one(spark, ["Apt 1C", "#1C", "Apt No. 1 C"], unit_key))) == 1
    assert len(set(one(spark, ["Fl 1", "1st Floor", "1/F"], unit_key))) == 1
    assert one(spark, ["Apt 2C", "", None], unit_key) == ["2c", None, None]
    assert one(spark, ["94109-1234", "941091234", "94109", "x", None], zip5) == ["94109", "94109", "94109", "x", None]
    assert one(spark, ["12A", "12-a", " 12 a", "No. 12", "", None], house_key) == ["12a", "12a", "12a", "12", None, None]
    assert one(spark, [None, "", "Ünal's Café & Co."], tokens) == [None, [], ["unals", "cafe", "&", "company"]]


def test_phones(spark):
    numbers = ["(555) 220-8828 ext. 12", "+1 555 220 8828", "1-555-220-8828", "001 555 220 8828", "+44 20 7946 0000", "12", None]
    assert one(spark, numbers, lambda c: national_number(c, calling_code(F.lit("us")))) == ["5552208828"] * 4 + [None, None, None]


def test_jaro_winkler_equals_duckdb():
    import duckdb

    words = ["martha", "marhta", "dixon", "dicksonx", "jellyfish", "smellyfish", "abc", "", "a", "restaurant", "restnt"]
    for a in words:
        for b in words:
            want = duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
            if want >= 0.7 and a and b:
                assert jaro_winkler(a, b) == pytest.approx(want), (a, b)


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", max_size=8), st.text("abcd", max_size=8))
def test_jaro_winkler_is_bounded_and_symmetric_in_equality(a, b):
    assert 0.0 <= jaro_winkler(a, b) <= 1.0 and (jaro_winkler(a, a) == 1.0 or not a)


def test_soft_tfidf(spark):
    rows = [(["a", "b"], [0.6, 0.8], ["b"], [1.0]), (["x"], [1.0], [], []), (None, None, ["a"], [1.0]), (["martha"], [1.0], ["marhta"], [1.0])]
    df = spark.createDataFrame(rows, "t1 array<string>, s1 array<double>, t2 array<string>, s2 array<double>")
    got = [r[0] for r in df.select(soft_tfidf()("t1", "s1", "t2", "s2")).collect()]
    assert got[:3] == [pytest.approx(0.8), 0.0, None] and got[3] == pytest.approx(jaro_winkler("martha", "marhta"))
    assert math.isclose(spark.createDataFrame(rows[3:], df.schema).select(soft_tfidf(0.5, lambda a, b: 0.75)("t1", "s1", "t2", "s2")).first()[0], 0.75)
