import math
from collections import Counter
from datetime import datetime

import pytest
import regex
from pyspark.sql import functions as F

from placeweave.llm import fusion, terms


def test_scores_equal_the_formula(spark):
    rows = [(1, "Red Fox Red"), (2, "red hen"), (3, "FOX-den 9"), (4, None), (5, ""), (6, "!!!"), (None, "red")]
    got = {(r["uid"], r["term"]): (r["tf"], r["in_all"], r["score"]) for r in terms.term_scores(spark.createDataFrame(rows, "uid long, name string"), "uid", "name").collect()}
    docs = {k: [t.lower() for t in regex.findall(r"[\p{L}\p{N}]+", s)] for k, s in rows if k and s}
    all_ = Counter(t for d in docs.values() for t in d)
    n = sum(all_.values())
    want = {}
    for k, d in docs.items():
        for t, a in Counter(d).items():
            r, c = len(d), all_[t]
            table = [(a, r, c), (c - a, n - r, c), (r - a, r, n - c), (n - r - c + a, n - r, n - c)]
            g = 2 * sum(o * math.log(o * n / (x * y)) for o, x, y in table if o)
            want[k, t] = (a, c, pytest.approx(g if a * n >= r * c else -g))
    assert got == want


def test_top_term_ties_wanted_and_clashing_columns(spark):
    rows = [(1, "zeta alpha the"), (2, "the common"), (3, "the common"), (4, "the")]
    df = spark.createDataFrame(rows, "uid long, name string").withColumns({"term": F.lit("x"), "k": F.lit(1), "score": F.lit(2.0), "terms": F.lit("y")})
    wanted = spark.createDataFrame([(1,), (1,), (9,), (None,)], "uid long")
    assert [tuple(r) for r in terms.top_term(terms.term_scores(df, "uid", "name", wanted), "uid").collect()] == [(1, "alpha")]
    assert terms.top_term(terms.term_scores(df.limit(0), "uid", "name"), "uid").collect() == []


def test_a_very_long_name_is_read_whole(spark):
    df = spark.createDataFrame([(1, "word " * 20000 + "needle"), (2, "word")], "uid long, name string")
    assert terms.top_term(terms.term_scores(df, "uid", "name").filter("uid = 1"), "uid").first()["term"] == "needle"


def test_usable_values(spark):
    def texts(f, values):
        return [r[0] or None for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]

    assert texts(fusion.usable_name, ["Foo Bar!", "(no name)", "N/A", "???", "  ", "", None, "TBD", "Café 9"]) == ["foo bar", None, None, None, None, None, None, None, "café 9"]
    good = ["555-827-9251", "+1 555 827 9251", "1-555-827-9251", "(555) 827-9251 ext. 12", "tel:+1-555-827-9251", "001 555 827 9251"]
    assert texts(fusion.usable_phone, good) == ["5558279251"] * 6
    assert texts(fusion.usable_phone, ["+49 999 2312329", "0999/2312329", "0049 999 231 2329"]) == ["9992312329"] * 3
    assert texts(fusion.usable_phone, ["9999999999", "1234567890", "834-5551", "+1", "", None, "ask at desk", "+1555360", "555-836-"]) == [None] * 9
    assert texts(fusion.usable_website, ["HTTP://WWW.Foo-Bar.co.example/index.html", "foo.test", "www.foo.test/?a=b", "https://foo.test:80/x"]) == ["foo-bar.co.example", "foo.test", "foo.test", "foo.test"]
    assert texts(fusion.usable_website, ["info@foo.test", "www", "http://", "https://www.", "http://localhost", "n/a", "-", "", None, "two words.test"]) == [None] * 10


FEEDS = [("a", 1), ("b", 2), ("c", 3), (None, 4)]
SCHEMA = "uid long, guid string, feed string, updated_at timestamp, name string, phone string"


def fuse(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"g": F.lit("q"), "value": F.lit("w"), "field": F.lit(0)})
    return fusion.fuse(df, spark.createDataFrame(FEEDS, "feed string, trust_rank int"), "guid", {"name": F.col("name"), "phone": F.col("phone")})


def test_survivors_by_trust_then_time(spark):
    t = lambda y: datetime(y, 1, 1)
    rows = [
        (1, "x", "b", t(2020), "Old", "555-827-9251"), (2, "x", "b", t(2022), "New", None), (3, "x", "a", t(2001), "n/a", "12"),
        (4, "y", "c", t(2020), "Alone", None), (5, " ", "a", t(2020), "Blank", None), (6, None, "a", t(2020), "Null", None),
        (7, "z", None, t(2023), "Unranked", None), (8, "z", "c", None, "Ranked", None), (9, "z", "c", None, "Ranked too", None),
    ]
    got = {(r["guid"], r["field"]): r["uid"] for r in fuse(spark, rows).filter("survives").collect()}
    assert got == {("x", "name"): 2, ("x", "phone"): 1, ("z", "name"): 8}
    assert fuse(spark, []).collect() == []


def test_the_model_finds_the_bad_source_and_keeps_several_values(spark):
    rows = []
    for g in range(60):
        for k, feed in enumerate("aab"):
            rows.append((10 * g + k, f"g{g}", feed, None, f"Name {g}", "555-827-9251"))
        rows.append((10 * g + 5, f"g{g}", "c", None, f"Wrong {g * 7}", "555-827-9251" if g % 2 else f"555-111-{1000 + g}"))
    got = fuse(spark, rows)
    by = {(r["guid"], r["value"]): r for r in got.filter("field = 'name'").collect()}
    assert by["g3", "name 3"]["probability"] > by["g3", "wrong 21"]["probability"]
    assert got.filter("survives").groupBy("guid", "field").count().filter("count <> 1").count() == 0
    assert by["g3", "name 3"]["is_true"]
