import json
import os
import re

import pytest
from pyspark.sql import functions as F

from placeweave.config import DedupeConfig
from placeweave.operators import blocking, classify, responses
from placeweave.operators import word_index as wi
from placeweave.plans import pipelines
from placeweave.session import scratch_dir
from placeweave.sources import geojson, index_io
from placeweave.sources.records import ALIASES, labels_and_values, missing_on_one_side, records, with_languages
from placeweave.sources.tables import latest_delivery
from placeweave.streaming.incremental import current_frequencies, frequency_updater

FIELDS = "uid long, house string, house_number string, house_number_base string, road string, unit string, floor string, suburb string, city string, city_district string, island string, state_district string, postcode string, country string, phone string, lat double, lon double"


def recs(spark, *rows):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FIELDS)


def verdicts(spark, pairs, expr, fields):
    rows = [(i, *[p[0].get(f) for f in fields], *[p[1].get(f) for f in fields]) for i, p in enumerate(pairs)]
    schema = "i int, " + ", ".join(f"{f}{s} string" for s in "12" for f in fields)
    out = spark.createDataFrame(rows, schema).orderBy("i").select(expr.alias("v")).collect()
    return [None if r["v"] is None else tuple(r["v"]) for r in out]


def test_address_truth_table(spark):
    a = lambda r=None, n=None, b=None: {"road": r, "house_number": n, "house_number_base": b}
    pairs = [
        (a("Main St", "1"), a("Main Street", "1")),
        (a("Main St", "1"), a(None, "1")),
        (a("Main St", "1"), a("Main St")),
        (a("Main St", "1"), a("Oak Ave", "1")),
        (a("Main St", "1"), a("Main St", "2")),
        (a("Main St"), a("Main Street")),
        (a(None, "1"), a(None, "1")),
        (a(), a()),
        (a("Main St", "12-14", "12"), a("Main St", "12")),
        (a("Main St", "12b", "12"), a("Main Street", "12")),
        (a("", "1"), a(" ", "1")),
    ]
    got = verdicts(spark, pairs, classify.address_status(), ["road", "house_number", "house_number_base", "unit", "floor"])
    assert got == [(3, 1.0), None, None, (0, 0.0), (0, 0.0), (3, 1.0), (3, 1.0), None, (3, 1.0), (2, 0.9), (3, 1.0)]


def test_fuzzy_streets(spark):
    df = spark.createDataFrame([("Marigold Hillside", "Marigold Hilside"), ("4th Street", "5th Street"), ("Oak", "Oat"), (None, "Oak"), ("", "")], "a string, b string")
    got = [tuple(r["v"]) for r in df.select(classify.street_status(F.col("a"), F.col("b"), True).alias("v")).collect()]
    assert got == [(2, 0.9), (0, 0.0), (0, 0.0), (0, 0.0), (0, 0.0)]


def test_names_phones_and_blend(spark):
    df = spark.createDataFrame([("The Corner Bar", "corner bar the"), ("Corner Bar", "Corner Bar"), ("Corner Bar", "Corner Cafe"), ("A", "B"), (None, "B"), ("Acme Inc", "Acme")], "a string, b string")
    assert [r[0] for r in df.select(classify.name_status(F.col("a"), F.col("b"))).collect()] == [2, 3, 0, 0, None, 2]
    rev = spark.createDataFrame([(1, True), (2, False), (3, False), (2, None), (1, False), (0, True)], "s int, a boolean")
    assert [r[0] for r in rev.select(classify.phone_revised(F.col("s"), F.col("a"))).collect()] == [2, 1, 3, 2, 1, 0]
    both = spark.createDataFrame([("555-220-8828", "+1 555 220 8828", "US", None), ("555-220-8828", "555-220-8829", "US", "US"), ("555-220-8828", "555-220-8828", "US", "DE"), (None, "555-220-8828", None, None)], "phone1 string, phone2 string, country1 string, country2 string")
    assert [r[0] for r in both.select(classify.phone_agreement()).collect()] == [True, False, None, None]
    mix = spark.createDataFrame([(1.0, 0.5), (None, 0.5)], "g double, e double")
    assert [r[0] for r in mix.select(classify.geo_blend(F.col("g"), F.col("e"))).collect()] == [pytest.approx(0.8), 0.5]


def test_units(spark):
    pairs = [({"unit": "Apt 1C"}, {"unit": "#1C"}), ({"unit": "Apt 1C"}, {"unit": "#2C"}), ({"unit": "Apt 1C"}, {}), ({"floor": "1/F"}, {"floor": "Fl 2"})]
    rows = [(i, a.get("unit"), a.get("floor"), b.get("unit"), b.get("floor")) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, unit1 string, floor1 string, unit2 string, floor2 string")
    assert [r[0] for r in df.orderBy("i").select(classify.is_sub_building_dupe()).collect()] == [True, False, True, False]


DOCS = [(1, ["a", "b"]), (2, ["a", "c"]), (3, ["d"]), (4, []), (5, None)]


def test_info_gain_by_hand(spark):
    gain = {r[0]: r[1] for r in wi.info_gain(spark.createDataFrame(DOCS, "uid long, tokens array<string>")).collect()}
    assert gain == {**{w: pytest.approx(0.5849625) for w in "abc"}, "d": pytest.approx(1.5849625)}


def test_scores_in_order_and_merging(spark):
    docs = spark.createDataFrame(DOCS, "uid long, tokens array<string>")
    out = {r["uid"]: (r["tokens"], r["scores"]) for r in wi.scored_docs(docs, wi.tfidf_scores(docs)).collect()}
    assert out[1][0] == ["a", "b"] and sum(x * x for x in out[1][1]) == pytest.approx(1) and out[4] == ([], []) and out[5] == ([], [])
    parts = wi.merged_counts(wi.doc_frequency(docs.filter("uid = 1")), wi.doc_frequency(docs.filter("uid > 1")), ["word"], "df")
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, wi.doc_frequency(docs).collect()))


def test_sparse_tiles_borrow_from_dense_ones(spark):
    docs = spark.createDataFrame([(i, ["w"], 10.0, 10.0 if i < 20 else 10.7) for i in range(21)], "uid long, tokens array<string>, lat double, lon double")
    tiles = wi.docs_by_tile(docs)
    aliases = wi.tile_aliases(tiles, 20)
    folded = wi.folded_tiles(tiles, aliases)
    assert aliases.count() > 0 and folded.agg(F.sum("num_docs")).first()[0] == tiles.agg(F.sum("num_docs")).first()[0]
    assert wi.geo_tfidf_scores(docs, 20).count() > 0 and wi.geo_info_gain(docs, 20).count() > 0


BLOCK = dict(road="Main St", city="X", lat=10.0, lon=20.0)


def test_star_finds_what_the_centre_does_not(spark):
    a = recs(spark, dict(uid=1, house_number="1", **BLOCK), dict(uid=2, house_number="1", **BLOCK), dict(uid=3, house_number="1", **BLOCK), dict(uid=4, house_number="9", **BLOCK))
    config = DedupeConfig(address_only=True)
    every = {tuple(r)[:2] for r in pipelines.dedupe_addresses(a, config).collect()}
    star = {tuple(r)[:2] for r in pipelines.dedupe_addresses(a, DedupeConfig(address_only=True, pairing="star")).collect()}
    assert every == {(2, 1), (3, 1), (3, 2)} and star == {(2, 1), (3, 1)}
    keys = blocking.block_keys(a, config)
    second = blocking.star_second(keys, spark.createDataFrame([], "uid1 long"))
    assert {tuple(r) for r in second.collect()} == {(3, 2)}
    assert {r["uid"] for r in pipelines.unique(a, config).collect()} == {1, 4}


def test_tiles_across_borders_meet(spark):
    a = recs(spark, dict(uid=1, house_number="1", road="Main St", lat=10.0, lon=179.99999), dict(uid=2, house_number="1", road="Main Street", lat=10.0, lon=-179.99999))
    assert [tuple(r) for r in blocking.candidate_pairs(a, DedupeConfig(address_only=True)).collect()] == [(2, 1)]


def test_pairs_are_those_that_share_a_key(spark):
    """The keys of the larger uid in its own tile, those of the smaller one in the nine around."""
    import random

    dice, streets = random.Random(7), ["Long Harbour Road", "Long Harbor Road", "Lng Harbour Road", "Oak St", None, "5th Avenue East"]
    near = [(40.7, -74.0), (0.001, 179.999), (0.001, -179.999), (89.999, 10.0), (-89.999, -180.0), (None, None)]
    rows = []
    for uid in range(1, 301):
        lat, lon = dice.choice(near)
        at = {} if lat is None else {"lat": max(-89.9999, min(89.9999, lat + dice.uniform(-0.02, 0.02))), "lon": (lon + dice.uniform(-0.04, 0.04) + 180) % 360 - 180}
        rows.append({"uid": uid, "road": dice.choice(streets), "house_number": dice.choice(["12", "12 b", None]), "house_number_base": dice.choice(["12", None]), "house": dice.choice(["The Corner Cafe", "Cafe Corner"]), "city": dice.choice(["Lund", None]), **at})
    a = recs(spark, *rows)
    for config in (DedupeConfig(address_only=True, geohash_precision=6), DedupeConfig(use_city=True), DedupeConfig(name_only=True, fuzzy_street_names=False), DedupeConfig(address_only=True, use_latlon=False)):
        own = {}
        for r in blocking.block_keys(a, config, fuzzy=config.fuzzy_street_names).collect():
            own.setdefault(r["block_key"], []).append(r["uid"])
        around = blocking.block_keys(a, config, around=True, fuzzy=config.fuzzy_street_names).collect()
        met = {(x, r["uid"]) for r in around for x in own.get(r["block_key"], [])}
        assert {tuple(r) for r in blocking.candidate_pairs(a, config).collect()} == {(x, y) for x, y in met if x > y}
        odd = {tuple(r) for r in blocking.link_pairs(a.filter("uid % 2 = 0"), a.filter("uid % 2 = 1"), config).collect()}
        assert odd == {(x, y) for x, y in met if x % 2 == 1 and y % 2 == 0}


def test_a_key_normalizes_each_text_once(spark):
    a = recs(spark, {"uid": 1, "road": "Main St", "house_number": "1", "lat": 1.0, "lon": 1.0})
    plan = blocking.block_keys(a, DedupeConfig(address_only=True), fuzzy=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 2


@pytest.mark.parametrize("name", ["q_address_status", "q_phone_revision", "q_soft_tfidf", "q_exact_dupes"])
def test_pairs_normalize_no_text(spark, name):
    """What pairs compare is worked out once per record: above the join of the pairs, no text is taken apart."""
    from placeweave.plans.catalogue import QUERIES

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # Phones are read pair by pair, since the calling code may come from the other side.
    assert not re.search(r"translate\(" if name == "q_phone_revision" else r"regexp_\w+\(|translate\(", plan[: plan.index("Join")])
    assert plan.count("translate(") <= 16


def test_an_address_is_judged_once(spark):
    a = recs(spark, *[{"uid": i, "road": r, "house_number": "1"} for i, r in enumerate(["Long Harbor Rd", "Long Harbour Road", "Oak St"])])
    judged = pipelines.judged_addresses(spark.createDataFrame([(1, 0), (2, 0)], "uid1 long, uid2 long"), a, DedupeConfig(address_only=True))
    assert [tuple(r) for r in judged.collect()] == [(1, 0, 2, 0.9)]
    # Once to keep the pair and once for its status.
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(") <= 2


def test_keys_by_city_postcode_and_nothing(spark):
    a = recs(spark, dict(uid=1, house_number="1", road="A St", city="X", postcode="94109-1234"), dict(uid=2, house_number="1", road="A Street", suburb="x", postcode="94109"), dict(uid=3))
    assert blocking.candidate_pairs(a, DedupeConfig(address_only=True, use_city=True)).count() == 1
    assert blocking.candidate_pairs(a, DedupeConfig(address_only=True, use_postal_code=True, use_zip5=True)).count() == 1
    assert blocking.candidate_pairs(a, DedupeConfig(address_only=True)).count() == 0


def test_names_at_one_address_meet_whatever_their_words(spark):
    at = dict(house_number="1", **BLOCK)
    a = recs(spark, dict(uid=1, house="Public Library Branch of Elmfield", **at), dict(uid=2, house="Elmfield Public Library Branch", **at), dict(uid=3, house="Pubilc Library Branch of Elmfield", **at), dict(uid=4, **at))
    assert {tuple(r) for r in blocking.candidate_pairs(a, DedupeConfig()).collect()} == {(2, 1), (3, 1), (3, 2)}


def test_the_whole_way_runs_with_the_default_options(monkeypatch):
    from placeweave.plans import catalogue

    monkeypatch.setattr(catalogue, "_features", lambda spark, d: None)
    monkeypatch.setattr(catalogue, "with_guid", lambda features: features)
    monkeypatch.setattr(pipelines, "resolve", lambda features, config: config)
    assert catalogue.QUERIES["q_resolve"](None, "") == DedupeConfig()


def test_linkage_and_geocoding(spark):
    base = dict(house_number="5", road="Elm Rd", postcode="90001")
    a = recs(spark, dict(uid=1, lat=10.0, lon=20.0, **base), dict(uid=2, lat=10.0, lon=20.0, **base), dict(uid=7, **base), dict(uid=8, **{**base, "house_number": "6"}))
    assert [tuple(r)[:2] for r in pipelines.geocode(a, DedupeConfig(address_only=True)).collect()] == [(7, 1)]
    linked = pipelines.match(a.filter("uid < 3"), a.filter("uid > 2"), DedupeConfig(address_only=True, use_postal_code=True))
    assert {tuple(r)[:2] for r in linked.collect()} == {(7, 1), (7, 2)}


def test_names_and_addresses_end_to_end(spark, tmp_path):
    def feature(name, phone, lon=20.0, **extra):
        return json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [lon, 10.0]}, "properties": {"name": name, "addr:street": "Main St", "addr:housenumber": "1", "phone": phone, **extra}})

    lines = [feature("Blue Harbor Cafe", "555-220-8828"), feature("Blue Harbor Cafe Inc", "555-220-8828"), feature("Zebra Tools", None), feature("Blue Harbour Cafe", None, city="X"), "", "[1]", "no json"]
    lined = tmp_path / "in.geojsonl"
    lined.write_text("\n".join(lines))
    whole = tmp_path / "in.geojson"
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": [json.loads(lines[0])]}))
    read = geojson.read_lines(spark, str(lined))
    assert read.count() == 4 and read.first()["raw"] == lines[0]
    assert geojson.read_any(spark, [str(lined), str(whole)]).count() == 5
    features = geojson.with_guid(geojson.with_uid(read))
    assert [r["guid"] for r in features.orderBy("uid").collect()] == [r["guid"] for r in features.orderBy("uid").collect()]
    out = pipelines.resolve(features, DedupeConfig(min_tile_docs=2))
    got = [json.loads(r["response"]) for r in out.orderBy("uid").collect()]
    assert [x["is_dupe"] for x in got] == [False, True, False, True] or [x["is_dupe"] for x in got] == [False, True, False, False]
    assert got[1]["same_as"][0]["is_canonical"] and got[1]["same_as"][0]["classification"] == "likely_dupe" and "same_as" not in got[0]
    geojson.write_json_lines(out, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4
    only = pipelines.resolve(features, DedupeConfig(address_only=True, dupes_only=True))
    assert only.count() == 3


def test_canonicals_and_best_match(spark):
    p = spark.createDataFrame([(2, 1, 3, 1.0), (3, 2, 2, 0.9), (5, 4, 1, 0.7), (3, 1, 2, 0.9)], "uid1 long, uid2 long, status int, sim double")
    assert {r[0] for r in responses.dupes(p).collect()} == {2, 3} and {r[0] for r in responses.canonicals(p).collect()} == {1, 4}
    assert {tuple(r) for r in responses.best_match(p).collect()} == {(2, 3, 1.0, 1), (3, 2, 0.9, 1), (5, 1, 0.7, 4)}
    flat = {(r["uid1"], r["uid2"]): (r["classification"], r["is_canonical"]) for r in responses.response_lists(p).collect()}
    assert flat[3, 2] == ("likely_dupe", False) and flat[5, 4] == ("needs_review", True)


def test_aliases(spark):
    rows = [(1, ("Point", [181.0, 10.0]), {"city": "A", "addr:city": "B", "wof:name": "W", "zip": "1"}), (2, None, None), (3, ("Point", [1.0]), {"name": "N", "wof:name": "W"})]
    df = spark.createDataFrame(rows, "uid long, geometry struct<type:string,coordinates:array<double>>, properties map<string,string>")
    got = {r["uid"]: r for r in records(df).collect()}
    assert (got[1]["city"], got[1]["house"], got[1]["postcode"], got[1]["lon"]) == ("A", "W", "1", -179.0)
    assert got[2]["house"] is None and got[3]["house"] == "N" and got[3]["lat"] is None
    assert len(ALIASES) == 19 and sum(map(len, ALIASES.values())) == 99
    assert records(df).select("uid", labels_and_values(records(df)).alias("m")).filter("uid = 3").first()["m"] == {"house": "N"}
    assert with_languages(records(df)).first()["languages"] == ["en"]
    assert spark.range(1).select(missing_on_one_side(F.lit(" "), F.lit("x")), missing_on_one_side(F.lit(""), F.lit(None).cast("string"))).first()[:] == (True, False)


def test_latest_delivery(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, None, 2), (2, None, None), (None, "x", 1)], "uid long, v string, loaded_at int")
    assert {tuple(r) for r in latest_delivery(df, "uid", {"v": F.col("v")}).collect()} == {(1, "b"), (2, None)}


def test_indexes_on_disk(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "uid long, tokens array<string>")
    df, n = wi.doc_frequency(docs), docs.filter(F.size("tokens") > 0).agg(F.count("*").alias("n"))
    index_io.save_tfidf(df, n, str(tmp_path / "t"))
    words, total = index_io.load_tfidf(spark, [str(tmp_path / "t"), str(tmp_path / "t")])
    assert {tuple(r) for r in words.collect()} == {(w, 2 * c) for w, c in map(tuple, df.collect())} and total.first()[0] == 6
    assert json.loads(index_io.tfidf_json(df, n).first()[0])["N"] == 3
    gains = wi.info_gain(docs)
    index_io.save_info_gain(gains, str(tmp_path / "g"))
    assert {r[0]: r[1] for r in index_io.load_info_gain(spark, str(tmp_path / "g")).collect()} == {r[0]: r[1] for r in gains.collect()}
    index_io.save_by_tile(gains.withColumn("geo", F.lit(1)), str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 4


def test_incremental_index_counts_a_repeated_batch_once(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "uid long, tokens array<string>")
    update = frequency_updater(str(tmp_path))
    for k, part in ((0, "uid < 3"), (1, "uid >= 3"), (1, "uid >= 3")):
        update(docs.filter(part), k)
    words, n = current_frequencies(spark, str(tmp_path))
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, wi.doc_frequency(docs).collect())) and n.first()[0] == 3


def test_options():
    config, files, out = DedupeConfig.from_args(["a", "b", "-o", "out", "--address-only", "--no-latlon", "--use-city", "--index-type", "tfidf", "--name-dupe-threshold", "0.8"])
    assert files == ["a", "b"] and out == "out" and config.address_only and not config.use_latlon and config.use_city and config.index_type == "tfidf" and config.name_dupe_threshold == 0.8
    assert config.block_precision == 7 and DedupeConfig().block_precision == 6


def test_scratch_is_the_shared_folder(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir", scratch_dir(spark))


def test_collections_with_a_feature_on_each_line_and_ordinates_as_text(spark, tmp_path):
    def feature(name, *at):
        return json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": list(at)}, "properties": {"name": name}}, ensure_ascii=False)

    rows = [feature("a", "74°00′21″W", "40°42′46″N"), feature("b", 7.5, 45.25)]
    (tmp_path / "rows.geojson").write_text('{\n"type": "FeatureCollection",\n"name": "x",\n"features": [\n' + ",\n".join(rows) + "\n]\n}\n")
    (tmp_path / "pretty.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [json.loads(r) for r in rows]}, indent=1))
    (tmp_path / "one.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [json.loads(r) for r in rows]}))
    (tmp_path / "lines.geojsonl").write_text("\n".join(rows))
    paths = [str(p) for p in sorted(tmp_path.iterdir())]
    forms = {r["path"].rsplit("/")[-1]: r["form"] for r in geojson.file_forms(spark, paths).collect()}
    assert forms == {"rows.geojson": "rows", "pretty.geojson": "whole", "one.geojson": "whole", "lines.geojsonl": "lines"}
    got = [(r["properties"]["name"], *r["geometry"]["coordinates"]) for r in geojson.read_any(spark, paths).collect()]
    want = [("a", pytest.approx(-74.005833, abs=1e-5), pytest.approx(40.712777, abs=1e-5)), ("b", 7.5, 45.25)]
    assert len(got) == 8 and all(sum(g == w for g in got) == 4 for w in want)
    assert all(r["raw"] in rows for r in geojson.read_any(spark, [str(tmp_path / "rows.geojson")]).collect())


def test_the_job_runs_from_its_arguments(spark, tmp_path):
    from placeweave import job

    at = {"type": "Point", "coordinates": [7.5, 45.25]}
    lines = [json.dumps({"type": "Feature", "geometry": at, "properties": {"name": "Zubeka Bakery", "addr:street": s, "addr:housenumber": "5"}}) for s in ("Marigold Hillside", "Marigold Hilside", "Oak Road")]
    (tmp_path / "in.geojsonl").write_text("\n".join(lines))
    job.run(spark, [str(tmp_path / "in.geojsonl"), "-o", str(tmp_path / "out"), "--address-only"])
    out = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(out) == 3 and sum(o["is_dupe"] for o in out) == 1
