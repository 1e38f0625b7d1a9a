import itertools
import random
import re

import numpy as np
import pytest

from placeweave.llm import names as names_
from placeweave.llm import ngrams
from placeweave.llm.addresses import Slips, match_addresses, read_city, read_postcode, read_street
from placeweave.llm.linkage import average_linkage
from placeweave.llm.names import _agreeing, edits, index_entries, match_names, read_name, words_agree
from placeweave.llm.ngrams import settled, similar, spread
from placeweave.session import materialize
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "street, number, want",
    [
        ("Obsidian Fountain Court, So.", "739", ("739", "obsidianfountain", "court", "south")),
        ("sunny woodland terrace 4", None, ("4", "sunnywoodland", "terrace", "")),
        ("33A 9th Avenue", None, ("33a", "9", "avenue", "")),
        ("Ninth Ave Apt 12", "33 a", ("33a", "9", "avenue", "")),
        ("10 STR", "63", ("63", "10", "street", "")),
        ("10 STR", None, None),
        ("N. Marble Pier 847C", None, ("847c", "marblepier", "", "north")),
        ("No. Chestnut Abbey Place, Suite 2", "No. 502", ("502", "chestnutabbey", "place", "north")),
        ("Barrel Valley", "270", ("270", "barrelvalley", "", "")),
        ("Schmiedefurtstraße", "744", ("744", "schmiedefurt", "street", "")),
        ("Burgmark-Str.", "27", ("27", "burgmark", "street", "")),
        ("St. Bede Road", "5.", ("5", "saintbede", "road", "")),
        ("Prairie Tollgate Prakway", "#12", ("12", "prairietollgate", "parkway", "")),
        ("North Street", "1", ("1", "north", "street", "")),
        ("", "1", None), (None, None, None), ("Main St", "none", None), ("x" * 100000, "7", ("7", "x" * 100000, "", "")),
    ],
)
def test_read_street(street, number, want):
    assert read_street(street, number) == want


ADDRESS = "uid long, street string, number string, city string, postcode string"


def test_addresses_are_matched(spark):
    common = [(1000 + i, "Tulip Cliffside Road", str(i + 500), "Kestrel Bay", "90003") for i in range(40)]
    rows = [
        (1, "Tulip Cliffside Road", "12", "Kestrel Bay", "90003"), (2, "tuilp cliffside rd.", "No. 12", "KESTERL BAY", None), (3, "12 Tulip Cliffside Rd", None, None, "90003"), (4, "Tulip Cliffside", "12", "Kestrel Bay", None),
        (5, "Tulip Cliffside Ave", "12", "Kestrel Bay", None), (6, "N Tulip Cliffside Road", "12", "Kestrel Bay", None), (7, "Tulip Cliffside Road", "12a", "Kestrel Bay", None), (8, "Tulip Cliffside Road", "12", "Port Almond", None),
        (9, "Tulip Cliffside Road", "12", None, None), (10, None, "12", "Kestrel Bay", None), (11, "", "", "", ""), (None, "Tulip Cliffside Road", "12", "Kestrel Bay", None),
        (20, "Zyxwvut Lane", "3", "Quillhaven", None), (21, "Zyxwut Ln", "3", "Quillhaven", None),
    ]
    df = spark.createDataFrame(rows + common, ADDRESS).withColumns({"id": F.lit(1), "town": F.lit("t"), "name": F.lit("n"), "gram": F.lit("g")})
    got = {tuple(r) for r in match_addresses(df).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (4, 5), (20, 21)}
    assert match_addresses(df.limit(0)).collect() == []


def test_spellings_of_streets_are_compared_whatever_their_counts(spark):
    # Ten rows of the right spelling and two of its slip: too many to be rare, too few to be established.
    rows = [(i, "Walford Road", str(i), "Kestrel Bay", None) for i in range(1, 11)] + [(20, "Walfrod Road", "1", "Kestrel Bay", None), (21, "Wlaford Rd", "1", "Kestrel Bay", None), (22, "Walfrod Road", "2", "Kestrel Bay", None)]
    # Two streets of one town, both well attested.
    rows += [(100 + 20 * j + i, f"{n} Road", str(i), "Port Almond", None) for j, n in enumerate(("Millerton", "Hillerton")) for i in range(1, 13)]
    got = {tuple(r) for r in match_addresses(spark.createDataFrame(rows, ADDRESS)).collect()}
    assert got == {(1, 20), (1, 21), (20, 21), (2, 22)}


def test_well_attested_streets_and_towns_stay(spark):
    rows = [(i, "Hill Road", str(i), "Port Almond", None) for i in range(1, 501)] + [(600 + i, "Mill Road", str(i), "Port Almond", None) for i in range(1, 21)]
    rows += [(1000 + i, "Oak Road", str(i), "Clayton", "90001") for i in range(1, 41)] + [(1100 + i, "Oak Road", str(i), "Layton", "80001") for i in range(1, 4)]
    rows += [(1200, "Oak Road", "7", "Clatyon", "90001"), (1201, "Oak Road", "8", "Clatyon", None)]
    got = {tuple(r) for r in match_addresses(spark.createDataFrame(rows, ADDRESS)).collect()}
    assert got == {(1007, 1200), (1008, 1201)}


def test_cities_and_postcodes():
    assert [read_city(c) for c in ("St. Orvin", "  SAINT   orvin ", "N Brindle", "Grünebach", "St", "", None)] == ["saint orvin", "saint orvin", "north brindle", "grunebach", "st", "", ""]
    assert [read_postcode(c) for c in (" 90403-1234 ", "zk9 4jv", "-", None)] == ["90403", "ZK94JV", "", ""]


def test_slips_are_single_edits():
    known = {"boulevard", "parkway", "terrace", "avenue"}
    find = Slips(known)
    for k in known:
        for i in range(len(k)):
            for w in (k[:i] + k[i + 1 :], k[:i] + "z" + k[i:], k[:i] + "z" + k[i + 1 :], k[:i] + k[i : i + 2][::-1] + k[i + 2 :]):
                assert find(w) == k, w
    assert find("boulebarz") is None and find("abc") is None


def test_edits_equal_the_plain_recursion():
    rng = random.Random(1)

    def plain(a, b):
        if not a or not b:
            return len(a) + len(b)
        d = min(plain(a[1:], b) + 1, plain(a, b[1:]) + 1, plain(a[1:], b[1:]) + (a[0] != b[0]))
        return min(d, plain(a[2:], b[2:]) + 1) if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0] else d

    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in "ab")
        assert edits(a, b, 9) == plain(a, b)
        assert edits(a, b, 1) == min(plain(a, b), 2)


def test_spellings_settle_on_the_most_frequent_like_them(spark):
    vocabulary = [("kestrel bay", 500), ("ketsrel bay", 3), ("kestrel bya", 1), ("port almond", 300), ("mill", 20), ("hill", 500), ("", 9), (None, 9)]
    # Frequent slips are slips all the same, and steps are followed to their end.
    vocabulary += [("maplecrest", 40), ("maplecrset", 9), ("thistlebrook", 50), ("thistlebroook", 30), ("thistlebroooks", 10)]
    df = spark.createDataFrame([("a", *x) for x in vocabulary] + [("b", "maplecrset", 5)], "block string, text string, n long")
    got = {(r["block"], r["text"]): r["to"] for r in settled(similar(df, 0.6)).collect()}
    assert got == {("a", "ketsrel bay"): "kestrel bay", ("a", "kestrel bya"): "kestrel bay", ("a", "maplecrset"): "maplecrest", ("a", "thistlebroook"): "thistlebrook", ("a", "thistlebroooks"): "thistlebrook"}
    assert settled(similar(df.limit(0), 0.6)).collect() == []


def test_spellings_one_edit_apart_share_an_entry():
    rng = random.Random(2)
    for _ in range(3000):
        w = "".join(rng.choice("abcł") for _ in range(rng.choice([4, 5, 7, 8, 9, 15, 16, 17, 18, 40])))
        i, j, c = rng.randrange(len(w)), rng.randrange(len(w)), rng.choice("abł")
        swapped = list(w)
        swapped[i], swapped[j] = swapped[j], swapped[i]
        for v in (w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], "".join(swapped)):
            for size in (3, 8) if len(v) >= 4 else ():
                rows, entries = ngrams._entries([w, v], np.array([size, size]), 1)
                assert set(entries[rows == 0].tolist()) & set(entries[rows == 1].tolist()), (w, v)
    # No more than a letter left out of each place, the whole and its letters in order: few meet by chance, and none under four letters.
    assert len(ngrams._entries(["maple", "elm"], np.array([3, 3]), 1)[0]) == 5 + 1 + 1
    assert len(ngrams._entries(["maple" * 2000], np.array([3]), 1)[0]) < 10


def test_other_letters_are_spellings_too(spark):
    df = spark.createDataFrame([("t", "krakowska", 9), ("t", "krakołska", 1), ("t", "krakwska", 1)], "block string, text string, n long")
    assert {(r["text"], r["to"]) for r in settled(similar(df, 0.4)).collect()} == {("krakołska", "krakowska"), ("krakwska", "krakowska")}


def test_index_and_vectors_are_not_broadcast_by_the_size_of_the_vocabulary(spark):
    df = materialize(spark.createDataFrame([("a", "obsidianfountain", 3), ("a", "obsidianfuontain", 1)], "block string, text string, n long"), "few-spellings")
    found = similar(df, 0.6)
    assert "BroadcastExchange" in spread(df, "text").join(df, "text")._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) \[(\w+)#", found._jdf.queryExecution().executedPlan().toString())
    assert {k: j for j, k in joins if k in ("entry", "a_text", "b_text")} == dict.fromkeys(("entry", "a_text", "b_text"), "SortMergeJoin")
    assert [tuple(r)[:3] for r in found.collect()] == [("a", "obsidianfuontain", "obsidianfountain")]


def test_a_frequent_slip_at_one_address_loses_no_pair(spark):
    rows = [(i, "Maplecrest Street" if i < 40 else "Maplecrset Street", "7", "Kestrel Bay", None) for i in range(49)]
    assert match_addresses(spark.createDataFrame(rows, "uid long, street string, number string, city string, postcode string")).count() == 49 * 48 // 2


def test_read_name():
    assert read_name("The Lofokelpa National Dental Clinic Inc") == ("lofokelpa", "clinic dental", "", "")
    assert read_name("Lofokelpa Dentalclinic - Saint Orvin") == ("lofokelpa", "clinic dental", "", "")
    assert read_name("VUNELWILA, Ed R. DDS") == ("vunelwila", "person", "edward", "r")
    assert read_name("Zubeka Fitness Ctr (Store 150)") == ("zubeka", "center fitness", "", "")
    assert read_name("Ruvikelfor's Dry Cleaners") == ("ruvikelfor", "cleaners dry", "", "")
    assert [read_name(x) for x in ("n/a", "", None, "???", "No Name Given")] == [None] * 5
    assert read_name("Main Library") == ("main", "library", "", "") and read_name("Library")[0] == "library"
    assert read_name("word " * 50000)[0] == "word"


def test_parts_of_names_agree():
    assert words_agree("tulip quartz", "quartz tulip".replace("quartz tulip", "tulip quartz")) and words_agree("vunelwila", "vunulwila") and not words_agree("bokusepe", "zanporlepa")


def test_kinds_and_first_names_agree(spark):
    cases = [(("", "", ""), ("bakery", "", ""), True), (("clinic dental", "", ""), ("dental", "", ""), True), (("architects", "", ""), ("restaurant", "", ""), False), (("", "edward", ""), ("", "", "e"), True), (("", "", ""), ("", "james", ""), True), (("", "edward", ""), ("", "james", ""), False), (("", "", "er"), ("", "edward", ""), True)]
    schema = ", ".join(f"{s}_{c} string" for s in "ab" for c in ("kinds", "first", "initials"))
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b, _) in enumerate(cases)], "i int, " + schema)
    assert [r[0] for r in df.orderBy("i").select(_agreeing()).collect()] == [c[2] for c in cases]


NAMES = "uid long, name string, `wof:name` string, street string, number string, city string, postcode string"


def test_names_are_matched(spark):
    at = ("Main Road", "5", "Kestrel Bay", "90003")
    rows = [
        (1, "Dr. Edward R. Vunelwila", None, *at), (2, None, "vunelwial, ed dds", *at), (3, "Vunelwila James", None, *at), (4, "Toparewo Royal Architects", None, *at), (5, "Toparewo Royal Restaurant", None, *at), (6, "Toparewo Restnt", None, *at),
        (7, "Restaurant Toparewo", "x", None, None, "KESTREL BAY", None), (8, "Toparewo Restaurant", None, "Oak Road", "9", "Kestrel Bay", "90003"), (9, "n/a", "unknown", *at), (10, None, None, *at), (11, "Toparewo Restaurant", None, None, None, None, None),
        (12, "", "", "", "", "", ""), (None, "Toparewo Restaurant", None, *at),
    ]
    chain = [(100 + i, "Zubeka Fitness Center", None, "Elm Road", str(i + 1), "Kestrel Bay", "90003") for i in range(4)] + [(200, "Zubeka Fitness Ctr", None, "Elm Rd", "1", "Kestrel Bay", None), (201, "Zubeka Fitness Center", None, None, None, "Kestrel Bay", "90003")]
    df = spark.createDataFrame(rows + chain, NAMES).withColumns({"id": F.lit(1), "node": F.lit(2), "brand": F.lit("b"), "place": F.lit("p")})
    got = {tuple(r) for r in match_names(df).collect()}
    assert {(1, 2), (5, 6), (100, 200)} <= got
    # Two venues of that name are in town, which is no chain yet: the record without address may go with either.
    assert {p for p in got if 7 in p} and {p for p in got if 7 in p} <= {(5, 7), (6, 7), (7, 8)}
    assert not got & {(1, 3), (2, 3), (4, 5), (4, 6), (5, 8), (6, 8)} and not {u for p in got for u in p} & {3, 4, 9, 10, 11, 12, 201}
    assert match_names(df.limit(0)).collect() == []


def test_names_of_chains_without_an_address(spark):
    # Four outlets, two of them in one postcode: those without address meet each other, and the one outlet of their postcode.
    outlets = [(i, "Zubeka Fitness Center", None, "Elm Road", str(i), "Kestrel Bay", code) for i, code in ((1, "90001"), (2, "90002"), (3, "90003"), (4, "90003"))]
    lost = [(10 + i, "Zubeka Fitness Ctr", None, None, None, "Kestrel Bay", code) for i, code in enumerate((None, None, "90001", "90003", "90003", "90002"))]
    people = [(20 + i, f"{first} Vunelwila", None, "Oak Road", str(i + 1), "Kestrel Bay", None) for i, first in enumerate(("Edward", "James", "Susan"))]
    shops = [(30 + i, f"Fororsorve {kind}", None, "Main Road", str(i + 1), "Kestrel Bay", None) for i, kind in enumerate(("Day Spa", "Hair Salon", "Bakery"))]
    alone = [(40, "Ed Vunelwila", None, None, None, "Kestrel Bay", None), (41, "Fororsorve Hair Salon", None, None, None, "Kestrel Bay", None)]
    got = {tuple(r) for r in match_names(spark.createDataFrame(outlets + lost + people + shops + alone, NAMES)).collect()}
    assert {(10, 11), (1, 12), (13, 14), (2, 15), (20, 40), (31, 41)} <= got
    assert not got & {(1, 10), (2, 10), (3, 10), (1, 11), (3, 13), (4, 13), (3, 14), (2, 12), (1, 15), (12, 13), (12, 15), (21, 40), (22, 40), (30, 41), (32, 41)}


def test_brands_that_agree_meet_in_the_index():
    rng = random.Random(3)

    def slip(w):
        i, c = rng.randrange(len(w)), rng.choice("abk")
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])

    agreed = 0
    for _ in range(4000):
        words = ["".join(rng.choice("abdeklo") for _ in range(rng.choice([1, 3, 4, 6, 7, 8, 9, 14]))) for _ in range(rng.randrange(1, 4))]
        other = [slip(slip(w) or w) if rng.random() < 0.5 else slip(w) if rng.random() < 0.5 else w for w in words]
        other = rng.choice([other, other[1:] or other, ["".join(other)]])
        a, b = " ".join(words), " ".join(w for w in other if w) or "x"
        if words_agree(a, b):
            agreed += 1
            for size in (3, 5, 8, 11):
                (look_a, found_a), (look_b, found_b) = ([set(index_entries([x], np.array([size]), f)[1].tolist()) for f in (False, True)] for x in (a, b))
                assert look_a & (look_b | found_b) or look_b & found_a, (a, b, size)
    assert agreed > 1000


def test_brands_stand_once_where_others_look():
    entries = lambda brand, found: index_entries([brand], np.array([8]), found)[1].tolist()
    stands = entries("vetorsuro hollow", True)
    assert len(stands) == 28 + 28 + 6 + 1  # both words together in one order, either alone, and glued
    for other in ("hollw vetorsuro", "vetorsuro hollow inn", "vetorsurohollow"):
        assert set(entries(other, False)) & set(stands) or set(entries("vetorsuro hollow", False)) & set(entries(other, True))


@pytest.mark.parametrize("few", [1, 16])
def test_few_brands_are_paired_as_the_index_pairs_them(spark, monkeypatch, few):
    monkeypatch.setattr(names_, "FEW", few)
    names = ["Zubeka Bakery", "Zupeka Bakery", "Bluesky Cafe", "Blue Sky Cafe", "Tulip Quartz Clinic", "Tulop Quarts Clinic", "Hollow Knoll Spa", "Knol Hollw Spa", "Vetorsuro Hollow Bank", "Vetorsuro Bank"]
    rows = [(i, n, None, "Main Road", "5", "Kestrel Bay", None) for i, n in enumerate(names)] + [(20, "Zubeka Bakery", None, None, None, "Kestrel Bay", None)]
    assert {tuple(r) for r in match_names(spark.createDataFrame(rows, NAMES)).collect()} == {(0, 1), (0, 20), (1, 20), (2, 3), (4, 5), (6, 7), (8, 9)}


@pytest.mark.parametrize("most", [1, 100_000])
def test_large_blocks_are_joined_as_others_are_searched(spark, monkeypatch, most):
    monkeypatch.setattr(names_, "FEW", 1)
    monkeypatch.setattr(names_, "MOST", most)
    names = ["Zubeka Bakery", "Zupeka Bakery", "Bluesky Cafe", "Blue Sky Cafe", "Tulip Quartz Clinic", "Tulop Quarts Clinic", "Vetorsuro Hollow Bank", "Vetorsuro Bank"]
    rows = [(i, n, None, *at, "Kestrel Bay", None) for i, (n, at) in enumerate(zip(names, [(None, None), ("Main Road", "5")] * 4))]
    assert {tuple(r) for r in match_names(spark.createDataFrame(rows, NAMES)).collect()} == {(0, 1), (2, 3), (4, 5), (6, 7)}


@pytest.mark.parametrize("together", [1, 1_000_000])
def test_pairs_met_in_blocks_equal_those_of_shared_entries(monkeypatch, together):
    monkeypatch.setattr(names_, "MEETINGS", together)
    rng = random.Random(11)
    words = ["".join(rng.choice("abdeklo") for _ in range(rng.choice([3, 4, 6, 8, 9, 14]))) for _ in range(10)]
    brands = [" ".join(sorted({w if rng.random() < 0.6 else w[1:] for w in rng.sample(words, rng.choice([1, 1, 2, 3]))})) for _ in range(60)]
    block = np.sort(np.array([rng.choice([5, -7, 2**62]) for _ in brands]))
    asks, size = np.array([rng.random() < 0.4 for _ in brands]) | (block == 5), np.full(len(brands), 5)
    look, found = ([set(index_entries([b], size[:1], f)[1].tolist()) for b in brands] for f in (False, True))
    several, three = [" " in b for b in brands], {block[i] for i, b in enumerate(brands) if asks[i] and b.count(" ") > 1}
    want = set()
    for i, j in itertools.permutations(range(len(brands)), 2):
        either = several[i] and not asks[j] and (not several[j] or block[j] in three) and found[i] & look[j]
        if block[i] == block[j] and asks[i] and (either or look[i] & (found[j] if several[j] else look[j])):
            want.add((min(i, j), max(i, j)) if asks[j] else (i, j))
    got = [(int(a), int(b)) for x, y in names_.meetings(brands, block, asks, size) for a, b in zip(x, y)]
    assert want and set(got) == want
    assert not list(names_.meetings(["zubeka"], np.array([1]), np.array([True]), np.array([3])))[0][0].size


def test_brands_of_a_block_lie_together_whatever_was_joined_before(spark):
    schema, n = "block long, brand string, at long, asks boolean", 400
    rows = [(i % 3, f"zubeka{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}", i, True) for i in range(n)]
    sizes = spark.createDataFrame([(b, 5) for b in range(3)], "block long, size long")
    brands = spark.createDataFrame(rows, schema).repartition(7, "at").join(sizes.hint("merge"), "block")
    got = {(r["a_at"], r["b_at"]) for r in names_._met(brands).collect()}
    # All share their first letters, so all of a block meet; entries never leave the task that made them.
    assert {(min(p), max(p)) for p in got} == {(i, j) for i in range(n) for j in range(i + 1, n) if (j - i) % 3 == 0}
    assert "entry" not in names_._met(brands)._jdf.queryExecution().toString()


def test_words_compared_together_agree_as_one_by_one():
    rng = random.Random(5)
    brands = [" ".join("".join(rng.choice("abä") for _ in range(rng.choice([1, 3, 5, 8, 12, 16, 17, 30]))) for _ in range(rng.choice([1, 1, 2, 3, 9]))) for _ in range(400)]
    others = [b[: (i := rng.randrange(len(b)))] + rng.choice(["", "a", "ab"]) + b[i + rng.randrange(3) :] for b in brands]
    others = [" ".join(o.split()) or "a" for o in others]
    assert names_.agreeing(brands, others) == [words_agree(a, b) for a, b in zip(brands, others)]
    pairs = [(v, w) for a, b in zip(brands, others) for v, w in zip(a.split(" "), b.split(" "))]
    assert names_.many_edits(pairs) == [edits(v, w, 3) for v, w in pairs] and names_.many_edits([]) == []


def test_slips_without_an_address_are_found(spark):
    names = [("Zubeka Bakery", "Zupeka Bakery"), ("Bluesky Cafe", "Blue Sky Cafe"), ("Tulip Quartz Clinic", "Tulop Quarts Clinic"), ("Vetorsuro Hollow Bank", "Vetorsuro Bank"), ("Hollow Knoll Spa", "Hollw Knol Spa")]
    rows = [(10 * i + j, n, None, *(("Main Road", str(i + 1)) if j else (None, None)), "Kestrel Bay", None) for i, pair in enumerate(names) for j, n in enumerate(pair)]
    got = {tuple(r) for r in match_names(spark.createDataFrame(rows, NAMES)).collect()}
    assert got == {(10 * i, 10 * i + 1) for i in range(len(names))}


def test_a_crowded_address_loses_nothing(spark):
    rng = random.Random(8)
    syllables = ["ba", "den", "fo", "gu", "hel", "ka", "lor", "mi", "nu", "pe", "ran", "so", "tel", "vu", "zor"]
    rows = []
    for i in range(60):
        word = "".join(rng.choice(syllables) for _ in range(4))
        at = rng.randrange(1, len(word) - 1)
        for j, w in enumerate((word, word[:at] + word[at + 1] + word[at] + word[at + 2 :], word)):
            rows.append((10 * i + j, f"{w.title()} Bakery" + (" Inc" if j else ""), None, "Main Road", "5", "Kestrel Bay", None))
    df = spark.createDataFrame(rows, NAMES)
    assert sum(a // 10 == b // 10 for a, b in map(tuple, match_names(df).collect())) == 180


def test_two_swaps_are_found(spark):
    at = ("Main Road", "5", "Kestrel Bay", None)
    rows = [(1, "Hawthorne Pharmacy", None, None, None, "Kestrel Bay", None), (2, "Hwathonre Pharmacy", None, *at)]
    assert [tuple(r) for r in match_names(spark.createDataFrame(rows, NAMES)).collect()] == [(1, 2)]


def reference_linkage(links, threshold):
    """One pair at a time, by the average similarity of members; of equal ones the lowest ids."""
    sim = {frozenset(x[:2]): x[2] for x in links}
    clusters = [frozenset([n]) for n in sorted({n for a, b, _ in links for n in (a, b)})]
    while True:
        best = None
        for x, y in itertools.combinations(clusters, 2):
            s = sum(sim.get(frozenset((i, j)), 0.0) for i in x for j in y) / (len(x) * len(y))
            if s >= threshold and (best is None or (s, -min(min(x), min(y)), -max(min(x), min(y))) > best[0]):
                best = ((s, -min(min(x), min(y)), -max(min(x), min(y))), x, y)
        if best is None:
            return {c for c in clusters if len(c) > 1}
        clusters = [c for c in clusters if c not in best[1:]] + [best[1] | best[2]]


@pytest.mark.parametrize("seed", range(4))
def test_average_linkage_equals_merging_one_by_one(spark, seed):
    rng = random.Random(seed)
    links = [(a, b, rng.randrange(1, 1025) / 1024 if seed % 2 else rng.choice([0.25, 0.5, 1.0])) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.35]
    got = {}
    for r in average_linkage(spark.createDataFrame(links, "a long, b long, sim double"), 0.3).collect():
        got.setdefault(r["cluster"], set()).add(r["node"])
    assert {frozenset(c) for c in got.values()} == reference_linkage(links, 0.3)


def test_average_linkage_of_little(spark):
    schema = "a long, b long, sim double"
    assert average_linkage(spark.createDataFrame([], schema), 0.5).collect() == []
    rows = [(1, 1, 1.0), (2, None, 1.0), (4, 3, 0.9), (3, 4, 0.1), (5, 6, None), (7, 8, 0.2)]
    assert sorted(map(tuple, average_linkage(spark.createDataFrame(rows, schema), 0.5).collect())) == [(3, 3), (4, 3)]
