import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeweave.llm import mixing, subjects, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.DEFAULT_RANKS), reason="no vocabulary files")


@pytest.fixture(scope="module")
def bpe():
    with open(tokenizer.DEFAULT_RANKS, "rb") as f:
        return tokenizer.Bpe(f.read())


@pytest.fixture(scope="module")
def public(bpe):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_public_library(bpe, public, text):
    ids = bpe.encode(text)
    assert ids == public.encode_ordinary(text) and bpe.decode(ids) == text


@pytest.mark.parametrize("letters", ["a", "ab", "the", "aeiou", "abcdefghijklmnopqrstuvwxyz", "0123456789", "-=_", "ß漢é", " ", " \n", "ACGT"])
def test_long_pieces_are_streamed_exactly(bpe, public, letters):
    rng = random.Random(letters)
    text = "".join(rng.choice(letters) for _ in range(30_000))
    assert bpe.encode(text) == public.encode_ordinary(text)


def test_a_stream_in_small_chunks_holds_little(bpe, public):
    rng = random.Random(2)
    text = "".join(rng.choice("thein") for _ in range(60_000))
    raw = text.encode()
    assert list(bpe.stream(raw[i : i + 7] for i in range(0, len(raw), 7))) == public.encode_ordinary(text)
    assert 100 < bpe.lookahead() < 5000


def test_decoding_in_steps(bpe):
    text = "naïve 漢字 🙂"
    parts = list(bpe.decode_stream(bpe.encode(text)))
    assert "".join(parts) == text
    assert bpe.decode([bpe.ranks[b"\xf0"]]) == "�"


def test_encode_and_decode_tables(spark, public):
    rows = [(1, "Hello <|endoftext|> world"), (2, None), (3, ""), (4, "  \t\n"), (5, "x" * 200_000), (None, "a"), (1, "Hello <|endoftext|> world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = tokenizer.encode(df)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((k, public.encode_ordinary(t or ""))) for k, t in rows)
    back = sorted(repr(tuple(r)) for r in tokenizer.decode(got).collect())
    assert back == sorted(repr((k, t or "")) for k, t in rows)
    assert tokenizer.encode(df.limit(0)).collect() == []
    counts = tokenizer.token_counts(df.withColumn("source", F.lit("s")), keep=("source",))
    assert sorted(r["n_tokens"] for r in counts.collect()) == sorted(len(public.encode_ordinary(t or "")) for _, t in rows)


def test_mix_reaches_shares_within_caps(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.randrange(20, 60)), "big" if i % 10 else "small") for i in range(3000)]
    rows += [(5000, None, "big"), (5001, "", "small"), (5002, "no target", "other"), (5003, "no source", None), (None, "no key", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"rate": F.lit(1), "uses": F.lit(2), "copy": F.lit(3)})
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.4, 3), ("absent", 0.2, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(df, targets)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"big", "small"} and got["small"]["rate"] == pytest.approx(3.0)
    assert got["big"]["actual_share"] == pytest.approx(0.6, abs=0.02) and got["big"]["actual_share"] + got["small"]["actual_share"] == pytest.approx(1)
    uses = mixed.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("copy").alias("last")).collect()
    assert all(r["n"] == r["last"] <= {"big": 2, "small": 3}[r["source"]] for r in uses)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(df.repartition(3), targets)[0].collect()))
    assert mixing.mix(df.limit(0), targets)[0].collect() == []


TOPIC = {"sport": "the striker scored for the club in the league match", "food": "the kitchen served frozen fish from the dairy", "law": "the court heard the parties and costs follow the event"}


def decision(rng, *topics):
    lines = ["COURT", "Liability - league match - striker.", "JUDGMENT"]
    for k, t in enumerate(topics, 1):
        words = TOPIC[t].split()
        lines.append(f"[{k}] {' '.join(rng.choice(words) for _ in range(14))}. {TOPIC['law']}.")
    return "\n".join(lines)


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(240):
        topics = rng.choice([["sport"] * 3, ["food"] * 3, ["sport", "sport", "food", "food"], ["law"] * 3, ["sport", "law", "law"]])
        rows.append((i, decision(rng, *topics)))
        want[i] = {t for t in ("sport", "food") if topics.count(t) >= 2}
    rows += [(900, None), (901, ""), (902, " \n "), (903, "the striker scored for the club"), (None, rows[0][1]), (904, "[1] Beispielhaft the striker scored in the league match.\n" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("subject", F.lit("clash"))
    labels = spark.createDataFrame([(i, s) for i, ss in want.items() if i < 120 for s in ss] + [(None, "food"), (5, None)], "doc_id long, subject string")
    model = subjects.fit(df, labels)
    got = {}
    for r in subjects.assign(df, model).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [i for i in want if i >= 120]
    assert sum(got.get(i, set()) == want[i] for i in held) >= 0.95 * len(held)
    assert not set(got) & {900, 901, 902, 903, 904, None}


def test_subjects_without_labels_or_documents(spark):
    df = spark.createDataFrame([(1, "[1] a b c\n[2] d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert subjects.assign(df, subjects.fit(df, none)).collect() == []
    assert subjects.assign(df.limit(0), subjects.fit(df.limit(0), none)).collect() == []


def test_paragraphs():
    text = "Heading\n\nHeadnote about fish.\n\n1 – First hy-\nphen &amp; word.\n(2) Second. By way of illustration only, a dispute over fish. Third.\n¶ 3 Last\n— 2 —\nline"
    assert subjects.paragraphs(text) == [["first", "hyphen", "word"], ["second", "third"], ["last", "line"]]
    assert subjects.paragraphs(None) == [] == subjects.paragraphs("no numbers")
