"""Weighted character n-grams, inverted indexes of gapped n-grams, and the settling of spellings by them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.session import materialize, ship, small_side

#: Words of up to so many letters stand under all that is left of them with one left out, longer ones under grams of their ends.
LONG = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def grams(text: Column) -> Column:
    """The distinct pairs of letters that stand side by side or one apart, in their order, the text being set between bars.
    Letters that change places keep most of their pairs, and so do the neighbours of one that is missing or doubled."""
    t = F.concat(F.lit("|"), text, F.lit("|"))
    side = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
    apart = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.concat(F.substr(t, i, F.lit(1)), F.substr(t, i + 2, F.lit(1))))
    return F.array_distinct(F.concat(side, apart))


def one_edit_apart(a: Column, b: Column, edits: Column, most: int = 6) -> Column:
    """Whether at most ``edits`` single-letter edits part two texts, two neighbours changing places being one: beside
    the Levenshtein distance, equal letters in another order count half."""
    d = F.levenshtein(a, b, most)  # -1 beyond
    return (d >= 0) & ((d <= edits) | ((d <= 2 * edits) & same_letters(a, b)))


def same_letters(a: Column, b: Column) -> Column:
    """Whether two texts consist of the same letters."""
    return (F.length(a) == F.length(b)) & (F.sort_array(F.split(a, "")) == F.sort_array(F.split(b, "")))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` by hash over as many tasks as a shuffle has: few bytes that take much work would else be coalesced into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def weighted(vocabulary: DataFrame, text: str) -> DataFrame:
    """``text, gram, w``: each text's grams, weighted by the root of their inverse document frequency over the vocabulary, since a
    slip of the pen makes rare grams, which would else outweigh all that two spellings share. Distinct grams are few (the
    letters' square at most): they are broadcast behind a count, so the texts' own partitioning stays."""
    rows = spread(vocabulary.select(F.col(text).alias("text")), "text").select("text", F.explode(grams(F.col("text"))).alias("gram"))
    df = small_side(rows.groupBy("gram").agg(F.count("*").alias("df")), "gram-frequencies")
    total = vocabulary.agg(F.count("*")).scalar()
    return rows.join(df, "gram").withColumn("w", F.sqrt(F.ln(1 + total / F.col("df"))))


def vectors(weights: DataFrame) -> DataFrame:
    """``text, grams, squares, norm``: each text's grams, the squares of their weights, and the vector's length."""
    v = weights.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("gram", "w"))).alias("vector"))
    squares = F.transform("vector", lambda x: x["w"] * x["w"])
    return v.select("text", F.transform("vector", lambda x: x["gram"]).alias("grams"), squares.alias("squares"), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)).alias("norm"))


def cosine(a: str, b: str) -> Column:
    """Cosine of two vectors in columns ``<a>_grams, <a>_squares, <a>_norm``: a gram has one weight everywhere, so the
    product over the shared grams is the sum of their squares."""
    pairs = F.zip_with(f"{a}_grams", f"{a}_squares", lambda g, s: F.when(F.array_contains(F.col(f"{b}_grams"), g), s).otherwise(0.0))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / (F.col(f"{a}_norm") * F.col(f"{b}_norm"))


def stirred(x: np.ndarray) -> np.ndarray:
    """64 bits stirred so that each depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def left_out(letters: np.ndarray, cut: int) -> list[np.ndarray]:
    """What is left of each row of letters (a byte each, eight at most) with ``cut`` of them left out, for each choice, as numbers:
    grams with gaps."""
    size = letters.shape[1]
    out = []
    for gone in combinations(range(size), cut):
        code = np.full(len(letters), cut, np.uint64)
        for i in range(size):
            if i not in gone:
                code = code << np.uint64(8) | letters[:, i]
        out.append(code)
    return out


def ends_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first eight and the last eight letters of each word, a byte each (other letters than Latin ones share bytes), and its length."""
    raw = [w.encode("ascii") if w.isascii() else bytes(ord(c) if c < "\x80" else 128 + ord(c) % 128 for c in w) for w in words]
    first = np.frombuffer(b"".join(w[:8].ljust(8, b"\0") for w in raw), np.uint8).reshape(-1, 8)
    last = np.frombuffer(b"".join(w[-8:].rjust(8, b"\0") for w in raw), np.uint8).reshape(-1, 8)
    return first.astype(np.uint64), last.astype(np.uint64), np.array([len(w) for w in raw])


def gapped_grams(words: list[str], size: np.ndarray, edits: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``rows, numbers``: the gapped grams of words: words of under four letters bear no edit, of under eight one, others ``edits``. Words that so many edits part, two neighbours changing places being one, share one: of the first letters with
    one left out, or of the first and last letters, ``size`` together, with ``edits`` left out. An edit changes one of the two ends,
    unless it swaps letters across the middle of an eight-letter word, which therefore has the grams of the swapped word too."""
    if not words:
        return
    first, last, n = ends_of(words)
    tiny = np.nonzero(n < 4)[0]
    yield tiny, left_out(first[tiny], 0)[0]
    for k in range(3, 9):
        if k <= 6:
            at = np.nonzero((n >= 4) & (n <= 8) & (np.minimum(size, 6) == k))[0]
            for code in left_out(first[at][:, :k], 1):
                yield at, code
        at = np.nonzero((n >= 8) & (np.minimum(size, 8) == k))[0]
        ends = np.hstack([first[at][:, : (k + 1) // 2], last[at][:, 8 - k // 2 :]])
        for code in left_out(ends, edits):
            yield at, code
        if k == 8:
            swapped = n[at] == 8
            for code in left_out(ends[swapped][:, [0, 1, 2, 4, 3, 5, 6, 7]], edits):
                yield at[swapped], code


def one_left_out(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``rows, numbers``: words of four letters and more under all that is left of them with one letter left out, and whole, both up to ``LONG``
    letters, and under their letters in order. Words that one edit parts share one, two neighbours changing places being one, and
    so do those of the same letters; hardly any others do."""
    n = np.array([len(w) for w in words], np.int64)
    for size in np.unique(n[n >= 4]).tolist():
        at = np.nonzero(n == size)[0]
        power = np.cumprod(np.full(size, _BASE, np.uint64))
        # A few rows at a time where words are long.
        for rows in np.array_split(at, min(len(at), 1 + len(at) * size // 1_000_000)):
            letters = np.array([words[i] for i in rows], f"U{size}").view(np.uint32).reshape(-1, size).astype(np.uint64) + np.uint64(1)
            yield rows, stirred((np.sort(letters, axis=1) * power).sum(axis=1, dtype=np.uint64) ^ np.uint64(1))
            if size > LONG:
                continue
            before, after = np.cumsum(letters * power, axis=1, dtype=np.uint64), np.cumsum(letters[:, 1:] * power[:-1], axis=1, dtype=np.uint64)
            yield rows, before[:, -1]
            yield rows, after[:, -1]
            for i in range(1, size):
                # Of two equal neighbours either may go.
                other = np.nonzero(letters[:, i] != letters[:, i - 1])[0]
                yield rows[other], before[other, i - 1] + after[other, -1] - after[other, i - 1]


def _entries(words: list[str], size: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """``rows, entries`` under which words stand that ``edits`` edits may part: one of up to ``LONG`` letters under what is left of it with
    a letter left out, all others under their gapped grams."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    if edits == 1:
        found += [(rows, stirred(codes) ^ np.uint64(1)) for rows, codes in one_left_out(words)]
        # Words of just so many letters are found from either side.
        long = np.array([i for i, w in enumerate(words) if len(w) >= LONG], np.int64)
        found += [(long[rows], stirred(codes)) for rows, codes in gapped_grams([words[i] for i in long], size[long], 1)]
    else:
        found += [(rows, stirred(codes)) for rows, codes in gapped_grams(words, size, edits)]
    return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])


def _index(words: DataFrame, edits: int) -> DataFrame:
    """``entry, block, text, n``: the words of ``block, text, n, size`` under each of their entries (:func:`_entries`), by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, codes = _entries(b.column("text").to_pylist(), b.column("size").to_numpy(), edits)
            block = stirred(b.column("key").to_numpy().view(np.uint64))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(stirred(codes ^ block[rows]).view(np.int64)), *[b.column(c).take(at) for c in ("block", "text", "n")]], ["entry", "block", "text", "n"])

    ship(words.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in words.schema}
    return words.select("block", "text", "n", "size", F.xxhash64("block").alias("key")).mapInArrow(run, f"entry bigint, block {kinds['block']}, text string, n {kinds['n']}")


def similar(vocabulary: DataFrame, threshold: float, edits: int = 1, slips: float = 0.1) -> DataFrame:
    """``block, text, to, cos, to_n``: for each spelling of a vocabulary ``block, text, n`` the spellings of its block that are more
    frequent (of equal ones the first in order), whose weighted grams have a cosine of at least ``threshold`` with its own,
    and that ``edits`` edits reach (one or two; one in texts of under eight letters, none under four). Where one letter
    stands for another, as in the names of two places (Millerton, Hillerton), the rarer must not be more frequent than slips
    are: with the other's count m, at most ``slips`` x m, and three standard deviations and one more.

    Candidates meet in an inverted index by block, whatever their counts; no pair within the edits fails to. For one edit a
    spelling stands under what is left of it with one letter left out, so that few meet by chance; for two, and for long
    spellings, under gapped grams, which are the longer the more spellings a block has. The
    edits are tested in the join, so that the vectors are only fetched for what is left of it. Index and vectors are never
    broadcast: Spark takes them for as small as the compressed vocabulary, which has a tenth of their rows and bytes."""
    words = vocabulary.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    sizes = words.groupBy("block").agg(F.greatest(F.ceil(F.log(8.0, F.count("*"))) + 2, F.lit(3)).cast("bigint").alias("size"))
    index = spread(_index(spread(words.join(sizes, "block"), "text"), edits), "entry", "block")
    a, b = (index.select("entry", "block", F.col("n").alias(f"{s}_n"), F.col("text").alias(f"{s}_text")).hint("merge") for s in "ab")
    up = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_text") > F.col("b_text")))
    x, y = F.col("a_text"), F.col("b_text")
    same = same_letters(x, y)
    if edits == 1:
        near = (F.levenshtein(x, y, 1) >= 0) | (same & (F.levenshtein(x, y, 2) >= 0))
    else:
        near = one_edit_apart(x, y, F.when(F.least(F.length(x), F.length(y)) < 8, 1).otherwise(edits), 2 * edits)
    rare = F.col("a_n") <= 1 + slips * F.col("b_n") + 3 * F.sqrt(slips * F.col("b_n"))
    # What is cheap to test comes first.
    met = a.join(b, ["entry", "block"]).filter(up & (F.abs(F.length(x) - F.length(y)) <= edits) & near & ((F.length(x) != F.length(y)) | rare | same))
    met = met.select("block", "a_text", "b_text", "a_n", "b_n").distinct()
    v = materialize(vectors(weighted(words.select("text").distinct(), "text")), "spelling-vectors")
    side = lambda s: v.select(F.col("text").alias(f"{s}_text"), *[F.col(c).alias(f"{s}_{c}") for c in ("grams", "squares", "norm")]).hint("merge")
    near = spread(met.join(side("a"), "a_text"), "b_text").join(side("b"), "b_text").withColumn("cos", cosine("a", "b"))
    return near.filter(F.col("cos") >= threshold).select("block", F.col("a_text").alias("text"), F.col("b_text").alias("to"), "cos", F.col("b_n").alias("to_n"))


def settled(links: DataFrame) -> DataFrame:
    """``block, text, to`` of the spellings that stand for another: each for the most frequent of those it is linked to by
    :func:`similar` (then the most similar, then the first in order), followed to the end, so that spellings that lead to one
    another by steps have one spelling. Links go to the more frequent, so they have no rings."""
    best = links.groupBy("block", "text").agg(F.max(F.struct("to_n", F.round("cos", 9).alias("c"), "to")).alias("best"))
    ends = materialize(best.select("block", "text", F.col("best.to").alias("to")), "spellings-settled")
    # Each turn doubles the steps that are made at once.
    while True:
        above = ends.select("block", F.col("text").alias("to"), F.col("to").alias("above")).hint("merge")
        further = ends.join(above, ["block", "to"], "left")
        if further.filter("above IS NOT NULL").isEmpty():
            return ends
        ends = materialize(further.select("block", "text", F.coalesce("above", "to").alias("to")), "spellings-settled")
