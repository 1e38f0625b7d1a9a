"""Word relevance models: document frequencies, TF-IDF and information gain, global or per tile.

``docs`` always has ``uid`` and ``tokens``; the tile forms need ``lat`` and ``lon`` too. Null tokens and empty lists are no
documents. Words and tiles are aggregated with partial sums before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placeweave.functions.tiles import tile, tile_and_neighbors
from placeweave.functions.vectors import l2_normalized, tfidf_score


def doc_words(docs: DataFrame, *keep: str) -> DataFrame:
    """``uid, *keep, pos, word``: a row per token."""
    return docs.select("uid", *keep, F.posexplode("tokens").alias("pos", "word"))


def doc_word_counts(docs: DataFrame) -> DataFrame:
    """``uid, word, tf``."""
    return doc_words(docs).groupBy("uid", "word").agg(F.count("*").alias("tf"))


def total_docs(docs: DataFrame) -> Column:
    """The number of documents with a token, as a scalar of the plan."""
    return docs.filter(F.size("tokens") > 0).agg(F.count("*")).scalar()


def doc_frequency(docs: DataFrame) -> DataFrame:
    """``word, df``."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def merged_counts(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts of two batches added up; the result is that of counting both at once."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum(value).alias(value))


def with_min_count(counts: DataFrame, least: int = 2, value: str = "df") -> DataFrame:
    return counts.filter(F.col(value) >= least)


def marginals(docs: DataFrame) -> DataFrame:
    """``word, df, p``."""
    return doc_frequency(docs).withColumn("p", F.col("df") / total_docs(docs))


def cooccurrences(docs: DataFrame, *keys: str) -> DataFrame:
    """``*keys, word, other, n``: documents with both of two different words. Names are short, so the ordered pairs come
    from the array itself, without a self-join."""
    d = docs.select(*keys, F.array_distinct("tokens").alias("w"))
    pairs = d.select(*keys, "w", F.explode("w").alias("word")).select(*keys, "word", F.explode(F.filter("w", lambda o: o != F.col("word"))).alias("other"))
    return pairs.groupBy(*keys, "word", "other").agg(F.count("*").alias("n"))


def _gain(pairs: DataFrame, frequencies: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, word, gain`` from co-occurrences and from frequencies ``*keys, word, df, p``.

    With t documents shared in all, the sum over n/t x log2(n/t / p) is that of n x log2(n/p), less that of n times log2(t), over t:
    sums that are combined before their shuffle, so that a word beside all others is no task of its own."""
    met = pairs.join(frequencies.select(*keys, F.col("word").alias("other"), "p"), [*keys, "other"], "left")
    sums = met.groupBy(*keys, "word").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("p").isNotNull(), F.col("n"))).alias("m"), F.sum(F.col("n") * F.log2(F.col("n") / F.col("p"))).alias("s"))
    gained = sums.filter("m IS NOT NULL").select(*keys, "word", F.greatest((F.col("s") - F.col("m") * F.log2("t")) / F.col("t"), F.lit(0.0)).alias("gain"))
    return frequencies.join(gained, [*keys, "word"], "left").select(*keys, "word", F.coalesce("gain", F.log2(1 / F.col("p"))).alias("gain"))


def info_gain(docs: DataFrame, min_count: int = 1) -> DataFrame:
    """``word, gain``: the divergence of a word's company from the overall frequencies, at least 0; log2(1/p) for a word
    that is always alone."""
    return _gain(cooccurrences(docs), with_min_count(marginals(docs), min_count), [])


def scored_docs(docs: DataFrame, scores: DataFrame, default: Column | float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``uid, tokens, scores``: each document's scores in the order of its tokens, L2-normalized. Words without a score have
    the default; documents without tokens have empty lists. ``scores`` is ``*keys, word, score``."""
    default = F.lit(default) if isinstance(default, (int, float)) else default
    words = doc_words(docs, *keys).join(scores, [*keys, "word"], "left").withColumn("score", F.coalesce("score", default))
    lists = words.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "score"))).alias("x"))
    lists = lists.select("uid", F.transform("x", lambda x: x["word"]).alias("tokens"), l2_normalized(F.transform("x", lambda x: x["score"])).alias("scores"))
    none = docs.filter(F.coalesce(F.size("tokens"), F.lit(0)) <= 0).select("uid", F.array().cast("array<string>").alias("tokens"), F.array().cast("array<double>").alias("scores"))
    return lists.unionByName(none)


def tfidf_scores(docs: DataFrame, min_count: int = 1, frequencies: DataFrame | None = None, total: Column | None = None) -> DataFrame:
    """``word, score``: ln 2 x ln(N/df); ``frequencies`` and ``total`` may come from a merged index."""
    df = with_min_count(doc_frequency(docs) if frequencies is None else frequencies, min_count)
    return df.select("word", tfidf_score(1, F.col("df"), total_docs(docs) if total is None else total).alias("score"))


def docs_by_tile(docs: DataFrame, precision: int = 4) -> DataFrame:
    """``geo, num_docs``: documents with a location, counted in their tile and those around it."""
    from placeweave.functions.tiles import around

    own = docs.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy(tile(F.col("lat"), F.col("lon"), precision).alias("tile")).agg(F.count("*").alias("num_docs"))
    return own.select(F.explode(around(F.col("tile"), precision)).alias("geo"), "num_docs").groupBy("geo").agg(F.sum("num_docs").alias("num_docs"))


def tile_aliases(by_tile: DataFrame, min_docs: int = 1000, precision: int = 4) -> DataFrame:
    """``geo, alias``: for tiles under ``min_docs``, the neighbour with most documents among those that reach it; of equal
    ones the greatest number. Tiles without such a neighbour have no alias."""
    from placeweave.functions.tiles import bits

    xb, yb = bits(precision)
    dense = by_tile.filter(F.col("num_docs") >= min_docs)
    x, y = F.floor(F.col("geo") / 2**yb), F.col("geo") % 2**yb
    around = [F.when((y + dy).between(0, 2**yb - 1), F.pmod(x + dx, F.lit(2**xb)) * 2**yb + y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    reach = by_tile.filter(F.col("num_docs") < min_docs).select("geo", F.explode(F.array_compact(F.array(*around))).alias("next"))
    found = reach.join(dense.select(F.col("geo").alias("next"), "num_docs"), "next")
    return found.groupBy("geo").agg(F.max_by("next", F.struct("num_docs", "next")).alias("alias"))


def folded_tiles(by_tile: DataFrame, aliases: DataFrame) -> DataFrame:
    """``geo, num_docs`` with sparse tiles added to their alias."""
    return by_tile.join(aliases, "geo", "left").groupBy(F.coalesce("alias", "geo").alias("geo")).agg(F.sum("num_docs").alias("num_docs"))


def _spread_over_tiles(counts: DataFrame, aliases: DataFrame, precision: int, keys: list[str], value: str) -> DataFrame:
    """``geo, *keys, value``: counts by own ``tile``, added up over the tile and those around it, aliases put in. Documents of one
    tile lie in the same nine, so they are counted once before their counts, not they themselves, are multiplied."""
    from placeweave.functions.tiles import around

    reached = counts.select("tile").distinct().select("tile", F.explode(around(F.col("tile"), precision)).alias("geo"))
    reached = reached.join(aliases, "geo", "left").select("tile", F.coalesce("alias", "geo").alias("geo"))
    return counts.join(reached, "tile").groupBy("geo", *keys).agg(F.sum(value).alias(value))


def _by_tile(docs: DataFrame, precision: int) -> DataFrame:
    return docs.filter("lat IS NOT NULL AND lon IS NOT NULL").select("tokens", tile(F.col("lat"), F.col("lon"), precision).alias("tile"))


def geo_frequency(docs: DataFrame, aliases: DataFrame, precision: int = 4) -> DataFrame:
    """``geo, word, df``."""
    own = _by_tile(docs, precision).select("tile", F.explode(F.array_distinct("tokens")).alias("word")).groupBy("tile", "word").agg(F.count("*").alias("df"))
    return _spread_over_tiles(own, aliases, precision, ["word"], "df")


def geo_cooccurrences(docs: DataFrame, aliases: DataFrame, precision: int = 4) -> DataFrame:
    """``geo, word, other, n``."""
    return _spread_over_tiles(cooccurrences(_by_tile(docs, precision), "tile"), aliases, precision, ["word", "other"], "n")


def _tiles(docs: DataFrame, min_docs: int, precision: int) -> tuple[DataFrame, DataFrame]:
    """Counts and aliases of the tiles; callers that have them pass them on as ``tiles``."""
    by_tile = docs_by_tile(docs, precision)
    return by_tile, tile_aliases(by_tile, min_docs, precision)


def geo_tfidf_scores(docs: DataFrame, min_docs: int = 1000, precision: int = 4, min_count: int = 1, tiles: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``geo, word, score`` with each tile's own documents."""
    by_tile, aliases = tiles or _tiles(docs, min_docs, precision)
    df = with_min_count(geo_frequency(docs, aliases, precision), min_count)
    return df.join(folded_tiles(by_tile, aliases), "geo").select("geo", "word", tfidf_score(1, F.col("df"), F.col("num_docs")).alias("score"))


def geo_info_gain(docs: DataFrame, min_docs: int = 1000, precision: int = 4, min_count: int = 1, tiles: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``geo, word, gain``."""
    by_tile, aliases = tiles or _tiles(docs, min_docs, precision)
    freq = with_min_count(geo_frequency(docs, aliases, precision), min_count).join(folded_tiles(by_tile, aliases), "geo").withColumn("p", F.col("df") / F.col("num_docs"))
    return _gain(geo_cooccurrences(docs, aliases, precision), freq.select("geo", "word", "df", "p"), ["geo"])


def own_tile(docs: DataFrame, aliases: DataFrame, precision: int = 4) -> DataFrame:
    """``docs`` with ``geo``, the alias of the tile they lie in or the tile itself; null without a location."""
    at = docs.withColumn("geo", tile(F.col("lat"), F.col("lon"), precision))
    return at.join(aliases, "geo", "left").withColumn("geo", F.coalesce("alias", "geo")).drop("alias")
