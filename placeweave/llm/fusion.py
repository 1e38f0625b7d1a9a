"""One surviving value per field of each group of duplicates, with a latent model of the sources' quality.

Each distinct value of a field in a group is a latent fact, true or false. Each source that speaks about the group either
asserts it or leaves it out. A source has two qualities: how much of what is true it asserts (sensitivity) and how much of
what is false it leaves out (specificity). Expectation-maximisation finds both and each fact's probability; since facts are
judged one by one, a field may keep several true values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.session import materialize
from placeweave.sources.tables import micros

# Texts that stand in a name's place without naming anything.
NAME_FILLERS = ["anonymous", "asdf", "empty", "n a", "na", "name", "nil", "no name", "no name given", "none", "not available", "not given", "null", "placeholder", "tba", "tbd", "test", "todo", "unknown", "unnamed", "untitled", "xx", "xxx", "xxxx"]


# Each usable_* is one chain of replacements in which every step is named once: Catalyst inlines expressions, and a step named
# twice would be generated and run twice. Unusable texts come out empty, null stays null.


def usable_name(c: Column) -> Column:
    """The name in lower case, its letters and digits alone, single spaces between; empty if it names nothing: blank,
    without letters and digits, or a filler."""
    plain = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(plain, "^(?:" + "|".join(NAME_FILLERS) + ")$", "")


def usable_phone(c: Column) -> Column:
    """The ten digits without country code (1 or 49), trunk zero and extension; empty if there are not ten, or if they
    are one digit repeated or count up or down."""
    s = F.regexp_replace(F.lower(c), r"(?:ext(?:ension)?|x|durchwahl)\.?\s*\d*\s*$", "")
    s = F.regexp_replace(s, r"[^0-9+]", "")
    s = F.regexp_replace(s, r"^(?:\+|00)(?:49|1)|^1(?=\d{10}$)|^49(?=0?\d{10}$)", "")
    s = F.regexp_replace(s, r"^0(?=\d{10}$)", "")
    return F.regexp_extract(s, r"^(?!(\d)\1{9}$)(?!1234567890$|0123456789$|9876543210$|0987654321$)\d{10}$", 0)


def usable_website(c: Column) -> Column:
    """The host in lower case without a leading ``www.``; empty unless the value is a web address (http, https or no
    scheme, no user part) whose host, without the www, has a dot between labels."""
    host = F.regexp_extract(F.lower(F.trim(c)), r"^(?:https?://)?([^\s/?#:@]+)(?::\d+)?(?:[/?#]\S*)?$", 1)
    host = F.regexp_replace(host, r"^www\.|\.$", "")
    return F.regexp_extract(host, r"^[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+$", 0)


USABLE = {"name": usable_name, "phone": usable_phone, "website": usable_website}


@dataclass(frozen=True)
class Qualities:
    """Per (field, source): sensitivity and specificity; per field: the share of true facts."""

    sensitivity: dict[tuple[str, int], float]
    specificity: dict[tuple[str, int], float]
    prior: dict[str, float]


def claims(records: DataFrame, sources: DataFrame, group: str, source: str, rank: str, fields: dict[str, Column], usable: dict, updated: str, key: str) -> DataFrame:
    """``g, field, value, s, rank, at, k``: the usable values of all records, one row each. ``s`` numbers the sources by
    rank; a source that is null or not among ``sources`` gets the number after the last and no rank."""
    known = [r[0] for r in sources.filter(F.col(source).isNotNull()).orderBy(F.col(rank).asc_nulls_last(), source).select(source).collect()]
    if len(known) > 62:
        raise ValueError("sources are kept as bits of a long: 62 at most")
    number = F.lit(len(known))
    for i, name in enumerate(known):
        number = F.when(F.col(source) == name, i).otherwise(number)
    ranks = {r[0]: r[1] for r in sources.select(source, rank).collect()}
    last = 2**31 - 1
    rank_of = F.element_at(F.array(*[F.lit(ranks[n] if ranks[n] is not None else last) for n in known], F.lit(last)), number + 1)
    values = F.array(*[F.struct(F.lit(name).alias("field"), usable[name](c).alias("value")) for name, c in fields.items()])
    rows = records.select(F.col(group).alias("g"), F.col(key).alias("k"), number.alias("s"), rank_of.alias("rank"), F.col(updated).alias("at"), F.explode(values).alias("x"))
    return rows.filter(F.col("x.value") != "").select("g", "k", "s", "rank", "at", "x.field", "x.value")


def facts(claimed: DataFrame) -> DataFrame:
    """``g, field, value, said, silent, best``: per distinct value the sources that assert it and those that speak about
    the field without asserting it, as bits, and the claim to stand for it: lowest rank, then latest, then smallest key."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("s"))
    # Later is better, unknown is worst; the struct orders by rank, then by the negated time.
    claim = F.struct("rank", F.coalesce(-micros(F.col("at")), F.lit(2**62)).alias("age"), "k")
    said = claimed.groupBy("g", "field", "value").agg(F.bit_or(bit).alias("said"), F.min(claim).alias("best"))
    spoke = claimed.groupBy("g", "field").agg(F.bit_or(bit).alias("spoke"))
    return said.join(spoke, ["g", "field"]).withColumn("silent", F.col("spoke").bitwiseAND(F.bitwise_not("said"))).drop("spoke")


def probability(q: Qualities, n_sources: int, fields: list[str]) -> Column:
    """A fact's probability of being true, from the bits of its sources."""
    import math

    odds: Column | None = None
    for f in fields:
        x = F.lit(math.log(q.prior[f] / (1 - q.prior[f])))
        for s in range(n_sources):
            sens, spec = q.sensitivity[f, s], q.specificity[f, s]
            said, silent = F.getbit("said", F.lit(s)) == 1, F.getbit("silent", F.lit(s)) == 1
            x = x + F.when(said, math.log(sens / (1 - spec))).when(silent, math.log((1 - sens) / spec)).otherwise(0.0)
        odds = F.when(F.col("field") == f, x) if odds is None else odds.when(F.col("field") == f, x)
    return 1 / (1 + F.exp(-odds))


def fit_qualities(found: DataFrame, fields: list[str], n_sources: int, rounds: int = 12, tolerance: float = 1e-4, prior_true: tuple[float, float] = (10.0, 10.0), sensitivity: tuple[float, float] = (5.0, 5.0), specificity: tuple[float, float] = (90.0, 10.0)) -> Qualities:
    """EM over all facts. Facts with the same field and the same bits are alike, so they are counted once into a table of
    patterns (combined before the shuffle, written once), and each round reads that table. The pairs are Beta priors; that
    of the specificity says that sources rarely invent values. The driver receives 2 x fields x sources sums a round."""
    patterns = materialize(found.groupBy("field", "said", "silent").agg(F.count("*").alias("n")), "fact-patterns")
    every = [(f, s) for f in fields for s in range(n_sources)]
    q = Qualities({x: 0.6 for x in every}, {x: 0.9 for x in every}, {f: 0.5 for f in fields})
    for _ in range(rounds):
        t = probability(q, n_sources, fields)
        sums = [F.sum(F.col("n")).alias("all"), F.sum(F.col("n") * F.col("t")).alias("true")]
        for s in range(n_sources):
            said, silent = F.getbit("said", F.lit(s)) == 1, F.getbit("silent", F.lit(s)) == 1
            sums += [F.sum(F.when(said, F.col("n") * F.col("t")).otherwise(0.0)).alias(f"tp{s}"), F.sum(F.when(silent, F.col("n") * F.col("t")).otherwise(0.0)).alias(f"fn{s}")]
            sums += [F.sum(F.when(said, F.col("n") * (1 - F.col("t"))).otherwise(0.0)).alias(f"fp{s}"), F.sum(F.when(silent, F.col("n") * (1 - F.col("t"))).otherwise(0.0)).alias(f"tn{s}")]
        seen = {r["field"]: r for r in patterns.withColumn("t", t).groupBy("field").agg(*sums).collect()}
        old, prior = q, {f: q.prior[f] for f in fields}
        sens, spec = dict(q.sensitivity), dict(q.specificity)
        for f, r in seen.items():
            prior[f] = (r["true"] + prior_true[0]) / (r["all"] + sum(prior_true))
            for s in range(n_sources):
                sens[f, s] = (r[f"tp{s}"] + sensitivity[0]) / (r[f"tp{s}"] + r[f"fn{s}"] + sum(sensitivity))
                spec[f, s] = (r[f"tn{s}"] + specificity[0]) / (r[f"tn{s}"] + r[f"fp{s}"] + sum(specificity))
        clip = lambda d: {k: min(max(v, 1e-6), 1 - 1e-6) for k, v in d.items()}
        q = Qualities(clip(sens), clip(spec), clip(prior))
        if max(abs(q.sensitivity[x] - old.sensitivity[x]) + abs(q.specificity[x] - old.specificity[x]) for x in every) < tolerance:
            break
    return q


def fuse(records: DataFrame, sources: DataFrame, group: str, fields: dict[str, Column], usable: dict | None = None, source: str = "feed", rank: str = "trust_rank", updated: str = "updated_at", key: str = "uid") -> DataFrame:
    """``group, field, value, probability, is_true, uid, survives``: every distinct usable value of every field of every
    group that two or more keys hold.

    ``records`` has one row per key. Null or blank groups group nothing; null and unusable values make no claim; a source
    without a rank is trusted least; a missing time counts as the oldest. ``is_true`` marks each value judged true (a
    probability of half or more), so several may stand. Exactly one value per group and field ``survives``: that of the
    best-ranked source, then the latest, as this project defines trust; the probability, then the smallest key decide
    between claims equal in both. ``uid`` is the record that the value is taken from.

    Values are combined per (group, field, value) before the shuffle, so a group of any size costs its distinct values."""
    usable = usable or USABLE
    own = records.withColumn("__g", F.trim(F.col(group))).filter(F.col("__g") != "")
    many = own.groupBy("__g").agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a < b").select("__g")
    claimed = claims(own.join(many, "__g", "left_semi"), sources, "__g", source, rank, fields, usable, updated, key)
    found = materialize(facts(claimed), "facts")
    n_sources = sources.filter(F.col(source).isNotNull()).count() + 1
    q = fit_qualities(found, list(fields), n_sources)
    judged = found.withColumn("probability", probability(q, n_sources, list(fields)))
    order = F.struct("best.rank", "best.age", (-F.col("probability")).alias("p"), "best.k")
    first = judged.groupBy("g", "field").agg(F.min(order).alias("first"))
    out = judged.join(first, ["g", "field"])
    return out.select(F.col("g").alias(group), "field", "value", "probability", (F.col("probability") >= 0.5).alias("is_true"), F.col("best.k").alias(key), (order == F.col("first")).alias("survives"))


def survivors(records: DataFrame, sources: DataFrame, group: str, fields: dict[str, Column], **options) -> DataFrame:
    """``group, field, key`` of the surviving values of :func:`fuse`."""
    key = options.get("key", "uid")
    return fuse(records, sources, group, fields, **options).filter("survives").select(group, "field", key)
