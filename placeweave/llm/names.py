"""Variant spellings of the names of one venue, firm or person."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations, permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.addresses import _MARKS, _WORD, Slips, read_city, read_postcode, read_street, resolved_streets, settled_cities
from placeweave.llm.fusion import NAME_FILLERS
from placeweave.llm.linkage import average_linkage
from placeweave.llm.ngrams import ends_of, gapped_grams, left_out, spread, stirred
from placeweave.session import discard, let_go, materialize, ship, small_side

# Short forms of first names, after the name they stand for.
NICKNAMES = {
    "alexander": "alex sasha sandy", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben", "catherine": "cathy kate katie cate", "charles": "charlie chuck", "christopher": "chris", "daniel": "dan danny", "david": "dave",
    "deborah": "deb debbie", "dorothy": "dot dottie", "edward": "ed ned eddie", "elizabeth": "liz beth betty lizzie", "frederick": "fred fritz freddie", "gabriel": "gabe", "henrietta": "hettie etta", "isabella": "bella izzy", "james": "jim jamie jimmy",
    "jennifer": "jen jenny", "john": "jack johnny", "joseph": "joe", "josephine": "jo josie", "leonard": "len lenny", "margaret": "peggy maggie meg", "matthew": "matt", "michael": "mike mick", "nicholas": "nick nicky", "patricia": "pat trish patty", "peter": "pete",
    "rebecca": "becky", "richard": "rick dick rich", "robert": "bob rob bobby", "samuel": "sam", "stephen": "steve", "susan": "sue susie", "theodore": "ted teddy", "thomas": "tom", "victoria": "vicky tori", "william": "bill will wm billy", "zachary": "zach zack",
}
# Words that say what a place is, and their short forms.
KINDS = {
    "academy": "acad", "accounting": "acctg", "agency": "agcy", "architects": "archt", "attorneys": "attys atty", "auto": "", "bakery": "", "bank": "", "bar": "", "bicycle": "bike", "bookshop": "", "branch": "br", "bureau": "", "cafe": "", "cellar": "", "center": "ctr centre cntr", "church": "",
    "cleaners": "", "clinic": "clin", "coffee": "", "consulate": "cons consul", "contractors": "contr", "day": "", "dental": "dent", "depot": "", "dry": "", "electrical": "elec", "elementary": "elem", "fitness": "", "flower": "", "furniture": "furn", "gallery": "", "garage": "gar",
    "grocery": "groc", "hair": "", "hardware": "hdwe", "hospital": "hosp", "hotel": "", "house": "hse", "insurance": "ins", "jewelers": "jwlrs", "law": "", "library": "lib", "market": "mkt mart", "museum": "mus", "music": "", "noodle": "", "offices": "office ofcs ofc", "parking": "pkg",
    "pharmacy": "pharm phcy", "photography": "photo", "printing": "", "repair": "", "restaurant": "rest restnt", "salon": "", "school": "sch schl", "shop": "", "spa": "", "storage": "", "store": "", "studio": "", "travel": "", "veterinary": "vet", "wine": "", "workshop": "wkshp",
}
# Words that a name keeps or drops without naming something else, and their short forms.
TRIMMINGS = {
    "american": "amer", "associated": "assocd", "associates": "assocs assoc", "brothers": "bros", "central": "", "community": "comm", "company": "co", "downtown": "", "express": "", "family": "", "general": "gen", "group": "grp", "historical": "hist", "international": "intl", "national": "natl",
    "professional": "prof", "public": "publ", "royal": "", "services": "svcs svc service", "and": "", "of": "", "the": "", "corporation": "corp", "incorporated": "inc", "limited": "ltd", "llc": "", "pllc": "", "llp": "", "gmbh": "", "plc": "", "doctor": "dr", "esquire": "esq", "mr": "", "mrs": "", "ms": "",
    "dds": "", "md": "", "phd": "", "cpa": "", "dvm": "", "jr": "", "sr": "",
}
TITLES = {"doctor", "esquire", "mr", "mrs", "ms", "dds", "md", "phd", "cpa", "dvm"}

_FIRST = {w: k for k, ws in NICKNAMES.items() for w in [k, *ws.split()]}
_KIND = {w: k for k, ws in KINDS.items() for w in [k, *ws.split()]}
# Lawyers call themselves attorneys or law offices.
_KIND |= {w: "law" for w in ("attorneys", "attys", "atty")}
_TRIM = {w: k for k, ws in TRIMMINGS.items() for w in [k, *ws.split()]}
_KNOWN = _KIND | _TRIM
_slipped_known = Slips({w for w in _KNOWN.values() if len(w) >= 6})
_slipped_first = Slips({w for w in NICKNAMES if len(w) >= 6})
_FILLERS = frozenset(NAME_FILLERS)
_APOSTROPHE = re.compile(r"[’'`]s\b|[’'`]")
_AFTER = re.compile(r"\([^)]*\)|\s[-–—]\s.*$|(?:,\s*)?\b(?:store|no|nr|branch)\.?\s*#?\d+\s*$|#\s*\d+\s*$")
#: Without one of these, nothing stands behind a name.
_SIGNS = re.compile(r"[(#\d–—-]")
_DOTTED = re.compile(r"\b(?:[a-z]\.){2,}")
#: Blocks of at most so many brands are compared pair by pair.
FEW = 16
#: Blocks of at most so many brands are searched by one task, larger ones by a join of their entries.
MOST = 100_000
#: The larger ones are joined in so many turns, so that no more than a turn's entries lie on the disks at a time.
TURNS = 4
#: So many brands are gathered before they are searched, and so many meetings are looked at together, those of one brand at least.
GATHERED, MEETINGS = 20_000, 1_000_000
#: Letters are told apart by these many classes: the bar, a to z, the digits; all others share the rest.
CLASSES = 64
_CLASS = {"|": 0} | {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}


@lru_cache(200_000)
def _roles(word: str) -> tuple[tuple[str, str], ...]:
    """What a word of a name is: of the name itself, a kind, a title or a trimming; glued words are cut in two."""
    if word not in _KNOWN and len(word) >= 6:
        for i in range(3, len(word) - 1):
            a, b = word[:i], word[i:]
            if a in _KNOWN and b in _KNOWN and (a in _KIND or b in _KIND):
                return _roles(a) + _roles(b)
    known = _KIND.get(word) or _TRIM.get(word) or (_slipped_known(word) if len(word) > 5 else None)
    if not known:
        return (("own", word),)
    # "law" stands for the lawyers' own words and is a kind like those it is among.
    if word in _KIND or (word not in _TRIM and known in KINDS):
        return (("kind", known),)
    return (("title" if word in _TRIM and known in TITLES else "trim", known),)


def read_name(name: str | None) -> tuple[str, str, str, str] | None:
    """``brand, kinds, first names, initials`` of a name: its own words in order, the words for what it is, the full first
    names, and the single letters of a person's name; None if it names nothing.

    Lower case without marks; what stands behind " - " or in brackets (a branch's town or number) is taken off; short
    forms are written out; legal forms and trimmings vanish; glued kinds (dentalclinic) are cut; one slip in a long known
    word is forgiven. A name without words of its own keeps its kinds as its words."""
    text = (name or "").lower()
    if not text.isascii():
        text = text.translate(_MARKS)
    if "'" in text or "’" in text or "`" in text:
        text = _APOSTROPHE.sub("", text)
    whole = text
    if _SIGNS.search(text) and _AFTER.search(text):
        text = _AFTER.sub(" ", text)
    if "." in text:
        text = _DOTTED.sub(lambda m: m[0].replace(".", ""), text)
    words = _WORD.findall(text)
    plain = " ".join(words if text is whole else _WORD.findall(whole))
    if not words or plain in _FILLERS or " ".join(words) in _FILLERS:
        return None
    own, kinds, titled = [], [], False
    for w in words:
        for role, value in _roles(w):
            if role == "kind":
                kinds.append(value)
            elif role == "own":
                own.append(value)
            else:
                titled |= role == "title"
    first, initials = [], []
    if not kinds:
        rest = []
        for w in own:
            if len(w) == 1:
                initials.append(w)
            elif (f := _FIRST.get(w) or (len(w) > 5 and _slipped_first(w)) or None) and len(own) > 1:
                first.append(f)
            else:
                rest.append(w)
        if not rest and first:
            rest, first = first, []
        own = rest
        if titled or first or initials:
            kinds = ["person"]
    else:
        own = [w for w in own if len(w) > 1] or own
    if not own:
        own, kinds = [k for k in kinds if k != "person"] or words, []
    return " ".join(sorted(set(own))), " ".join(sorted(set(kinds))), " ".join(sorted(set(first))), "".join(sorted(set(initials)))


def brand_grams(brand: str) -> set[int]:
    """The pairs of letters that stand side by side or one apart in a brand's words, each word between bars, as numbers under
    the square of ``CLASSES``."""
    out: set[int] = set()
    for w in brand.split(" "):
        p = [_CLASS.get(c, 37 + ord(c) % (CLASSES - 37)) for c in f"|{w}|"]
        out.update(x * CLASSES + y for x, y in zip(p, p[1:]))
        out.update(x * CLASSES + y for x, y in zip(p, p[2:]))
    return out


def _pair_forms(pairs: list[tuple[str, str]], size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The gapped grams of two words together: of the first letters of each, ``size`` together, two of them left out."""
    if not pairs:
        return
    (a, _, _), (b, _, _) = ends_of([p[0] for p in pairs]), ends_of([p[1] for p in pairs])
    half = np.minimum((size + 1) // 2, 4)
    for k in range(2, 5):
        at = np.nonzero(half == k)[0]
        for code in left_out(np.hstack([a[at][:, :k], b[at][:, :k]]), 2):
            yield at, code


def index_entries(brands: list[str], size: np.ndarray, found: bool) -> tuple[np.ndarray, np.ndarray]:
    """``rows, entries``: the entries that brands look for in the inverted index and under which they stand there; with ``found``
    those under which they only stand. Any two brands on which :func:`words_agree` share one that one of them looks for.

    A brand of one word looks for its gapped grams; one of several stands under those of each of its words too,
    since one of them may be all that the other brand has. A brand of several words looks for the gapped grams of its two longest
    together, in either order, and stands under those of any two of its words in one order. The letters without spaces are an
    entry too. ``size`` letters make a gram, less those left out."""
    split = [b.split(" ") for b in brands]
    words, pairs, glued = [], [], []
    for i, ws in enumerate(split):
        if len(ws) == 1:
            if not found:
                words.append((i, ws[0]))
        elif found:
            words += [(i, w) for w in set(ws)]
            pairs += [(i, p) for p in combinations(ws, 2)]
        else:
            pairs += [(i, p) for p in permutations(sorted(ws, key=lambda w: (-len(w), w))[:2])]
        if not found or len(ws) > 1:
            glued.append((i, "".join(ws)))
    rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for tag, items, forms in ((1, words, gapped_grams), (2, pairs, _pair_forms)):
        of = np.array([i for i, _ in items], np.int64)
        for at, code in forms([x for _, x in items], size[of]):
            rows.append(of[at])
            codes.append(stirred(code + np.uint64(tag << 60)))
    rows.append(np.array([i for i, _ in glued], np.int64))
    codes.append(np.array([crc32(w.encode()) for _, w in glued], np.uint64) + np.uint64(3 << 60))
    return np.concatenate(rows), np.concatenate(codes)


def _indexed(brands: DataFrame, found: bool) -> DataFrame:
    """``entry, at, asks``: the entries of ``block, brand, at, asks, size`` by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, codes = index_entries(b.column("brand").to_pylist(), b.column("size").to_numpy(), found)
            block = b.column("block").to_numpy().view(np.uint64)
            entry = stirred(codes ^ stirred(block)[rows]).view(np.int64)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(entry), b.column("at").take(at), b.column("asks").take(at)], ["entry", "at", "asks"])

    ship(brands.sparkSession)
    return brands.select("block", "brand", "at", "asks", "size").mapInArrow(run, "entry bigint, at bigint, asks boolean").withColumn("found", F.lit(found))


def meetings(brands: list[str], block: np.ndarray, asks: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``rows, rows``: the pairs of brands of whole blocks that meet in the inverted index and of which the first asks, each pair once."""
    several = np.array([" " in b for b in brands], bool)
    # Of two brands of several words the one with fewer looks, and of equally many either: only for askers of three is another of several asked.
    three = np.unique(block[asks & np.array([b.count(" ") > 1 for b in brands], bool)])
    keys = stirred(block.view(np.uint64))

    def entries(of: np.ndarray, found: bool) -> tuple[np.ndarray, np.ndarray]:
        at = np.nonzero(of)[0]
        rows, codes = index_entries([brands[i] for i in at], size[at], found)
        return at[rows], stirred(codes ^ keys[at][rows])

    joined = lambda *parts: tuple(np.concatenate(x) for x in zip(*parts))
    single, stands = entries(~several, False), entries(several, True)
    alone = asks[single[0]]
    looked = joined((single[0][alone], single[1][alone]), entries(several & asks, False))
    # What a brand is only found under does not meet its like: two brands need not be compared because one word is in both.
    offered = asks[stands[0]]
    others = joined((single[0][~alone], single[1][~alone]), entries(several & ~asks & np.isin(block, three), False))
    # First those that look, then those that are only found; the second kind is told from the first by its own entries.
    looks = joined(looked, (stands[0][offered], ~stands[1][offered]))
    there = joined(single, stands, (others[0], ~others[1]))
    wanted = np.unique(looks[1])
    if not len(wanted):
        return
    met = wanted[np.minimum(np.searchsorted(wanted, there[1]), len(wanted) - 1)] == there[1]
    order = np.argsort(there[1][met], kind="stable")
    who, entry = there[0][met][order], there[1][met][order]
    order = np.argsort(looks[0], kind="stable")
    a, code = looks[0][order], looks[1][order]
    first = np.searchsorted(entry, code, "left")
    n = np.searchsorted(entry, code, "right") - first
    a, first, n = a[n > 0], first[n > 0], n[n > 0]
    ends, begins = np.cumsum(n), np.nonzero(np.diff(a, prepend=-1))[0]
    at = 0
    while at < len(a):
        # As many brands as have so many meetings together, at least one.
        begun = ends[at] - n[at]
        last = np.searchsorted(ends, begun + MEETINGS, "right")
        k = np.searchsorted(begins, last, "right") - 1 if last < len(a) else len(begins)
        to = len(a) if k >= len(begins) else int(begins[k])
        if to <= at:
            k = np.searchsorted(begins, at, "right")
            to = int(begins[k]) if k < len(begins) else len(a)
        m = n[at:to]
        x = np.repeat(a[at:to], m)
        y = who[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[at:to], m)]
        # A pair of which both ask may be met from either side.
        turned = asks[y] & (y < x)
        pairs = np.unique((np.where(turned, y, x) * len(brands) + np.where(turned, x, y))[x != y])
        yield pairs // len(brands), pairs % len(brands)
        at = to


def _met(brands: DataFrame) -> DataFrame:
    """``a_at, b_at, x, y``: the brands of ``block, brand, at, asks, size`` that meet in their block's index, searched block by block where they
    lie, so that neither entries nor meetings are shuffled. A pair may come twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def searched(t: pa.Table) -> Iterator[pa.RecordBatch]:
            at, brand = (pa.concat_arrays(t.column(c).chunks) for c in ("at", "brand"))
            for a, b in meetings(brand.to_pylist(), t.column("block").to_numpy(), t.column("asks").to_numpy().astype(bool), t.column("size").to_numpy()):
                for i in range(0, len(a), 50_000):
                    x, y = pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays([at.take(x), at.take(y), brand.take(x), brand.take(y)], ["a_at", "b_at", "x", "y"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) < GATHERED:
                continue
            t = pa.Table.from_batches(held)
            block = t.column("block").to_numpy()
            # The last block may go on.
            whole = int(np.nonzero(block != block[-1])[0][-1]) + 1 if (block != block[-1]).any() else 0
            if whole:
                yield from searched(t.slice(0, whole))
                held = t.slice(whole).to_batches()
        if held:
            yield from searched(pa.Table.from_batches(held))

    ship(brands.sparkSession)
    # By a hash of their own: Spark would leave out a shuffle by what a join before it was shuffled by, and then may not shuffle for that join.
    lying = spread(brands.select("block", "brand", "at", "asks", "size", F.xxhash64("block").alias("task")), "task").sortWithinPartitions("block")
    return lying.mapInArrow(run, "a_at bigint, b_at bigint, x string, y string")


def edits(a: str, b: str, most: int) -> int:
    """Edits that part two words, two neighbours changing places being one; ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # What both begin and end with needs no edit.
    i, m = 0, min(len(a), len(b))
    while i < m and a[i] == b[i]:
        i += 1
    j = 0
    while j < m - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


#: Words of up to so many letters are compared many at a time.
WIDTH = 16


def many_edits(pairs: list[tuple[str, str]], most: int = 3) -> list[int]:
    """:func:`edits` of many pairs of words."""
    if len(pairs) > 20_000:
        return [d for i in range(0, len(pairs), 20_000) for d in many_edits(pairs[i : i + 20_000], most)]
    out = np.zeros(len(pairs), np.int64)
    short = np.array([len(a) <= WIDTH and len(b) <= WIDTH for a, b in pairs], bool)
    for i in np.nonzero(~short)[0]:
        out[i] = edits(*pairs[i], most)
    at = np.nonzero(short)[0]
    if not len(at):
        return out.tolist()
    a, b = (np.ascontiguousarray(np.array([pairs[i][s] for i in at], f"U{WIDTH}").view(np.uint32).reshape(-1, WIDTH).T) for s in (0, 1))
    n, m = (np.array([len(pairs[i][s]) for i in at]) for s in (0, 1))
    # Only cells beside the diagonal can hold so few.
    d = np.full((n.max() + 1, m.max() + 1, len(at)), most + 1, np.int8)
    for j in range(min(most, m.max()) + 1):
        d[0, j] = j
    for i in range(1, n.max() + 1):
        if i <= most:
            d[i, 0] = i
        for j in range(max(1, i - most), min(m.max(), i + most) + 1):
            best = np.minimum(np.minimum(d[i - 1, j], d[i, j - 1]) + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1:
                swapped = (a[i - 1] == b[j - 2]) & (a[i - 2] == b[j - 1])
                best = np.where(swapped, np.minimum(best, d[i - 2, j - 2] + 1), best)
            d[i, j] = best
    out[at] = np.minimum(d[n, m, np.arange(len(at))], most + 1)
    return out.tolist()


def agreeing(xs: list[str], ys: list[str]) -> list[bool]:
    """:func:`words_agree` of many pairs of brands, whose words are compared together."""
    split = [sorted((x.split(" "), y.split(" ")), key=len) for x, y in zip(xs, ys)]
    # Brands of very many words are left to the comparison of two.
    met = list({(v, w): None for p, q in split if len(p) * len(q) <= 64 for v in p for w in q})
    known = dict(zip(met, many_edits(met)))
    return [words_agree(x, y, lambda v, w: known[v, w]) if len(p) * len(q) <= 64 else words_agree(x, y) for x, y, (p, q) in zip(xs, ys, split)]


def words_agree(a: str, b: str, apart: Callable[[str, str], int] = lambda v, w: edits(v, w, 3)) -> bool:
    """Whether every word of the shorter brand has its like in the longer: one edit, two in words of eight letters and more, and
    two in all where both have several words. Brands that differ in spaces alone agree too."""
    if a == b or a.replace(" ", "") == b.replace(" ", ""):
        return True
    short, long = sorted((a.split(" "), b.split(" ")), key=len)
    left, spent = list(long), 0
    for w in short:
        like = min(left, key=lambda x: apart(w, x), default=None)
        d = apart(w, like) if like is not None else 3
        spent += d
        if d > 2 or spent > 2 or d > (2 if min(len(w), len(like)) >= 8 else 1 if min(len(w), len(like)) >= 4 else 0):
            return False
        left.remove(like)
    return True


def _read(rows: DataFrame) -> DataFrame:
    """Names and addresses read in one pass: ``id, brand, kinds, first, initials, house, street, kind, direction, city,
    postcode``; addresses that cannot be read are empty; rows without a name are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, placed = lru_cache(100_000)(read_name), lru_cache(100_000)(read_street)
        town, code = lru_cache(50_000)(read_city), lru_cache(50_000)(read_postcode)
        for b in batches:
            cities, codes = list(map(town, b.column("city").to_pylist())), list(map(code, b.column("postcode").to_pylist()))
            names = [named(n) or named(w) for n, w in zip(b.column("name").to_pylist(), b.column("wof").to_pylist())]
            streets, numbers = b.column("street").to_pylist(), b.column("number").to_pylist()
            at = [i for i, n in enumerate(names) if n and (cities[i] or codes[i])]
            parts = list(zip(*[(*names[i], *(placed(streets[i], numbers[i]) or ("", "", "", "")), cities[i], codes[i]) for i in at])) or [[]] * 10
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int32())), *[pa.array(p, pa.string()) for p in parts]], ["id", "brand", "kinds", "first", "initials", "house", "street", "kind", "direction", "city", "postcode"])

    ship(rows.sparkSession)
    strings = ", ".join(f"{c} string" for c in ("brand", "kinds", "first", "initials", "house", "street", "kind", "direction", "city", "postcode"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {strings}")


def gram_weights(brands: DataFrame) -> np.ndarray:
    """The root of the inverse document frequency of each gram over all rows of ``brand``. Partitions send at most one count a gram, and
    the driver holds the 4,096 sums, whatever the number of rows."""
    size = CLASSES * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size + 1, np.int64)
        for b in batches:
            n[size] += b.num_rows
            seen: list[int] = []
            for brand in b.column(0).to_pylist():
                seen += brand_grams(brand)
            n[:size] += np.bincount(np.array(seen, np.int64), minlength=size)
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["gram", "n"])

    n = np.zeros(size + 1, np.int64)
    for r in brands.select("brand").mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        n[r["gram"]] = r["n"]
    return np.sqrt(np.log1p(n[size] / np.maximum(n[:size], 1)))


def _scored(pairs: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """``x, y, sim, sure`` of the pairs of different brands whose cosine reaches the threshold and whose words agree; ``sure``
    ones differ by one edit at most where they are short. One row a pair of brands, wherever and however often it is met."""
    sent = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w2 = (sent.value.astype(np.float64) ** 2).tolist()

        @lru_cache(100_000)
        def vector(brand: str) -> tuple[frozenset[int], float]:
            g = frozenset(brand_grams(brand))
            return g, sum(map(w2.__getitem__, sorted(g))) ** 0.5

        def similar(x: str, y: str) -> float:
            (g, m), (h, n) = vector(x), vector(y)
            cos = sum(map(w2.__getitem__, sorted(g & h))) / (m * n or 1.0)
            return cos if cos >= threshold else 0.0

        for b in batches:
            xs, ys = b.column("x").to_pylist(), b.column("y").to_pylist()
            got = np.array([similar(x, y) if agree else 0.0 for x, y, agree in zip(xs, ys, agreeing(xs, ys))], np.float64)
            kept = np.nonzero(got)[0]
            sure = [min(len(xs[i]), len(ys[i])) >= 9 or edits(xs[i], ys[i], 1) <= 1 for i in kept]
            at = pa.array(kept, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("x").take(at), b.column("y").take(at), pa.array(got[kept], pa.float64()), pa.array(sure, pa.bool_())], ["x", "y", "sim", "sure"])

    return pairs.mapInArrow(run, "x string, y string, sim double, sure boolean")


def _near() -> Column:
    """What holds wherever the words of ``x`` and ``y`` agree: each word of the one with fewer has one in the other within four
    Levenshtein edits (a swap being two of them), or only spaces differ."""
    x, y = F.split("x", " "), F.split("y", " ")
    close = lambda a, b: F.when(F.least(F.length(a), F.length(b)) < 8, F.levenshtein(a, b, 2) >= 0).otherwise(F.levenshtein(a, b, 4) >= 0)
    every = lambda a, b: F.forall(a, lambda v: F.exists(b, lambda w: close(v, w)))
    one = ~F.col("x").contains(" ") & ~F.col("y").contains(" ")
    glued = F.replace(F.col("x"), F.lit(" "), F.lit("")) == F.replace(F.col("y"), F.lit(" "), F.lit(""))
    return F.when(one, close(F.col("x"), F.col("y"))).otherwise(glued | F.when(F.size(x) <= F.size(y), every(x, y)).otherwise(every(y, x)))


def _met_by_entries(sized: DataFrame, brands: DataFrame) -> list[DataFrame]:
    """``a_at, b_at, x, y``: as :func:`_met` gives those near each other, by joins of the entries, for blocks that no task can hold. ``no`` numbers
    the ``brands``: numbers take less room in a shuffle than hashes."""
    return [near for turn in range(TURNS) for near in _met_in_turn(sized.filter(F.pmod(F.xxhash64("block"), F.lit(TURNS)) == turn), brands)]


def _met_in_turn(sized: DataFrame, brands: DataFrame) -> list[DataFrame]:
    sized = spread(sized.select("block", "brand", "asks", "size", F.col("no").alias("at")), "at")
    side = lambda df, s: df.select("entry", *[F.col(c).alias(f"{s}_{c}") for c in ("at", "asks", "found")])
    asking, others = sized.filter("asks"), sized.filter("NOT asks")
    several = lambda df: df.filter(F.col("brand").contains(" "))
    # What a brand is only found under does not meet its like: two brands need not be compared because one word is in both.
    all_ = _indexed(sized.filter(~F.col("brand").contains(" ")), False).unionByName(_indexed(several(sized), True))
    met = side(_indexed(asking, False), "a").hint("shuffle_hash").join(side(all_, "b"), "entry").filter((F.col("a_at") != F.col("b_at")) & (F.col("b_found") | ~F.col("b_asks") | (F.col("a_at") < F.col("b_at"))))
    # Of two brands of several words the one with fewer looks, and of equally many either: only for askers of three is another of several asked.
    long = asking.filter(F.size(F.split("brand", " ")) > 2).select("block").distinct()
    others = others.filter(~F.col("brand").contains(" ")).unionByName(several(others).join(long, "block", "left_semi").select(*others.columns))
    found = side(_indexed(several(asking), True), "a").hint("shuffle_hash").join(side(_indexed(others, False), "b"), "entry").filter(F.col("a_at") != F.col("b_at"))
    named = lambda end, text: brands.select(F.col("no").alias(f"{end}_no"), F.col("at").alias(f"{end}_at"), F.col("brand").alias(text))
    # A pair of which both ask is met from either side.
    turned = F.col("b_asks") & (F.col("a_at") > F.col("b_at"))
    once = F.when(turned, F.col("b_at")).otherwise(F.col("a_at")).alias("a_no"), F.when(turned, F.col("a_at")).otherwise(F.col("b_at")).alias("b_no")
    near = []
    for part in (met, found):
        let_go(brands.sparkSession)
        pairs = part.select(*once).distinct().join(named("a", "x"), "a_no").join(named("b", "y"), "b_no").filter(_near()).select("a_at", "b_at", "x", "y")
        near.append(materialize(pairs, "names-met-brands"))
    return near


def _agreeing() -> Column:
    """Whether kinds and first names of ``a_*`` and ``b_*`` agree: kinds contradict each other unless one name has none or more
    than half of the shorter list is shared; full first names must share one, a full name and initials a letter, initials
    alone likewise."""
    listed = lambda c: F.split(F.col(c), " ")
    shared = lambda c: F.size(F.array_intersect(listed(f"a_{c}"), listed(f"b_{c}")))
    blank = lambda c: (F.col(f"a_{c}") == "") | (F.col(f"b_{c}") == "")
    kinds = blank("kinds") | (2 * shared("kinds") > F.least(F.size(listed("a_kinds")), F.size(listed("b_kinds"))))
    letters = lambda s: F.filter(F.concat(F.transform(listed(f"{s}_first"), lambda w: F.substr(w, F.lit(1), F.lit(1))), F.split(F.col(f"{s}_initials"), "")), lambda c: c != "")
    a, b = letters("a"), letters("b")
    named = F.when(~blank("first"), shared("first") > 0).otherwise((F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b))
    return kinds & named


def _with_outlets(found: DataFrame, nodes: DataFrame, codes: DataFrame, outlets: int) -> DataFrame:
    """``a, b, sim`` of the links ``found`` in a town (``a`` without an address) that do not guess at an outlet. ``codes`` are the
    postcodes seen at each place.

    A node whose name fits those of ``outlets`` or more addresses equally well (the same similarity, kinds and first
    names) may be any of them: of its links to addresses only those to the one outlet of its postcode are kept. Links
    between two nodes without address stay, unless one of them is such a node and their postcodes tell them apart, or only
    one of them has found its address."""
    known = nodes.select("node", "place", "outlet", "zone", "kinds", "first", "initials")
    a, b = (known.select(*[F.col(c).alias(f"{s}_{c}" if c != "node" else s) for c in known.columns]) for s in "ab")
    both = materialize(found.join(a.drop("a_place", "a_outlet"), "a").join(b, "b"), "names-met")
    full = sum(((F.col(f"a_{c}") == F.col(f"b_{c}")).cast("int") for c in ("kinds", "first", "initials")), F.lit(0))
    fits = both.filter("b_place IS NOT NULL").withColumn("fit", F.struct(F.round("sim", 9).alias("sim"), full.alias("full")))
    fits = fits.join(fits.groupBy("a").agg(F.max("fit").alias("best")), "a").filter(F.col("fit") == F.col("best"))
    seen = codes.select(F.col("place").alias("b_place"), F.col("postcode").alias("a_zone"), F.lit(True).alias("here"))
    fits = fits.join(seen, ["b_place", "a_zone"], "left")
    own = F.when(F.col("here"), F.col("b_outlet"))
    fits = fits.groupBy("a").agg(F.count_distinct("b_outlet").alias("n"), F.count_distinct(own).alias("near_n"), F.max(own).alias("near_outlet"))
    state = materialize(fits.select(F.col("a").alias("node"), (F.col("n") >= outlets).alias("chain"), F.when((F.col("n") >= outlets) & (F.col("near_n") == 1), F.col("near_outlet")).alias("home")), "names-outlets")
    for s in "ab":
        both = both.join(state.select(F.col("node").alias(s), F.col("chain").alias(f"{s}_chain"), F.col("home").alias(f"{s}_home")), s, "left")
    chain = {s: F.coalesce(F.col(f"{s}_chain"), F.lit(False)) for s in "ab"}
    settled = {s: F.coalesce(~F.col(f"{s}_chain") | F.col(f"{s}_home").isNotNull(), F.lit(False)) for s in "ab"}
    to_address = ~chain["a"] | F.coalesce(F.col("b_outlet") == F.col("a_home"), F.lit(False))
    blank = (F.col("a_zone") == "") | (F.col("b_zone") == "")
    between = ~(chain["a"] | chain["b"]) | (~blank & (F.col("a_zone") == F.col("b_zone"))) | (blank & ~settled["a"] & ~settled["b"])
    return both.filter(F.when(F.col("b_place").isNotNull(), to_address).otherwise(between)).select("a", "b", "sim")


def match_names(records: DataFrame, key: str = "uid", name: str = "name", other_name: str = "wof:name", street: str = "street", number: str = "number", city: str = "city", postcode: str = "postcode", threshold: float = 0.35, linkage: float = 0.2, outlets: int = 3) -> DataFrame:
    """Pairs ``<key>_a < <key>_b`` of records that name the same venue at one place.

    One row per key is expected (repeated rows repeat their pairs). A record takes part if ``name`` or else ``other_name`` names something and its city or
    postcode is known; null keys, fillers and blanks take part in nothing; names of any length are read whole; equal
    names pair like others; an empty table gives no pairs; further columns are ignored.

    1. Records equal in everything that is read from them become one node. 2. Brands are compared within an address, and
    those of nodes without a readable address with all of their town. They meet in one inverted index of gapped
    character grams by address or town (:func:`index_entries`), searched where a block lies or, if it is too large for a task, joined, which all pairs do on whose words step 3 agrees, however many they are.
    3. Each pair of brands is judged once, wherever it is met: the cosine of the weighted character n-grams must reach ``threshold``
    (a tenth more without an address), then an exact check of the words agree; nodes of agreeing brands are linked if their kinds and first names
    agree too. 4. Links are grouped by average linkage, cut at ``linkage``: records
    without address join the one venue that their name fits best. 5. Pairs of a group are given, unless both have an
    address and these differ.

    A record without an address whose name fits names at ``outlets`` or more addresses of its town equally well may be any of
    them: it goes with the one outlet that shares its postcode, if there is one, and with none otherwise; records without
    address are linked to each other all the same (:func:`_with_outlets`)."""
    rows = records.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(f"`{name}`").alias("name"), F.col(f"`{other_name}`").alias("wof"), F.col(street).alias("street"), F.col(number).alias("number"), F.col(city).alias("city"), F.col(postcode).alias("postcode"))
    read = materialize(_read(rows), "names-read")
    towns = materialize(settled_cities(read), "names-settled")
    discard(read)
    placed = resolved_streets(towns)
    # An address and a node are known by 64-bit hashes of what they consist of.
    lost = F.col("house") == ""
    placed = placed.withColumn("place", F.when(~lost, F.xxhash64("town", "house", "street", "direction")))
    who = ("brand", "kinds", "first", "initials")
    # What tells outlets apart: the number and the street, with or without a letter or a direction.
    placed = placed.withColumn("outlet", F.when(~lost, F.xxhash64("town", F.regexp_extract("house", r"^\d+", 0), "street")))
    placed = placed.select("id", "town", "place", "outlet", "kind", "postcode", *who, F.xxhash64(F.coalesce("place", F.xxhash64("town", "postcode")), "kind", lost, *who).alias("node"))
    placed = materialize(placed, "names-placed")
    discard(towns)

    # A node's members are equal in what was read, so it needs no more than one row.
    zone = F.when(F.col("place").isNull(), F.col("postcode")).alias("zone")
    nodes = materialize(placed.select("node", F.xxhash64("town").alias("town"), "place", "outlet", "kind", zone, *who).distinct(), "names-nodes")
    weights = gram_weights(nodes.select("brand").distinct())

    # A node stands in the block of its address if others do, and in its town's if that has nodes without address, which alone ask there.
    asks = F.col("place").isNull()
    crowded = nodes.filter(~asks).groupBy("place").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("place").alias("block"))
    asking = small_side(nodes.filter(asks).select(F.col("town").alias("block")).distinct(), "names-asking-towns")
    here = nodes.filter(~asks).withColumn("block", F.col("place")).join(crowded, "block", "left_semi").withColumn("asks", F.lit(True))
    there = nodes.withColumn("block", F.col("town")).join(asking, "block", "left_semi").withColumn("asks", asks)
    stands = here.unionByName(there).select("node", "place", "kind", *who, "block", "asks", F.xxhash64("block", "brand").alias("at"))
    stands = materialize(stands, "names-blocks")
    # Written once, so their numbers stay; numbers take less room in a shuffle than hashes.
    brands = materialize(stands.groupBy("at", "block", "brand").agg(F.max("asks").alias("asks")).withColumn("no", F.monotonically_increasing_id()), "names-brands")
    # The more brands a block has, the longer the grams: those that meet by chance stay about as many.
    sizes = brands.groupBy("block").agg(F.count("*").alias("k")).select("block", "k", F.greatest(F.ceil(F.log(8.0, F.col("k"))) + 2, F.lit(3)).cast("bigint").alias("size"))
    sizes = materialize(sizes.filter("k > 1"), "names-block-sizes")
    # A lone brand has no like; few ones, as at most addresses, are paired outright, which is less work than their entries are.
    few = brands.join(sizes.filter(f"k <= {FEW}"), "block")
    x, y = (few.select("block", F.col("at").alias(f"{s}_at"), F.col("asks").alias(f"{s}_asks"), F.col("brand").alias(t)).hint("merge") for s, t in (("a", "x"), ("b", "y")))
    let_go(brands.sparkSession)
    near = [materialize(x.join(y, "block").filter((F.col("a_at") < F.col("b_at")) & (F.col("a_asks") | F.col("b_asks")) & _near()).select("a_at", "b_at", "x", "y"), "names-met-brands")]
    sized = brands.join(sizes.filter(f"k > {FEW}"), "block").select("block", "brand", "asks", "size", "k", "at", "no")
    near.append(materialize(_met(sized.filter(f"k <= {MOST}")).filter(_near()), "names-met-brands"))
    if not sizes.filter(f"k > {MOST}").isEmpty():
        near += _met_by_entries(sized.filter(f"k > {MOST}"), brands)
    let_go(brands.sparkSession)
    met = reduce(DataFrame.unionByName, near).distinct()
    both_ways = F.struct(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).alias("p")
    alike = _scored(spread(met.select(both_ways).distinct().select("p.*"), "x", "y"), weights, threshold)
    met = met.withColumn("p", both_ways).select("a_at", "b_at", "p.x", "p.y").join(materialize(alike, "names-alike"), ["x", "y"]).select("a_at", "b_at", "sim", "sure")
    # Either brand may have nodes that ask.
    met = met.unionByName(met.select(F.col("b_at").alias("a_at"), F.col("a_at").alias("b_at"), "sim", "sure"))
    # Equal brands of a block are its nodes' own affair.
    equal = stands.select(F.col("at").alias("a_at"), F.col("at").alias("b_at"), F.lit(1.0).alias("sim"), F.lit(True).alias("sure")).distinct()
    side = lambda s: stands.select(*[F.col(c).alias(f"{s}_{c}") for c in ("at", "node", "place", "kind", "asks", *who[1:])])
    pairs = met.unionByName(equal).join(side("a").filter("a_asks"), "a_at").join(side("b"), "b_at")
    pairs = pairs.filter((~F.col("b_asks") | (F.col("a_node") < F.col("b_node"))) & (F.col("a_node") != F.col("b_node")) & _agreeing())
    streets = (F.col("a_kind") == F.col("b_kind")) | (F.col("a_kind") == "") | (F.col("b_kind") == "")
    home = F.col("a_place").isNotNull()
    pairs = pairs.filter(F.when(home, streets).otherwise(F.col("sure") & (F.col("sim") >= threshold + 0.1)))
    pairs = materialize(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "sim", home.alias("home")), "names-linked")
    discard(stands, brands)
    codes = placed.filter("place IS NOT NULL AND postcode <> ''").select("place", "postcode").distinct()
    links = pairs.filter("home").select("a", "b", "sim").unionByName(_with_outlets(pairs.filter("NOT home").select("a", "b", "sim"), nodes, codes, outlets))
    groups = average_linkage(materialize(links, "names-links"), linkage)

    member = placed.select("id", "node", "place", "kind").join(groups, "node", "left").withColumn("venue", F.coalesce("cluster", "node"))
    a, b = (member.select("venue", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "place", "kind")]) for s in "ab")
    agree = (F.col("a_place") == F.col("b_place")) & ((F.col("a_kind") == F.col("b_kind")) | (F.col("a_kind") == "") | (F.col("b_kind") == ""))
    pairs = a.join(b, "venue").filter((F.col("a_id") < F.col("b_id")) & F.coalesce(agree, F.lit(True)))
    return pairs.select(F.col("a_id").alias(f"{key}_a"), F.col("b_id").alias(f"{key}_b"))
