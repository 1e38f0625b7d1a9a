"""Subject areas of documents: weighted terms, truncated SVD, cosine to seed centroids refined iteratively."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.session import ship

#: Labelled documents the model is fitted on, at most; the least by a hash of their key.
MAX_EXAMPLES = 4000
_PARAGRAPH = re.compile(r"^[^\S\n]*(?:¶[^\S\n]*\d{1,3}\.?|\[\d{1,3}\]|\(\d{1,3}\)|\d{1,3}[.)]|\d{1,3}[^\S\n]*[–—-])(?=\s)", re.M)
_WORD = re.compile(r"[^\W\d_]{3,}")
_BROKEN = re.compile(r"(?<=[^\W\d_])-\n\s*(?=[^\W\d_])")
_SENTENCE = re.compile(r"(?<=[.;!?])\s+")
# How a text says that it mentions something in passing, and common words of three languages.
_PASSING = ["illustration", "beispielhaft", "beispielsweise", "by way of example", "for example", "zum beispiel", "par exemple", "à titre d'exemple", "obiter"]
_COMMON = {"en": frozenset("the and that was with not for from had but which".split()), "de": frozenset("der die das und nicht ist den dem ein eine auf von".split()), "fr": frozenset("les des est que une pas dans pour par sur qui".split())}


def paragraphs(text: str | None) -> list[list[str]]:
    """The words of each numbered paragraph, lower-cased, without sentences that say they only illustrate.

    A paragraph starts at a line that begins with a number in one of the usual forms and ends at the next; what stands
    before the first (heading, headnotes) belongs to none. Entities and compatibility forms are resolved, hyphens at line
    ends are closed."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\xad" in text:
        text = text.replace("\xad", "")
    if "-\n" in text:
        text = _BROKEN.sub("", text)
    starts = [m.end() for m in _PARAGRAPH.finditer(text)]
    passing = any(p in text for p in _PASSING)
    out = []
    for a, b in zip(starts, [*starts[1:], len(text)]):
        part = text[a:b]
        if passing and any(p in part for p in _PASSING):
            part = " ".join(s for s in _SENTENCE.split(part) if not any(p in s for p in _PASSING))
        out.append(_WORD.findall(part))
    return out


def language(words: list[str]) -> str:
    """Which language's common words are most frequent; of equal ones the first."""
    return max(_COMMON, key=lambda k: sum(w in _COMMON[k] for w in words))


@dataclass
class Model:
    """``terms`` to rows of ``vectors`` (weight x loadings), ``weights`` alone, unit ``centroids`` with their subject's
    number, the least cosine and the least sum of weights of a paragraph that is about a subject."""

    terms: dict[str, int]
    vectors: np.ndarray
    weights: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    subjects: list[str]
    least_cosine: float = 0.0
    least_weight: float = 0.0

    def scores(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Per paragraph the cosine to each subject (its nearest centroid's) and the sum of its terms' weights."""
        # Row 0 stands for no term.
        get, at, ids = self.terms.get, [0], []
        for p in parts:
            ids += filter(None, map(get, p))
            at.append(len(ids))
        # Sums over slices by differences of running sums: a paragraph without known terms sums to nothing.
        rows = np.zeros((len(ids) + 1, self.vectors.shape[1]))
        np.cumsum(self.vectors[ids], axis=0, out=rows[1:])
        mass = np.concatenate([[0.0], np.cumsum(self.weights[ids])])
        v, m = rows[at[1:]] - rows[at[:-1]], mass[at[1:]] - mass[at[:-1]]
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        cos = (v / np.where(norm > 1e-9, norm, 1.0)) @ self.centroids.T
        best = np.full((len(parts), len(self.subjects)), -1.0)
        for c, s in enumerate(self.owner):
            best[:, s] = np.maximum(best[:, s], cos[:, c])
        return best, m

    def about(self, text: str | None, least: int = 2) -> list[str]:
        """The subjects that at least ``least`` numbered paragraphs are about."""
        parts = paragraphs(text)
        if len(parts) < least:
            return []
        cos, mass = self.scores(parts)
        first = cos.argmax(axis=1)
        good = (cos.max(axis=1) >= self.least_cosine) & (mass >= self.least_weight)
        n = np.bincount(first[good], minlength=len(self.subjects))
        return [self.subjects[s] for s in np.nonzero(n >= least)[0]]


def _corpus_frequencies(documents: DataFrame, text: str, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of the vocabulary occurs, and their number. A task sends a count per term."""
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        n = np.zeros(len(index) + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                n[-1] += 1
                if t:
                    n[[index[w] for w in index.keys() & set(_WORD.findall(t.lower()))]] += 1
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["i", "n"])

    n = np.zeros(len(vocabulary) + 1, np.int64)
    for r in documents.select(text).mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        n[r["i"]] = r["n"]
    return n[:-1], int(n[-1])


def fit(documents: DataFrame, examples: DataFrame, key: str = "doc_id", text: str = "text", subject: str = "subject", max_examples: int = MAX_EXAMPLES, rank: int = 48, rounds: int = 6, seed: int = 7) -> Model:
    """The model from at most ``max_examples`` labelled documents (the least by a hash of the key) and from the terms'
    frequencies in all documents.

    A term weighs its inverse document frequency times how much its paragraphs' subjects differ from the overall mix
    (smoothed, so that rare words and single wrong labels weigh little). The labelled paragraphs' weighted terms are
    embedded by a truncated SVD (randomised, with power iterations). Each subject starts with the mean of the
    paragraphs of its documents in each language; rounds reassign each paragraph to the nearest of its document's
    subjects, leave out those that are near none, and take the means anew. The least cosine and weight are those with the
    best F-measure against the labels. Without any labelled document nothing has a subject."""
    wanted = examples.filter(F.col(key).isNotNull() & F.col(subject).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(subject)).alias("subjects"))
    wanted = wanted.orderBy(F.xxhash64(key), key).limit(max_examples)
    labelled = [(r["subjects"], paragraphs(r[text])) for r in documents.select(key, text).join(F.broadcast(wanted), key).orderBy(key).collect()]
    labelled = [x for x in labelled if x[1]]
    subjects = sorted({s for ss, _ in labelled for s in ss})
    if not labelled:
        return Model({}, np.zeros((0, 1)), np.zeros(0), np.zeros((0, 1)), np.zeros(0, int), [])
    number = {s: i for i, s in enumerate(subjects)}
    seen: dict[str, np.ndarray] = {}
    mix = np.zeros(len(subjects))
    in_docs: Counter = Counter()
    for ss, parts in labelled:
        share = np.zeros(len(subjects))
        share[[number[s] for s in ss]] = 1 / len(ss)
        mix += share
        for w in {w for p in parts for w in p}:
            in_docs[w] += 1
            if w in seen:
                seen[w] += share
            else:
                seen[w] = share.copy()
    mix = (mix + 1e-9) / (mix + 1e-9).sum()
    vocabulary = sorted(w for w, n in in_docs.items() if n >= 3)
    counts = np.array([seen[w] for w in vocabulary]).reshape(len(vocabulary), len(subjects))
    alpha = 4.0
    p = (counts + alpha * mix) / (counts.sum(axis=1, keepdims=True) + alpha)
    tells = (p * np.log(p / mix)).sum(axis=1)
    df, total = _corpus_frequencies(documents, text, vocabulary)
    weight = tells * np.log1p(total / np.maximum(df, 1))
    # A term is kept if it tells a ninth of what a term of a single subject would.
    kept = tells >= 0.11 * np.log(max(len(subjects), 2))
    vocabulary, weight = [w for w, k in zip(vocabulary, kept) if k], weight[kept]
    terms = {w: i for i, w in enumerate(vocabulary)}

    parts = [(d, [terms[w] for w in p if w in terms], p) for d, (_, ps) in enumerate(labelled) for p in ps]
    parts = [x for x in parts if x[1]]
    size, rank = len(vocabulary), max(1, min(rank, len(vocabulary)))
    rng = np.random.default_rng(seed)
    basis = rng.standard_normal((size, min(size, rank + 8)))
    if parts:
        for _ in range(3):
            product = np.zeros_like(basis)
            for i in range(0, len(parts), 1024):
                block = np.zeros((len(parts[i : i + 1024]), size))
                for k, (_, ids, _) in enumerate(parts[i : i + 1024]):
                    np.add.at(block[k], ids, weight[ids])
                block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-12)
                product += block.T @ (block @ basis)
            basis, strength, _ = np.linalg.svd(product, full_matrices=False)
    loadings = basis[:, :rank]
    vectors = np.vstack([np.zeros((1, loadings.shape[1])), weight[:, None] * loadings])
    units = np.array([vectors[1:][ids].sum(axis=0) for _, ids, _ in parts]).reshape(len(parts), loadings.shape[1])
    units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-12)
    tongue = [language([w for p in ps for w in p]) for _, ps in labelled]
    owners = [(s, t) for s in range(len(subjects)) for t in _COMMON]
    at = {o: i for i, o in enumerate(owners)}
    choice = [[at[number[s], tongue[d]] for s in labelled[d][0]] for d, _, _ in parts]
    centroids = np.zeros((len(owners), units.shape[1]))
    for r in range(rounds):
        sums = np.zeros_like(centroids)
        for u, cs in zip(units, choice):
            if r == 0:
                sums[cs] += u / len(cs)
            else:
                near = centroids[cs] @ u
                if near.max() >= 0.3 and (centroids @ u).max() <= near.max() + 0.15:
                    sums[cs[int(near.argmax())]] += u
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    model = Model({w: i + 1 for w, i in terms.items()}, vectors, np.concatenate([[0.0], weight]), centroids, np.array([s for s, _ in owners]), subjects)

    scored = [model.scores(ps) for _, ps in labelled]
    top = [(c.argmax(axis=1), c.max(axis=1), m) for c, m in scored]
    masses = np.concatenate([m for _, m in scored])
    best = (-1.0, 0.0, 0.0)
    for least_weight in [0.0, *np.quantile(masses[masses > 0], np.arange(0.02, 0.5, 0.04))] if (masses > 0).any() else [0.0]:
        for least_cosine in np.arange(0.2, 0.9, 0.05):
            hit = said = 0
            for (first, cos, mass), (ss, _) in zip(top, labelled):
                n = np.bincount(first[(cos >= least_cosine) & (mass >= least_weight)], minlength=len(subjects))
                got = {subjects[s] for s in np.nonzero(n >= 2)[0]}
                hit, said = hit + len(got & set(ss)), said + len(got) + len(ss)
            best = max(best, (2 * hit / max(said, 1), float(least_weight), float(least_cosine)))
    model.least_weight, model.least_cosine = best[1], best[2]
    return model


def assign(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """``key, subject`` for each subject that at least ``least`` numbered paragraphs of a document are about.

    Null keys, null, empty and blank texts, and texts without numbered paragraphs have no subject; texts of any length are
    read whole; repeated rows give one result. Each document is judged by itself: no shuffle but for distinctness."""
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = partial(sent.value.about, least=least)
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                found = [about(t) for t in part.column(1).to_pylist()] if sent.value.subjects else [[] for _ in range(part.num_rows)]
                again = pa.array([i for i, s in enumerate(found) for _ in s], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(again), pa.array([s for ss in found for s in ss], pa.string())], [key, "subject"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).filter(F.col(key).isNotNull()).mapInArrow(run, f"`{key}` {kind}, subject string").distinct()
