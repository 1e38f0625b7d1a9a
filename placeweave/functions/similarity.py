"""Soft similarity of scored token lists. Spark has no Jaro-Winkler, so this is the one place of the core that runs Python,
over Arrow batches, with remembered token pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str) -> float:
    """Jaro's similarity, raised by a tenth of the rest for each of up to four equal leading letters."""
    if a == b:
        return 1.0 if a else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    m, theirs = len(mine), [y for y, t in zip(b, taken) if t]
    half_swaps = sum(x != y for x, y in zip(mine, theirs))
    jaro = (m / len(a) + m / len(b) + (m - half_swaps // 2) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def soft_tfidf(theta: float = 0.95, sim: Callable[[str, str], float] = jaro_winkler) -> Callable[[Column, Column, Column, Column], Column]:
    """A column function of (tokens, scores, tokens, scores). Each token of the shorter list (the first, if equally long)
    is matched with the most similar of the longer, of equal ones the last; matches of at least ``theta`` add similarity
    x score x score. Null if a list is null; 0 if one is empty. ``sim`` can be replaced."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = lru_cache(200_000)(sim)
        for t1, s1, t2, s2 in batches:
            out = []
            for a, v, b, w in zip(t1, s1, t2, s2):
                if a is None or b is None:
                    out.append(None)
                    continue
                if len(a) > len(b):
                    a, v, b, w = b, w, a, v
                total = 0.0
                for x, p in zip(a, v):
                    best, q = max(((known(x, y), j) for j, y in enumerate(b)), default=(0.0, -1))
                    if best >= theta:
                        total += best * p * w[q]
                out.append(total)
            yield pd.Series(out, dtype="float64")

    return run
