"""Weighted edit distance: substitutions of 0, 35, 70 or 100, insertions, deletions and swaps of 100."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexmill.profile import BASE_COST, CHEAP_COST, NEIGHBOUR_COST, YAKUT, LanguageProfile


@lru_cache(maxsize=8)
def _tables(cheap: str, keyboard: tuple[str, ...]) -> tuple[dict[str, int], np.ndarray]:
    """(letter -> row, costs); the last row stands for every letter without a price of its own."""
    close: dict[tuple[str, str], int] = {}
    for r, row in enumerate(keyboard):
        for i, a in enumerate(row):
            beside = [(r, i - 1), (r, i + 1), *[(q, j) for q in (r - 1, r + 1) for j in (i - 1, i, i + 1)]]
            close |= {(a, keyboard[q][j]): NEIGHBOUR_COST for q, j in beside if 0 <= q < len(keyboard) and 0 <= j < len(keyboard[q])}
    close |= {p: CHEAP_COST for a, b in cheap.split() for p in ((a, b), (b, a))}
    letters = {c: k for k, c in enumerate(sorted({c for p in close for c in p}))}
    costs = np.full((len(letters) + 1,) * 2, BASE_COST)
    for (a, b), c in close.items():
        costs[letters[a], letters[b]] = c
    return letters, costs


@lru_cache(maxsize=8)
def _rows(cheap: str, keyboard: tuple[str, ...]) -> np.ndarray:
    """Row of each code point in the costs."""
    letters = _tables(cheap, keyboard)[0]
    out = np.full(0x110000, len(letters), np.int16)
    out[[ord(c) for c in letters]] = list(letters.values())
    return out


def substitution(a: str, b: str, profile: LanguageProfile = YAKUT) -> int:
    letters, costs = _tables(profile.cheap, profile.keyboard)
    return 0 if a == b else int(costs[letters.get(a, -1), letters.get(b, -1)])


def neighbours(letter: str, profile: LanguageProfile = YAKUT) -> list[str]:
    """Letters beside it on the keyboard, in order."""
    return [c for c in sorted({c for row in profile.keyboard for c in row}) if c != letter and letter in "".join(profile.keyboard) and _beside(letter, c, profile.keyboard)]


@lru_cache(maxsize=4096)
def _beside(a: str, b: str, keyboard: tuple[str, ...]) -> bool:
    at = {c: (r, i) for r, row in enumerate(keyboard) for i, c in enumerate(row)}
    (r, i), (q, j) = at[a], at[b]
    return (r == q and abs(i - j) == 1) or (abs(r - q) == 1 and abs(i - j) <= 1)


def distance(a: str, b: str, profile: LanguageProfile = YAKUT) -> int:
    """Restricted: a swapped pair is not edited again."""
    return int(distances([a], [b], profile)[0])


def distances(a: list[str], b: list[str], profile: LanguageProfile = YAKUT) -> np.ndarray:
    """Costs of many pairs at once: one table for each pair of lengths, in which every cell is a vector over pairs."""
    letters, costs = _tables(profile.cheap, profile.keyboard)
    row_of = _rows(profile.cheap, profile.keyboard)
    out = np.zeros(len(a), np.int64)
    shape = pd.DataFrame({"m": [len(x) for x in a], "n": [len(x) for x in b]}).groupby(["m", "n"]).indices
    for (m, n), rows in shape.items():
        x, y = (np.frombuffer("".join([s[r] for r in rows]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), k) for s, k in ((a, m), (b, n)))
        kx, ky = row_of[x], row_of[y]
        before: list[np.ndarray] = []
        last = [np.full(len(rows), BASE_COST * j) for j in range(n + 1)]
        for i in range(1, m + 1):
            row = [np.full(len(rows), BASE_COST * i)]
            for j in range(1, n + 1):
                sub = np.where(x[:, i - 1] == y[:, j - 1], 0, costs[kx[:, i - 1], ky[:, j - 1]])
                best = np.minimum(np.minimum(last[j], row[j - 1]) + BASE_COST, last[j - 1] + sub)
                if i > 1 and j > 1:
                    swap = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                    best = np.where(swap, np.minimum(best, before[j - 2] + BASE_COST), best)
                row.append(best)
            before, last = last, row
        out[rows] = last[n]
    return out


def distances_within(a: list[str], b: list[str], most: int, profile: LanguageProfile = YAKUT) -> np.ndarray:
    """The same costs where they are at most `most`, and anything above it elsewhere. A letter more or less costs a whole
    edit, so only `most` // BASE_COST diagonals beside the main one count. Pairs of all lengths share one table, those of
    long words in smaller lots."""
    size = np.array([len(x) for x in a], np.int64)
    out = np.empty(len(a), np.int64)
    order, at = np.argsort(-size, kind="stable"), 0
    while at < len(order):
        lot = order[at : at + max(1, 4_000_000 // (int(size[order[at]]) + 1))]
        out[lot] = _banded([a[r] for r in lot], [b[r] for r in lot], most // BASE_COST, profile)
        at += len(lot)
    return out


def _codes(words: list[str], row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, code points and rows of costs, letters down and words across."""
    n = np.array([len(x) for x in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.arange(int(n.max(initial=0)))[None, :] < n[:, None]
    points, rows = np.zeros(used.shape, np.uint32), np.full(used.shape, row_of[0], np.int16)
    points[used], rows[used] = flat, row_of[flat]
    return n, np.ascontiguousarray(points.T), np.ascontiguousarray(rows.T)


def _banded(a: list[str], b: list[str], width: int, profile: LanguageProfile) -> np.ndarray:
    """a by falling length: those that a row of the table concerns come first."""
    costs, row_of, far = _tables(profile.cheap, profile.keyboard)[1], _rows(profile.cheap, profile.keyboard), 10**6
    m, x, kx = _codes(a, row_of)
    n, y, ky = _codes(b, row_of)
    out = np.full(len(a), far, np.int64)
    near = np.abs(m - n) <= width
    out[(m == 0) & near] = BASE_COST * n[(m == 0) & near]
    diagonals = range(-width, width + 1)
    last = {d: np.full(len(a), BASE_COST * d if d >= 0 else far, np.int64) for d in diagonals}
    before: dict[int, np.ndarray] = {}
    for i in range(1, len(x) + 1):
        live = int(np.searchsorted(-m, -i, side="right"))
        row: dict[int, np.ndarray] = {}
        for d in diagonals:
            j = i + d
            if j < 0 or j > len(y):
                row[d] = np.full(live, far, np.int64)
                continue
            if j == 0:
                row[d] = np.full(live, BASE_COST * i, np.int64)
                continue
            p, q = x[i - 1, :live], y[j - 1, :live]
            best = last[d][:live] + np.where(p == q, 0, costs[kx[i - 1, :live], ky[j - 1, :live]])
            if d < width:
                best = np.minimum(best, last[d + 1][:live] + BASE_COST)
            if d > -width:
                best = np.minimum(best, row[d - 1] + BASE_COST)
            if i > 1 and j > 1:
                swap = (p == y[j - 2, :live]) & (x[i - 2, :live] == q)
                best = np.where(swap, np.minimum(best, before[d][:live] + BASE_COST), best)
            row[d] = best
        done = np.flatnonzero((m[:live] == i) & near[:live])
        for d in diagonals:
            some = done[n[done] - i == d]
            out[some] = row[d][some]
        before, last = last, row
    return out


def distance_column(a: Column, b: Column, profile: LanguageProfile = YAKUT, most: int | None = None) -> Column:
    """The costs; with `most`, only those up to it are right, which takes much less time."""

    @F.pandas_udf("int")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        made = distances(x.tolist(), y.tolist(), profile) if most is None else distances_within(x.tolist(), y.tolist(), most, profile)
        return pd.Series(made).astype("int32")

    # else a filter on the cost is pushed below what makes pairs distinct, and pairs are priced twice
    return of.asNondeterministic()(a, b)


def word_errors(ref: list[str], hyp: list[str]) -> int:
    """Levenshtein distance of two lists: one step a word of the second, on as many bits as the first has words."""
    at, n = 0, min(len(ref), len(hyp))
    while at < n and ref[at] == hyp[at]:
        at += 1
    end = 0
    while end < n - at and ref[-1 - end] == hyp[-1 - end]:
        end += 1
    ref, hyp = ref[at : len(ref) - end], hyp[at : len(hyp) - end]
    if not ref or not hyp:
        return len(ref) + len(hyp)
    where: dict[str, int] = {}
    for i, w in enumerate(ref):
        where[w] = where.get(w, 0) | (1 << i)
    full, top, errors = (1 << len(ref)) - 1, 1 << (len(ref) - 1), len(ref)
    up, down = full, 0
    for w in hyp:
        equal = where.get(w, 0)
        xv = equal | down
        xh = (((equal & up) + up) ^ up) | equal
        more, less = down | (full & ~(xh | up)), up & xh
        errors += bool(more & top) - bool(less & top)
        more, less = ((more << 1) | 1) & full, (less << 1) & full
        up, down = less | (full & ~(xv | more)), more & xv
    return errors


@F.pandas_udf(StructType([StructField("errors", IntegerType()), StructField("words", IntegerType())]))
def wer_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Word-level Levenshtein distance of two arrays of words, and the number of words of the first; null is no words."""
    rows = ((() if r is None else r, () if h is None else h) for r, h in zip(ref, hyp, strict=True))
    return pd.DataFrame([(word_errors(list(r), list(h)), len(r)) for r, h in rows], columns=["errors", "words"]).astype("int32")
