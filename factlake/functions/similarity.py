"""Similarities of strings and numbers. Where Spark has no function, an Arrow UDF with a plain twin that tests use.

Every dis_* and sim_* gives 0 if either text is empty, and null if either is null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insert, delete, replace, swap neighbours."""
    last: dict[str, int] = {}
    big = len(a) + len(b)
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            cost = a[i - 1] != b[j - 1]
            if not cost:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[-1][-1]


def hamming(a: str, b: str) -> int:
    """Places that differ; the longer text's excess counts."""
    return sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, ma = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                ma.append(x)
                break
    if not ma:
        return 0.0
    mb = [b[j] for j, u in enumerate(used) if u]
    m, half = len(ma), sum(x != y for x, y in zip(ma, mb)) // 2  # a swap is two places; an odd one is none
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with 0.1 for each of up to four common first letters, where Jaro is above 0.7."""
    s = jaro(a, b)
    if s <= 0.7:
        return s
    n = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        n += 1
    return s + 0.1 * n * (1 - s)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with whole rows as bits of one number."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & at.get(y, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """1 - insert/delete distance over both lengths."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


def _letters(texts: np.ndarray, size: np.ndarray, width: int, pad: int) -> np.ndarray:
    """Letters as numbers, a row a place, so that a step reads one row."""
    x = texts.astype(f"U{width}").view(np.uint32).reshape(len(texts), width)
    return np.ascontiguousarray(np.where(np.arange(width) < size[:, None], x, np.uint32(pad)).T)


def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio() of many pairs at once, a place of all texts at a time; beyond 63 letters one by one."""
    x, y = a.to_numpy(object), b.to_numpy(object)
    out = np.full(len(x), np.nan)
    known = np.flatnonzero(~(pd.isna(x) | pd.isna(y)))
    x, y = x[known], y[known]
    m, n = (np.fromiter(map(len, t), np.int64, len(t)) for t in (x, y))
    longer, found = np.maximum(m, n), np.zeros(len(known))
    for low, high in ((0, 16), (16, 32), (32, 63)):
        at = np.flatnonzero((longer > low) & (longer <= high))
        if not len(at):
            continue
        p, q = _letters(x[at], m[at], m[at].max() or 1, 0xFFFFFFFF), _letters(y[at], n[at], n[at].max() or 1, 0xFFFFFFFE)
        full = (np.uint64(1) << m[at].astype(np.uint64)) - np.uint64(1)
        s = full.copy()
        for letter in q:
            same = np.zeros(len(at), np.uint64)
            for i, own in enumerate(p):
                same |= (own == letter).astype(np.uint64) << np.uint64(i)
            u = s & same
            s = (s + u | s - u) & full
        found[at] = 2 * (m[at] - np.bitwise_count(s)) / (m[at] + n[at])
    for i in np.flatnonzero(longer > 63):
        found[i] = ratio(x[i], y[i])
    out[known] = found
    return pd.Series(out)


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of its length over the longer one, cut at the ends too."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    return max((ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b))), default=0.0) if a else 0.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio of the common words, and the common words with the rest of either text; 1 if one text's words hold the other's."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    if not x or not y:
        return 0.0
    if both and (x <= y or y <= x):
        return 1.0
    xa, ya = (f"{both} {' '.join(sorted(z))}".strip() for z in (x - y, y - x))
    return max(ratio(xa, ya), ratio(both, xa), ratio(both, ya))


def weighted_ratio(a: str, b: str) -> float:
    """Ratio for texts of similar length, else the better of partial and token ratios, discounted."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    base, tokens = ratio(a, b), max(token_sort_ratio(a, b), token_set_ratio(a, b))
    if longer < 1.5:
        return max(base, 0.95 * tokens)
    scale = 0.9 if longer < 8 else 0.6
    return max(base, scale * partial_ratio(a, b), 0.95 * scale * max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), tokens))


def blend(a: str, b: str, w: tuple[float, float, float, float] = (1, 1, 1, 1)) -> float:
    """Weighted mean of ratio, partial ratio, token sort ratio and token set ratio."""
    return sum(x * f(a, b) for x, f in zip(w, (ratio, partial_ratio, token_sort_ratio, token_set_ratio))) / sum(w)


def _udf(f: Callable, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}

        def one(x, y):
            if x is None or y is None:
                return None
            if not x or not y:
                return 0
            if (x, y) not in known:
                known[x, y] = f(x, y)
            return known[x, y]

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="object")

    return run


def _ratios_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return ratios(a, b)


dis_damerau, dis_hamming = _udf(damerau, T.IntegerType()), _udf(hamming, T.IntegerType())
sim_jaro, sim_jaro_winkler, sim_ratio = _udf(jaro, T.DoubleType()), _udf(jaro_winkler, T.DoubleType()), F.pandas_udf(_ratios_udf, T.DoubleType())
sim_partial, sim_token_sort, sim_token_set = _udf(partial_ratio, T.DoubleType()), _udf(token_sort_ratio, T.DoubleType()), _udf(token_set_ratio, T.DoubleType())
sim_weighted, sim_blend = _udf(weighted_ratio, T.DoubleType()), _udf(blend, T.DoubleType())


def dis_levenshtein(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(F.levenshtein(a, b))


def sim_change(a: Column, b: Column) -> Column:
    """1 - |a-b| / max(|a|, |b|); both 0 give 1; what is no number gives 0."""
    x, y = a.try_cast("double"), b.try_cast("double")
    top = F.when(x.isNotNull() & y.isNotNull(), F.greatest(F.abs(x), F.abs(y)))
    return F.coalesce(F.when(top == 0, F.lit(1.0)).otherwise(1 - F.abs(x - y) / top), F.lit(0.0))
