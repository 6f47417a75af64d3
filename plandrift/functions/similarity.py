"""Text similarity by the longest common subsequence.

The subsequence's length comes from a vectorised bit-parallel recurrence in an Arrow function: a fold of built-in
functions gives the same number, but is interpreted and takes many times as long for each pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """The length of the longest common subsequence, for texts of any length."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """lcs of each pair; pairs of up to 62 characters all at once."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([max(len(x), len(y)) for x, y in zip(a, b)])
    for k in np.flatnonzero(sizes > 62):
        out[k] = lcs(a[k], b[k])
    short = np.flatnonzero((sizes > 0) & (sizes <= 62))
    if len(short):
        n = int(sizes[short].max())
        codes = lambda texts, pad: np.array([t.ljust(n, pad) for t in texts], f"U{n}").view(np.uint32).reshape(-1, n)
        one, two = codes([a[k] for k in short], ""), codes([b[k] for k in short], "")
        bits = np.uint64(1) << np.arange(n, dtype=np.uint64)
        lengths = np.array([len(a[k]) for k in short], np.uint64)
        full = (np.uint64(1) << lengths) - np.uint64(1)
        s = full.copy()
        for j in range(n):
            u = s & ((one == two[:, j : j + 1]) * bits).sum(axis=1, dtype=np.uint64)
            s = ((s + u) | (s - u)) & full
        out[short] = lengths.astype(np.int64) - np.bitwise_count(s)
    return out


@F.pandas_udf(T.IntegerType())
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(lcs_many(a.fillna("").tolist(), b.fillna("").tolist()).astype(np.int32))


def ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (sum of lengths), 100 for two empty texts."""
    total, differ = F.length(a) + F.length(b), a != b
    return F.when(a == b, 100.0).otherwise(200.0 * common(F.when(differ, a), F.when(differ, b)) / total)  # equal texts cross no border


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio among the sorted shared words alone, with one side's other words, and with the other's."""
    words = lambda t: F.array_sort(F.array_distinct(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")))
    one, two = words(a), words(b)
    both = F.array_intersect(one, two)
    only_a, only_b = F.array_join(F.array_except(one, two), " "), F.array_join(F.array_except(two, one), " ")
    s, la, lb = F.length(F.array_join(both, " ")), F.length(only_a), F.length(only_b)
    gap = F.when(s > 0, 1).otherwise(0)
    sa, sb = s + gap + la, s + gap + lb
    apart = la + lb - 2 * common(only_a, only_b)
    part = lambda length, sum_: F.when(s > 0, 1.0 - (gap + length) / (s + sum_)).otherwise(0.0)
    best = F.greatest(1.0 - apart / F.greatest(sa + sb, F.lit(1)), part(la, sa), part(lb, sb))
    return F.when((F.size(one) == 0) | (F.size(two) == 0), 0.0).when((s > 0) & ((la == 0) | (lb == 0)), 100.0).otherwise(100.0 * best)


def _partial(a: str, b: str) -> float:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best = len(a), 0.0
    for k in range(1 - n, len(b)):
        part = b[max(0, k) : k + n]
        best = max(best, 200.0 * lcs(a, part) / (n + len(part)))
    return best


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of the shorter text with the best window of the longer one."""
    return pd.Series([_partial(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
