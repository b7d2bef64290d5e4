"""Alignment of token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def align(s: list[str], t: list[str], match: float = 1.0, mismatch: float = -0.2, gap: float = -0.01) -> tuple[list[str], list[str], float]:
    """Two rows of equal length with ``-`` for gaps, and the corner's score.

    Cells are floored at zero, borders are not, and the trace runs from corner to corner; single precision throughout.
    """
    one = np.float32
    m, n = len(s), len(t)
    grid = np.zeros((m + 1, n + 1), np.float32)
    for i in range(1, m + 1):
        grid[i, 0] = one(gap) * one(i)
    for j in range(1, n + 1):
        grid[0, j] = one(gap) * one(j)
    codes = {x: i for i, x in enumerate(dict.fromkeys([*s, *t]))}
    same = np.array([codes[x] for x in s])[:, None] == np.array([codes[x] for x in t])[None, :] if m and n else np.zeros((m, n), bool)
    cost = np.where(same, one(match), one(mismatch))
    # cells of one anti-diagonal depend on the two before it only
    for d in range(2, m + n + 1):
        i = np.arange(max(1, d - n), min(m, d - 1) + 1)
        j = d - i
        best = np.maximum(grid[i - 1, j] + one(gap), grid[i, j - 1] + one(gap))
        grid[i, j] = np.maximum(np.maximum(best, grid[i - 1, j - 1] + cost[i - 1, j - 1]), one(0))
    i, j, a, b = m, n, [], []
    while i or j:
        if i and j and grid[i, j] == grid[i - 1, j - 1] + cost[i - 1, j - 1]:
            i, j = i - 1, j - 1
            a.append(s[i])
            b.append(t[j])
        elif j == 0 or (i and grid[i - 1, j] > grid[i, j - 1]):
            i -= 1
            a.append(s[i])
            b.append("-")
        else:
            j -= 1
            a.append("-")
            b.append(t[j])
    return a[::-1], b[::-1], float(grid[m, n])


def align_pairs(pairs: DataFrame, left: str, right: str, match: float = 1.0, mismatch: float = -0.2, gap: float = -0.01) -> DataFrame:
    """``pairs`` with ``row1``, ``row2`` and ``score`` of the alignment of two columns of token arrays."""
    names = pairs.columns

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            done = [align(list(a), list(b), match, mismatch, gap) for a, b in zip(pdf[left], pdf[right], strict=True)]
            out = pdf[names].copy()
            out["row1"], out["row2"], out["score"] = [d[0] for d in done], [d[1] for d in done], [d[2] for d in done]
            yield out

    from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

    extra = [StructField("row1", ArrayType(StringType())), StructField("row2", ArrayType(StringType())), StructField("score", DoubleType())]
    return pairs.mapInPandas(run, StructType([*pairs.schema.fields, *extra]))
