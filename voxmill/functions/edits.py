"""Edit distance of long texts: a diagonal band that widens until the distance fits, and what the edits are.

Edits are counted on the one kind of path that is best by (distance, substitutions, deletions): a path's cost is one
whole number of these three, so that the least cost names all of them. A cell needs its diagonals' neighbours only, and
an antidiagonal of the band is worked out at once; cost grows with length times distance, memory with the distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

DISTANCE, SUBSTITUTION = 1 << 42, 1 << 21
FIRST, WIDER = 64, 4
FAR = np.iinfo(np.int64).max // 4


def within(r: np.ndarray, h: np.ndarray, bound: int) -> int | None:
    """The least cost from r to h, if its distance is at most `bound`. Cells (i, j) with |i - j| <= bound; position
    i - j + bound + 1 of an antidiagonal i + j."""
    n, m = len(r), len(h)
    if abs(n - m) > bound:
        return None
    width = 2 * bound + 3
    before, last = np.full(width, FAR), np.full(width, FAR)
    last[bound + 1] = 0
    for k in range(1, n + m + 1):
        # i runs over the cells of this antidiagonal within the table and the band
        low = max(0, k - m, (k - bound + 1) // 2)
        high = min(n, k, (k + bound) // 2)
        now = np.full(width, FAR)
        if low <= high:
            at = slice(2 * low - k + bound + 1, 2 * high - k + bound + 2, 2)
            left, right = slice(at.start - 1, at.stop - 1, 2), slice(at.start + 1, at.stop + 1, 2)
            cost = np.minimum(last[left] + (DISTANCE + 1), last[right] + DISTANCE)  # a word of r deleted, one of h inserted
            a, b = max(low, 1), min(high, k - 1)
            if a <= b:
                same = r[a - 1 : b] == h[k - b - 1 : k - a][::-1]
                inner = slice(2 * a - k + bound + 1, 2 * b - k + bound + 2, 2)
                cost[a - low : b - low + 1] = np.minimum(cost[a - low : b - low + 1], before[inner] + np.where(same, 0, DISTANCE + SUBSTITUTION))
            now[at] = cost
        before, last = last, now
    cost = int(last[n - m + bound + 1])
    return cost if cost // DISTANCE <= bound else None


def edit_counts(reference: list, hypothesis: list) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) from reference to hypothesis."""
    names = {w: k for k, w in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    r, h = (np.array([names[w] for w in x], np.int64) for x in (reference, hypothesis))
    bound, most = max(FIRST, abs(len(r) - len(h))), max(len(r), len(h))
    while (cost := within(r, h, bound)) is None:
        bound = min(bound * WIDER, most)
    distance, rest = divmod(cost, DISTANCE)
    substitutions, deletions = divmod(rest, SUBSTITUTION)
    return substitutions, deletions, distance - substitutions - deletions


@F.pandas_udf(StructType([StructField(x, LongType()) for x in ("substitutions", "deletions", "insertions")]))
def edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Of arrays of words; null counts as none."""
    of = lambda x: [] if x is None else list(x)
    return pd.DataFrame([edit_counts(of(r), of(h)) for r, h in zip(reference, hypothesis, strict=True)], columns=["substitutions", "deletions", "insertions"])


def distance(a: Column, b: Column) -> Column:
    """levenshtein() in bands that widen from 64 until the distance fits: cost grows with length times distance."""
    longest = F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    widest = F.greatest(F.ceil(F.log(longest / FIRST) / F.log(F.lit(float(WIDER)))).cast("int"), F.lit(0)) + 1
    band = lambda k: (F.pow(F.lit(float(WIDER)), k) * FIRST).cast("int")
    return F.aggregate(F.sequence(F.lit(0), widest), F.lit(-1), lambda d, k: F.when(d >= 0, d).otherwise(F.call_function("levenshtein", a, b, band(k))))
