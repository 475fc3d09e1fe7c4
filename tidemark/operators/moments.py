"""Sample deviations over sliding windows of an array, from mergeable moments."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and squared deviations of two runs together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros(len(n)), where=n > 0)
    step = b[1] - a[1]
    return n, a[1] + step * share, a[2] + b[2] + step * step * a[0] * share


def window_deviation(x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sample deviation of each ``x[first:end]``; nothing where it has fewer than two values.

    Moments of runs of 1, 2, 4, ... values are made by doubling, and a window is put together
    from one run for each bit of its length: no window is walked through, and nothing is taken
    away from a sum, so long histories cost no digits.
    """
    length = np.maximum(end - first, 0)
    zero = np.zeros(len(first))
    total, at, size = (zero, zero, zero), np.array(first, np.int64), 1
    runs = (np.ones(len(x)), np.array(x, float), np.zeros(len(x)))
    while size <= (length.max() if len(length) else 0):
        here = np.flatnonzero(length & size)
        joined = _merged(tuple(t[here] for t in total), tuple(r[at[here]] for r in runs))
        total = tuple(t.copy() for t in total)
        for t, j in zip(total, joined):
            t[here] = j
        at[here] += size
        runs = _merged(tuple(r[:-size] for r in runs), tuple(r[size:] for r in runs)) if len(runs[0]) > size else tuple(r[:0] for r in runs)
        size *= 2
    out = np.full(len(first), np.nan)
    enough = total[0] > 1
    out[enough] = np.sqrt(total[2][enough] / (total[0][enough] - 1))
    return out
