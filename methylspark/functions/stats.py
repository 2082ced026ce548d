"""Vectorised p-values in log form (Arrow UDFs); Spark has no hypergeometric or gamma functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Terms that are held in memory at once.
CHUNK = 4_000_000


def log_factorial(n):
    """Natural log of ``n!`` for an array of whole numbers: exact sums, then Stirling's series."""
    import numpy as np

    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, 257.0)))])
    n = np.asarray(n, np.float64)
    x = np.maximum(n, 256.0) + 1.0
    series = ((x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi)
              + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5))
    return np.where(n <= 256, small[np.minimum(n, 256).astype(np.int64)], series)


def _chunks(length):
    """Slices of rows whose terms together stay near ``CHUNK``."""
    import numpy as np

    start = 0
    until = np.cumsum(length)
    while start < len(length):
        base = until[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(until, base + CHUNK, "right")))
        yield slice(start, end)
        start = end


@F.pandas_udf(DoubleType())
def fisher_log10(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Log10 of the two-sided Fisher exact p of the tables [[a, b], [c, d]].

    All tables with the same margins are weighed by log factorials; those no likelier than the
    observed one are summed relative to the likeliest of them, so no p is too small.
    """
    import numpy as np

    cells = [s.to_numpy(dtype=np.float64) for s in (a, b, c, d)]
    out = np.zeros(len(a))
    row, col, total = cells[0] + cells[1], cells[0] + cells[2], sum(cells)
    low, high = np.maximum(0.0, row + col - total), np.minimum(row, col)
    length = (high - low + 1).astype(np.int64)
    for part in _chunks(length):
        n = length[part]
        first = np.cumsum(n) - n

        def spread(values, n=n, part=part):
            return np.repeat(values[part], n)

        x = spread(low) + np.arange(n.sum()) - np.repeat(first, n)
        r, k, t = spread(row), spread(col), spread(total)
        log_w = -(log_factorial(x) + log_factorial(r - x) + log_factorial(k - x)
                  + log_factorial(t - r - k + x))
        seen = -sum(log_factorial(v[part]) for v in cells)
        tail = np.where(log_w <= np.repeat(seen + 1e-7, n), log_w, -np.inf)
        top, best = np.maximum.reduceat(log_w, first), np.maximum.reduceat(tail, first)
        every = top + np.log(np.add.reduceat(np.exp(log_w - np.repeat(top, n)), first))
        some = best + np.log(np.add.reduceat(np.exp(tail - np.repeat(best, n)), first))
        out[part] = np.minimum(some - every, 0.0) / np.log(10.0)
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def chi_square_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution by its finite series, summed in log form."""
    import math

    import numpy as np

    x, k = stat.to_numpy(dtype=np.float64), dof.fillna(0).to_numpy(dtype=np.int64)
    out = np.full(len(x), np.nan)
    good = np.flatnonzero(~np.isnan(x) & (k > 0))
    half, odd, terms = np.maximum(x[good], 0.0) / 2, k[good] % 2, k[good] // 2
    # odd degrees begin with erfc, and their powers lie halfway between whole numbers
    values = np.where(odd == 1, [math.erfc(math.sqrt(h)) for h in half], 0.0)
    for part in _chunks(np.maximum(terms, 1)):
        n = terms[part]
        rows = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        log_gamma = [log_factorial(np.arange(max(n, default=0) + 1.0)),
                     np.cumsum(np.log(np.arange(max(n, default=0) + 1.0) + 0.5))
                     + 0.5 * np.log(np.pi)]
        is_odd = odd[part][rows]
        h = half[part][rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            power = step + 0.5 * is_odd
            log_term = np.where(power == 0, 0.0, power * np.log(h)) - h - np.where(
                is_odd == 1, log_gamma[1][step], log_gamma[0][step])
        values[part] += np.bincount(rows, np.exp(log_term), minlength=len(n))
    out[good] = np.minimum(values, 1.0)
    return pd.Series(out)
