"""Numbers: truncation, rounding, Poisson tails, normal distribution, colours."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truncate_to(value: Column, step: float | Column) -> Column:
    """Towards zero to a multiple of ``step``."""
    return (value / step).cast("bigint") * step


def round_to(value: Column, step: float) -> Column:
    """To the nearest multiple of ``step``, halves to the even one."""
    return F.bround(value / F.lit(step)) * F.lit(step)


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def log_factorial(n: Column) -> Column:
    """ln n! for n >= 0: exact sum below 16, Stirling's series from there."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))
    return F.when(n < 16, exact).otherwise(series)


def _log_factorials(n: np.ndarray) -> np.ndarray:
    x = n + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return np.where(n < 16, np.cumsum(np.log(np.maximum(np.arange(17.0), 1)))[np.minimum(n, 16).astype(int)], series)


def _terms(start: np.ndarray, mean: np.ndarray, down: bool) -> np.ndarray:
    """Sums of Poisson terms from ``start`` away from the mode, each from the one before, until they no longer count."""
    term = np.exp(start * np.log(mean) - mean - _log_factorials(start))
    total, i = term.copy(), 0
    while len(term) and (term > total * 1e-17).any():
        i += 1
        term = term * np.maximum((start - i + 1) / mean if down else mean / (start + i), 0)
        total += term
    return total


def poisson_tail(k: np.ndarray, mean: np.ndarray, upper: bool) -> np.ndarray:
    """P(X <= k) or P(X >= k). The tail that does not hold the mode is summed, so that small ones keep their digits; the other is its rest."""
    out = np.full(len(k), np.nan)
    known = ~(np.isnan(k) | np.isnan(mean))
    out[known & (mean <= 0)] = 0.0 if upper else 1.0
    out[known & ((k <= 0) if upper else (k < 0))] = 1.0 if upper else 0.0
    rest = np.isnan(out) & known
    above = rest & (k > mean)
    below = rest & (k <= mean)
    with np.errstate(under="ignore"):
        if upper:
            out[above] = _terms(k[above], mean[above], False)
            out[below] = 1 - _terms(k[below] - 1, mean[below], True)
        else:
            out[below] = _terms(k[below], mean[below], True)
            out[above] = 1 - _terms(k[above] + 1, mean[above], False)
    return np.minimum(out, 1.0)


def _tail(k: Column, mean: Column, upper: bool) -> Column:
    def tail(k: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series(poisson_tail(k.to_numpy(float), mean.to_numpy(float), upper))

    return F.pandas_udf(tail, T.DoubleType())(k.cast("double"), mean.cast("double"))


def poisson_left(k: Column, mean: Column) -> Column:
    """P(X <= k), vectorised over Arrow batches: sums in SQL's higher-order functions are interpreted and several times slower."""
    return _tail(k, mean, False)


def poisson_right(k: Column, mean: Column) -> Column:
    """P(X >= k)."""
    return _tail(k, mean, True)


def floored_log10(p: Column, floor: float) -> Column:
    """log10 of a probability, no lower than ``floor``; null stays null."""
    return F.when(p.isNull(), F.lit(None).cast("double")).when(p <= 0, F.lit(floor)).otherwise(F.greatest(F.log10(p), F.lit(floor)))


def normal_cdf(z: Column) -> Column:
    """Cumulative standard normal: the error function's series to 3, its continued fraction beyond."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("sum")),
        lambda a, n: F.struct((-a["term"] * x * x / n).alias("term"), (a["sum"] - a["term"] * x * x / n / (2 * n + 1)).alias("sum")),
        lambda a: a["sum"] * 1.1283791670955126,
    )
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda a, n: x + n / 2.0 / a)
    far = F.exp(-x * x) / F.sqrt(F.lit(3.141592653589793)) / fraction
    tail = F.when(x < 3, (1 - series) / 2).otherwise(far / 2)
    return F.when(z.isNull() | F.isnan(z), F.lit(None).cast("double")).when(z < 0, tail).otherwise(1 - tail)


def colour_index(value: Column, low: float, high: float, colours: int) -> Column:
    """Linear place of a value among ``colours``, clipped to the ends."""
    share = (F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / (high - low)
    return F.bround(share * (colours - 1)).cast("int")


def eligible_bins(distinct: Column, numeric: bool) -> Column:
    """Values a feature is split into: 0 (cannot be), 2, as many as it has below 100, or 100 if numeric."""
    return F.when(distinct <= 1, 0).when(distinct < 100, distinct).otherwise(F.lit(100 if numeric else 0)).cast("int")


def binomial_tails(k: np.ndarray, n: np.ndarray, p: np.ndarray, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """P(X <= k) and P(X >= k) of binomials, for whole arrays at once; some millions of terms are held at a time."""
    left, right = np.zeros(len(k)), np.zeros(len(k))
    log_fact = np.r_[0.0, np.cumsum(np.log(np.arange(1, int(n.max() if len(n) else 0) + 1)))]
    low, high = np.log(np.maximum(p, 1e-300)), np.log(np.maximum(1 - p, 1e-300))
    ends = np.cumsum(n + 1)
    start = 0
    while start < len(k):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once, "right")))
        sizes = n[start:stop] + 1
        of = np.repeat(np.arange(start, stop), sizes)
        first = np.cumsum(sizes) - sizes
        i = np.arange(len(of)) - np.repeat(first, sizes)
        mass = np.exp(log_fact[n[of]] - log_fact[i] - log_fact[n[of] - i] + i * low[of] + (n[of] - i) * high[of])
        left[start:stop] = np.add.reduceat(np.where(i <= k[of], mass, 0.0), first)
        right[start:stop] = np.add.reduceat(np.where(i >= k[of], mass, 0.0), first)
        start = stop
    return np.minimum(left, 1.0), np.minimum(right, 1.0)
