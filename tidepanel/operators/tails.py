"""Statistics of the end of a history, as aggregate Column expressions.

Each function returns one Column for ``groupBy("entity_id").agg(...)``. Several of
them in one ``agg`` share a single shuffle. With ``over=`` they become window
expressions instead. ``last`` is the last known period, a number or a Column;
nothing after it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

from ..functions.columns import clip

SEASON = 12
PEAK = 11


def _num(v: int | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _run(agg: Column, over: WindowSpec | None) -> Column:
    return agg if over is None else agg.over(over)


def within(n: int, last: int | Column, skip: int = 0) -> Column:
    """The ``n`` periods that end ``skip`` periods before ``last``."""
    end = _num(last) - skip
    return (F.col("t") > end - n) & (F.col("t") <= end)


def geo_mean(lookback: int, last: int | Column, value: str = "amount", over: WindowSpec | None = None, eps: float | None = None) -> Column:
    """Geometric mean of the positive values, or of all values with zeros as ``eps``."""
    x = F.col(value)
    log = F.when(x > 0, F.ln(x))
    if eps is not None:
        log = F.ln(F.when(x == 0, F.lit(eps)).otherwise(x))
    return F.exp(_run(F.avg(F.when(within(lookback, last), log)), over))


def lowest(n: int, last: int | Column, value: str = "amount", over: WindowSpec | None = None) -> Column:
    return _run(F.min(F.when(within(n, last), F.col(value))), over)


def guarded(base: Column, low: Column) -> Column:
    return F.when(low == 0, F.lit(0.0)).otherwise(F.coalesce(base, F.lit(0.0)))


def geo_mean_guard(lookback: int = 6, guard: int = 6, last: int | Column = 66, value: str = "amount", over: WindowSpec | None = None, eps: float | None = None) -> Column:
    """Geometric mean of the tail; 0 when any of the last ``guard`` values is 0."""
    return guarded(geo_mean(lookback, last, value, over, eps), lowest(guard, last, value, over))


def mean_guard(lookback: int = 6, guard: int = 6, last: int | Column = 66, value: str = "amount") -> Column:
    return guarded(tail_mean(lookback, last, value), lowest(guard, last, value))


def tail_mean(n: int, last: int | Column, value: str = "amount", skip: int = 0) -> Column:
    return F.avg(F.when(within(n, last, skip), F.col(value)))


def tail_median(n: int, last: int | Column, value: str = "amount") -> Column:
    return F.median(F.when(within(n, last), F.col(value)))


def tail_std(n: int, last: int | Column, value: str = "amount") -> Column:
    return F.stddev_samp(F.when(within(n, last), F.col(value)))


def last_value(last: int | Column, value: str = "amount") -> Column:
    return F.max(F.when(F.col("t") == _num(last), F.col(value)))


def _known(last: int | Column) -> Column:
    return F.col("t") <= _num(last)


def _peak(season: int, peak: int) -> Column:
    return F.pmod(F.col("t"), F.lit(season)) == peak


def december_boost(last: int | Column = 66, cap: float | None = 2.0, default: float = 1.3, value: str = "amount", over: WindowSpec | None = None, season: int = SEASON, peak: int = PEAK) -> Column:
    """Mean positive peak value over mean positive other value, capped from above."""
    x, known, top = F.col(value), _known(last), _peak(season, peak)
    high = _run(F.avg(F.when(known & top & (x > 0), x)), over)
    rest = _run(F.avg(F.when(known & ~top & (x > 0), x)), over)
    return F.coalesce(clip(high / rest, hi=cap), F.lit(default))


def december_boost_median(last: int | Column = 66, lo: float = 0.8, hi: float = 1.7, default: float = 1.3, min_peaks: int = 2, value: str = "amount", season: int = SEASON, peak: int = PEAK) -> Column:
    """Ratio of medians, only with enough positive peaks, clipped on both sides."""
    x, known, top = F.col(value), _known(last), _peak(season, peak)
    high, rest = F.when(known & top & (x > 0), x), F.when(known & ~top & (x > 0), x)
    ratio = clip(F.median(high) / F.median(rest), lo, hi)
    return F.when((F.count(high) >= min_peaks) & (F.count(rest) > 0), ratio).otherwise(F.lit(default))


def trend_ratio(n: int, lo: float, hi: float, last: int | Column = 66, min_rows: int = 0, value: str = "amount") -> Column:
    """Mean of the last ``n`` over the mean of the ``n`` before, clipped; 1 without a base."""
    now, before = tail_mean(n, last, value), tail_mean(n, last, value, skip=n)
    rows = F.count(F.when(within(2 * n, last), F.col(value)))
    return F.when((rows >= min_rows) & (before > 0), clip(now / before, lo, hi)).otherwise(F.lit(1.0))


def adaptive_lookback(last: int | Column = 66, value: str = "amount") -> Column:
    """Short lookback for volatile entities, long for stable ones."""
    x = F.when(_known(last) & (F.col(value) > 0), F.col(value))
    cv = F.stddev_samp(x) / (F.avg(x) + 1e-10)
    return F.when(F.count(x) <= 6, 6).when(cv > 1.5, 3).when(cv > 0.8, 6).otherwise(9)


def ewm_last(span: int = 6, last: int | Column = 66, value: str = "amount") -> Column:
    """Exponentially weighted mean of the whole history at its last row, adjusted weights."""
    weight = F.when(_known(last), F.pow(F.lit(1.0 - 2.0 / (span + 1)), _num(last) - F.col("t")))
    return F.sum(F.col(value) * weight) / F.sum(weight)


def ewgm(n: int, alpha: float, last: int | Column = 66, value: str = "amount") -> Column:
    """Exponentially weighted geometric mean of the positive tail; 0 for a short or empty tail."""
    x = F.col(value)
    used = F.when(within(n, last) & (x > 0), F.pow(F.lit(alpha), _num(last) - F.col("t")))
    mean = F.exp(F.sum(used * F.ln(F.when(x > 0, x + 1e-12))) / F.sum(used))
    return F.when(F.count(F.when(within(n, last), x)) == n, F.coalesce(mean, F.lit(0.0))).otherwise(F.lit(0.0))


def ewam(n: int, alpha: float, last: int | Column = 66, value: str = "amount") -> Column:
    """Exponentially weighted arithmetic mean, same rules as ``ewgm``."""
    x = F.col(value)
    used = F.when(within(n, last) & (x > 0), F.pow(F.lit(alpha), _num(last) - F.col("t")))
    mean = F.sum(used * x) / F.sum(used)
    return F.when(F.count(F.when(within(n, last), x)) == n, F.coalesce(mean, F.lit(0.0))).otherwise(F.lit(0.0))


def too_many_zeros(t2: int, allow: int, last: int | Column = 66, value: str = "amount") -> Column:
    """Share of zeros in the last ``t2`` above ``allow / t2``, or no positive value at all."""
    x = F.col(value)
    share = F.avg(F.when(within(t2, last), (x == 0).cast("double")))
    return (share > allow / t2 + 1e-8) | (F.sum(F.when(_known(last), x)) == 0)
