"""Lag and rolling features.

All of them share one partitioning and one order, so a frame built from them
needs one shuffle and one sort. On a dense panel a lag is a calendar lag; on
present rows it is the previous row the entity has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import columns as C, keys as K
from ..functions.frames import full_window, in_time, trailing

LAGS = (1, 2, 3, 6, 12)
WINDOWS = (3, 6, 12)


def positive_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


_ROLLERS = {
    "mean": ("roll_mean", F.avg, lambda x: x, lambda x: x),
    "geo": ("roll_geo_mean", F.avg, positive_log, F.exp),
    "std": ("roll_std", F.stddev_samp, lambda x: x, lambda x: x),
    "max": ("roll_max", F.max, lambda x: x, lambda x: x),
    "min": ("roll_min", F.min, lambda x: x, lambda x: x),
}


def lag_columns(ks=LAGS, value: str = "amount") -> dict[str, Column]:
    return {f"lag_{k}": F.lag(F.col(value), k).over(in_time()) for k in ks}


def rolling_columns(kind: str, windows=WINDOWS, value: str = "amount") -> dict[str, Column]:
    """Full windows over the rows before the current one."""
    name, agg, before, after = _ROLLERS[kind]
    return {f"{name}_{w}": after(full_window(agg, before(F.col(value)), w)) for w in windows}


def lags(df: DataFrame, ks=LAGS, value: str = "amount") -> DataFrame:
    return df.withColumns(lag_columns(ks, value))


def rolling(df: DataFrame, kind: str, windows=WINDOWS, value: str = "amount") -> DataFrame:
    return df.withColumns(rolling_columns(kind, windows, value))


def rolling_current(df: DataFrame, kind: str, windows=WINDOWS, value: str = "amount") -> DataFrame:
    """Full windows that end with the current row."""
    name, agg, before, after = _ROLLERS[kind]
    cols = {}
    for w in windows:
        frame = in_time().rowsBetween(-(w - 1), 0)
        cols[f"{name}_cur_{w}"] = after(full_window(agg, before(F.col(value)), w, frame))
    return df.withColumns(cols)


def lag_features(df: DataFrame, ks=LAGS, windows=WINDOWS, value: str = "amount") -> DataFrame:
    filled = df.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
    return filled.withColumns(
        {**lag_columns(ks, value), **rolling_columns("mean", windows, value), **rolling_columns("geo", windows, value)}
    )


def lag_feature_names(ks=LAGS, windows=WINDOWS) -> list[str]:
    return [f"lag_{k}" for k in ks] + [f"roll_mean_{w}" for w in windows] + [f"roll_geo_mean_{w}" for w in windows]


def ewm_running(df: DataFrame, span: int = 6, value: str = "amount") -> DataFrame:
    """Exponentially weighted mean of all earlier rows, adjusted weights.

    Running sums are weighted relative to the first row of a block of rows, so weights stay in range
    for a history of any length. The block before is added with the weight it has left; what lies before that has
    less than 1e-60 of it.
    """
    keep = 1.0 - 2.0 / (span + 1)
    size = max(2, int(138 / -math.log(keep)))
    place = F.row_number().over(in_time()) - 1
    rows = df.withColumns({"_block": F.floor(place / size).cast("int"), "_at": place % size})
    inside = Window.partitionBy("entity_id", "_block").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("entity_id").orderBy("_block").rangeBetween(-1, -1)
    x = F.col(value)
    there = x.isNotNull().cast("double")
    rising, rest = F.pow(F.lit(keep), -F.col("_at")), F.pow(F.lit(keep), F.lit(size - 1) - F.col("_at"))

    def total(v: Column) -> Column:
        own = F.coalesce(F.sum(v * rising).over(inside), F.lit(0.0)) / keep
        before = F.coalesce(F.sum(v * rest).over(earlier), F.lit(0.0))
        return own + before

    return rows.withColumn(f"ewm_{span}", F.try_divide(total(x), total(there))).drop("_block", "_at")


def pct_change(df: DataFrame, ks=(1, 3), value: str = "amount") -> DataFrame:
    """Relative change; null where the earlier value is 0 or absent."""
    return df.withColumns(
        {f"growth_{k}": F.try_divide(F.col(value), F.lag(F.col(value), k).over(in_time())) - 1 for k in ks}
    )


def label_next(df: DataFrame, value: str = "amount") -> DataFrame:
    return df.withColumn("label", F.lead(F.col(value), 1).over(in_time()))


def shift_join(df: DataFrame, shifts=(1, 2, 12), cols: tuple[str, ...] | None = None) -> DataFrame:
    """``cols`` as of ``t - m``, suffixed ``_m``; null where that period has no row. Without ``cols``, every column but the keys.

    A range frame of one period is a calendar lag, so no self-join is needed. A shift is one window over one struct, however many columns it holds.
    """
    cols = [c for c in df.columns if c not in ("entity_id", "t")] if cols is None else list(cols)
    row = F.struct(*cols)
    names = {m: next(n for n in (f"_shift_{m}{'_' * i}" for i in range(len(df.columns) + 1)) if n not in df.columns) for m in shifts}
    out = df.withColumns({names[m]: F.first(row).over(in_time().rangeBetween(-m, -m)) for m in shifts})
    return out.select(*df.columns, *[F.col(names[m])[c].alias(f"{c}_{m}") for m in shifts for c in cols])


def features_at(hist: DataFrame, at: int, entities: DataFrame, ks=LAGS, windows=WINDOWS, dense: bool = True) -> DataFrame:
    """Features of one future period: a placeholder row per entity, then the lag frame.

    On a dense history only the rows a window can reach are kept before the shuffle.
    """
    past = hist.where(F.col("t") < at)
    if dense:
        past = past.where(F.col("t") >= at - max(*ks, *windows))
    placeholder = entities.select("entity_id", F.lit(at).alias("t"), F.lit(None).cast("double").alias("amount"))
    both = past.select("entity_id", "t", "amount").unionByName(placeholder)
    return lag_features(both, ks, windows).where(F.col("t") == at).drop("amount")


def advanced_features(df: DataFrame, ks=LAGS, windows=WINDOWS, t_max: int | Column | None = None) -> DataFrame:
    """Lag frame plus calendar waves, progress, lag ratios, zero flags and lag spread."""
    progress = df.agg(F.max("t")).scalar() if t_max is None else F.lit(t_max)
    out = lag_features(df, ks, windows)
    out = K.fourier(out, [12]).withColumn("year_progress", F.try_divide(F.col("t"), progress))
    out = C.zero_flags(C.lag_ratio(out))
    return C.row_stats(out, [f"lag_{k}" for k in ks])
