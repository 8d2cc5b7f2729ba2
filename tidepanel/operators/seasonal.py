"""Seasonal multipliers and profiles that need more than one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import clip
from ..functions.frames import per_entity, whole_entity
from ..session import staged
from .tails import PEAK, SEASON, december_boost


def multiplier_parts(last: int = 66) -> list[Column]:
    """Peak mean, other mean and number of peaks per entity, zeros included."""
    known, top = F.col("t") <= last, F.pmod(F.col("t"), F.lit(SEASON)) == PEAK
    return [
        F.avg(F.when(known & top, F.col("amount"))).alias("_high"),
        F.avg(F.when(known & ~top, F.col("amount"))).alias("_rest"),
        F.count(F.when(known & top, F.col("amount"))).alias("_n"),
    ]


def multiplier(per: DataFrame, eps: float = 1e-9, min_obs: int = 1, lo: float = 0.8, hi: float = 1.5) -> Column:
    """Peak mean over other mean from the parts in ``per``; the overall ratio when an entity has few peaks.

    The overall ratio takes a second look at ``per``, one row per entity, so ``per`` should be staged.
    """
    overall = per.agg(F.avg("_high") / (F.avg("_rest") + eps)).scalar()
    raw = F.when(F.col("_n") >= min_obs, F.col("_high") / (F.col("_rest") + eps)).otherwise(overall)
    return clip(F.coalesce(raw, F.lit(1.0)), lo, hi)


def december_multiplier(panel: DataFrame, last: int = 66, eps: float = 1e-9, min_obs: int = 1, lo: float = 0.8, hi: float = 1.5) -> DataFrame:
    per = staged(per_entity(panel.where(F.col("t") <= last), *multiplier_parts(last)), "multipliers")
    return per.select("entity_id", multiplier(per, eps, min_obs, lo, hi).alias("multiplier"))


def join_boost(panel: DataFrame, last: int = 66, cap: float = 2.0, default: float = 1.3) -> DataFrame:
    """The entity's boost on each of its rows, as a window in the partitioning the lags use."""
    return panel.withColumn("boost", december_boost(last, cap, default, over=whole_entity()))


def apply_december(value: Column, factor: Column, t: Column | None = None, season: int = SEASON, peak: int = PEAK) -> Column:
    at = F.pmod(F.col("t") if t is None else t, F.lit(season)) == peak
    return F.when(at, value * factor).otherwise(value)


def seasonal_profile(panel: DataFrame, season: int = SEASON) -> DataFrame:
    phase = (F.pmod(F.col("t"), F.lit(season)) + 1).cast("int")
    return panel.groupBy(phase.alias("month_num")).agg(F.avg("amount").alias("mean_amount"))


def december_vs_rest(panel: DataFrame) -> DataFrame:
    """December's mean against the mean of the other months' means."""
    profile = seasonal_profile(panel)
    top = F.col("month_num") == 12
    december = F.avg(F.when(top, F.col("mean_amount")))
    rest = F.avg(F.when(~top, F.col("mean_amount")))
    return profile.agg(december.alias("december_mean"), rest.alias("rest_mean"), (december / rest).alias("ratio"))
