"""Baseline forecasters: one aggregation per entity, then a narrow explode over the horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import clip, month_multiplier
from ..functions.frames import per_entity
from ..functions.quantiles import exact_quantiles
from ..session import staged
from . import tails as A
from .grid import tail_present
from .seasonal import apply_december, multiplier, multiplier_parts


def expand_horizon(rows: DataFrame, last: int, steps: int = 12) -> DataFrame:
    return rows.withColumn("t", F.explode(F.sequence(F.lit(last + 1), F.lit(last + steps))))


def _publish(per: DataFrame, last: int, steps: int, base: Column, boost: Column | None = None) -> DataFrame:
    rows = expand_horizon(per, last, steps)
    return rows.select("entity_id", "t", (base if boost is None else apply_december(base, boost)).alias("forecast"))


def forecast_geo(panel: DataFrame, last: int = 66, steps: int = 12, lookback: int = 6, guard: int = 6, eps: float | None = None) -> DataFrame:
    per = per_entity(panel, A.geo_mean_guard(lookback, guard, last, eps=eps).alias("base"))
    return _publish(per, last, steps, F.col("base"))


def forecast_mean(panel: DataFrame, last: int = 66, steps: int = 12, lookback: int = 6, guard: int = 6) -> DataFrame:
    per = per_entity(panel, A.mean_guard(lookback, guard, last).alias("base"))
    return _publish(per, last, steps, F.col("base"))


def forecast_seasonal(panel: DataFrame, last: int = 66, steps: int = 12, lookback: int = 6, guard: int = 6, cap: float | None = 2.0, default: float = 1.3, season: int = A.SEASON, peak: int = A.PEAK) -> DataFrame:
    per = per_entity(
        panel,
        A.geo_mean_guard(lookback, guard, last).alias("base"),
        A.december_boost(last, cap, default, season=season, peak=peak).alias("boost"),
    )
    rows = expand_horizon(per, last, steps)
    return rows.select("entity_id", "t", apply_december(F.col("base"), F.col("boost"), season=season, peak=peak).alias("forecast"))


def forecast_geo_eps(panel: DataFrame, last: int = 66, steps: int = 12) -> DataFrame:
    """Zeros enter the logs as 1e-10 instead of being skipped; the guard still applies."""
    return forecast_geo(panel, last, steps, eps=1e-10)


def forecast_damped_median(obs: DataFrame, panel: DataFrame, horizon: DataFrame, last: int = 66, n: int = 6, damp: float = 0.3, floor: float = 100.0, unseen: float = 0.2) -> DataFrame:
    """Damped median of the last present rows; entities without rows get a share of the overall median."""
    tail = tail_present(obs.where(F.col("t") <= last), n)
    per = tail.groupBy("entity_id").agg(
        F.when((F.min("amount") == 0) | (F.avg("amount") < floor), F.lit(0.0))
        .otherwise(F.median("amount") * damp)
        .alias("base")
    )
    medians = per_entity(panel.where(F.col("t") <= last), F.median("amount").alias("m"))
    overall = exact_quantiles(medians, "m", {"q": 0.5}).select(F.col("q") * unseen).scalar()
    out = horizon.select("entity_id", "t").join(per, "entity_id", "left")
    return out.select("entity_id", "t", F.coalesce("base", overall).alias("forecast"))


def forecast_weighted(panel: DataFrame, last: int = 66, steps: int = 12, weights: tuple[float, ...] = (0.50, 0.25, 0.15, 0.10), cap: float = 1.8) -> DataFrame:
    per = per_entity(
        panel,
        A.geo_mean_guard(6, 6, last).alias("geo6"),
        A.geo_mean_guard(3, 3, last).alias("geo3"),
        A.geo_mean_guard(9, 9, last).alias("geo9"),
        clip(A.ewm_last(6, last), lo=0.0).alias("ewm"),
        F.least(A.december_boost(last), F.lit(cap)).alias("boost"),
    )
    parts = [F.col(c) * w for c, w in zip(("geo6", "geo3", "geo9", "ewm"), weights)]
    base = parts[0] + parts[1] + parts[2] + parts[3]
    month = (F.pmod(F.col("t"), F.lit(12)) + 1).cast("int")
    return _publish(per, last, steps, base * month_multiplier(month), F.col("boost"))


def forecast_adaptive(panel: DataFrame, last: int = 66, steps: int = 12, cap: float = 1.8) -> DataFrame:
    """Lookback by volatility class; all classes are computed in the one aggregation."""
    per = per_entity(
        panel,
        A.adaptive_lookback(last).alias("lookback"),
        *[A.geo_mean_guard(n, n, last).alias(f"geo{n}") for n in (3, 6, 9)],
        F.least(A.december_boost(last), F.lit(cap)).alias("boost"),
    )
    base = F.when(F.col("lookback") == 3, F.col("geo3")).when(F.col("lookback") == 6, F.col("geo6")).otherwise(F.col("geo9"))
    return _publish(per, last, steps, base, F.col("boost"))


def forecast_trend(panel: DataFrame, last: int = 66, steps: int = 12, cap: float = 1.8) -> DataFrame:
    per = per_entity(
        panel,
        A.geo_mean_guard(6, 6, last).alias("geo"),
        A.trend_ratio(3, 0.7, 1.5, last).alias("trend"),
        F.least(A.december_boost(last), F.lit(cap)).alias("boost"),
    )
    return _publish(per, last, steps, F.col("geo") * F.col("trend"), F.col("boost"))


def forecast_conservative(panel: DataFrame, last: int = 66, steps: int = 12, weights: tuple[float, float, float] = (0.7, 0.2, 0.1), cap: float = 1.5) -> DataFrame:
    per = per_entity(
        panel,
        A.geo_mean_guard(6, 6, last).alias("geo"),
        A.tail_median(6, last).alias("median"),
        A.tail_mean(6, last).alias("mean"),
        F.least(A.december_boost(last), F.lit(cap)).alias("boost"),
    )
    base = F.col("geo") * weights[0] + F.col("median") * weights[1] + F.col("mean") * weights[2]
    return _publish(per, last, steps, base, F.col("boost"))


def forecast_robust_december(panel: DataFrame, last: int = 66, steps: int = 12) -> DataFrame:
    per = per_entity(
        panel,
        A.geo_mean_guard(6, 6, last).alias("geo"),
        A.trend_ratio(6, 0.8, 1.3, last, min_rows=12).alias("trend"),
        A.december_boost_median(last).alias("boost"),
    )
    return _publish(per, last, steps, F.col("geo") * F.col("trend"), F.col("boost"))


def forecast_ewgm(panel: DataFrame, last: int = 66, steps: int = 12, n: int = 12, alpha: float = 0.5, t2: int = 10, allow: int = 2, lo: float = 0.85, hi: float = 1.4, weights: tuple[float, float, float] = (0.34, 0.34, 0.32), model: Column | None = None) -> DataFrame:
    """Last value and weighted geometric mean, zero rule, December multiplier, then the model term.

    ``model`` is an optional aggregate; its term is added after the December
    factor and also for entities that the zero rule sets to 0.
    """
    per = per_entity(
        panel,
        A.too_many_zeros(t2, allow, last).alias("dead"),
        A.last_value(last).alias("recent"),
        A.ewgm(n, alpha, last).alias("ewgm"),
        *multiplier_parts(last),
        (F.max(F.lit(0.0)) if model is None else F.coalesce(model, F.lit(0.0))).alias("model"),
    )
    per = staged(per, "ewgm")
    base = F.when(F.col("dead"), F.lit(0.0)).otherwise(F.col("recent") * weights[0] + F.col("ewgm") * weights[1])
    rows = expand_horizon(per.select("entity_id", "model", base.alias("base"), multiplier(per, lo=lo, hi=hi).alias("multiplier")), last, steps)
    return rows.select("entity_id", "t", (apply_december(F.col("base"), F.col("multiplier")) + F.col("model") * weights[2]).alias("forecast"))


def forecast_geo_present(obs: DataFrame, last: int = 66, steps: int = 12, lookback: int = 6, cap: float = 2.0) -> DataFrame:
    """Geometric mean over present rows: 0 with fewer than ``lookback`` rows or any zero among them."""
    known = obs.where(F.col("t") <= last)
    newest = Window.partitionBy("entity_id").orderBy(F.col("t").desc())
    tail = F.row_number().over(newest) <= lookback
    rows = known.withColumn("_tail", F.when(tail, F.col("amount")))  # window and aggregation share one shuffle
    base = F.when((F.count("_tail") < lookback) | (F.min("_tail") == 0), F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.col("_tail") + 1e-10))))
    per = rows.groupBy("entity_id").agg(base.alias("base"), A.december_boost(last, cap).alias("boost"))
    return _publish(per, last, steps, F.col("base"), F.col("boost"))
