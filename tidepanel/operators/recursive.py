"""Recursive forecasting: each step's prediction becomes history for the next.

The history an entity needs is as long as the longest window, so it travels as one
short array per entity. A step is a projection; no step shuffles or joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import over_cores
from ..session import checkpointed
from .lags import LAGS, WINDOWS


def history_state(panel: DataFrame, last: int, depth: int = max(*LAGS, *WINDOWS)) -> DataFrame:
    """``(entity_id, hist)`` with the newest ``depth`` dense values, oldest first, over as many tasks as there are cores: a step's cost is its predictions."""
    recent = over_cores(panel.where((F.col("t") > last - depth) & (F.col("t") <= last)))
    pairs = F.sort_array(F.collect_list(F.struct("t", "amount")))
    return recent.groupBy("entity_id").agg(F.transform(pairs, lambda p: p["amount"]).alias("hist"))


def newest(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def array_features(hist: str = "hist", ks=LAGS, windows=WINDOWS) -> dict[str, Column]:
    """The lag frame of the next period, from the array; null where it is too short."""
    h = F.col(hist)
    out = {f"lag_{k}": F.when(F.size(h) >= k, F.get(h, F.size(h) - k)) for k in ks}
    for w in windows:
        part = newest(h, w)
        total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
        logs = F.aggregate(part, F.lit(0.0), lambda a, x: a + F.ln(x))
        whole = F.size(h) >= w
        out[f"roll_mean_{w}"] = F.when(whole, total / w)
        out[f"roll_geo_mean_{w}"] = F.when(whole & ~F.exists(part, lambda x: x <= 0), F.exp(logs / w))
    return out


def recursive_forecast(
    fitted, state: DataFrame, last: int, steps: int = 12, impute: dict[str, float] | float = 0.0,
    guard: str | None = None, damp: str | None = None, damp_factor: float = 0.5, checkpoint_every: int = 6,
) -> DataFrame:
    """Features, fill, predict, clip at 0, guard, damp and append, once per future period.

    ``guard`` and ``damp`` name boolean columns of ``state``. The lineage is cut every
    ``checkpoint_every`` steps, since the plan grows with each.
    """
    depth = max(*LAGS, *WINDOWS)
    extra = [c for c in (guard, damp) if c]
    features = array_features()
    current = state.select("entity_id", "hist", F.array().cast("array<double>").alias("out"), *extra)
    for step in range(1, steps + 1):
        month = (last + step) % 12 + 1
        framed = current.withColumns({**features, "month_num": F.lit(month)})
        predicted = fitted.predict(framed.fillna(impute, subset=None if isinstance(impute, dict) else fitted.cols), "_p")
        value = F.greatest(F.col("_p"), F.lit(0.0))
        if damp:
            value = F.when(F.col(damp), value * damp_factor).otherwise(value)
        if guard:
            value = F.when(F.col(guard), F.lit(0.0)).otherwise(value)
        current = predicted.withColumn("_v", value).select(
            "entity_id",
            newest(F.concat("hist", F.array("_v")), depth).alias("hist"),
            F.concat("out", F.array("_v")).alias("out"),
            *extra,
        )
        if step % checkpoint_every == 0 and step < steps:
            current = checkpointed(current)
    # a plain explode infers a filter on the array, whose way down through the steps would spell out every step in each of its uses
    rows = current.select("entity_id", F.posexplode_outer("out").alias("_i", "forecast"))
    return rows.select("entity_id", (F.col("_i") + last + 1).alias("t"), "forecast")
