"""Joins of side tables onto a panel, the feature mart, and horizon alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys as K
from ..functions.frames import per_entity
from . import tails as A
from .grid import cells
from .peers import STATS, peer_stats


def join_static(df: DataFrame, static: DataFrame) -> DataFrame:
    """Left join of one row per entity; the key is parsed when the table only has its text."""
    if "entity_id" not in static.columns and "sector" in static.columns:
        static = K.parse_entity(static)
    return df.join(static.drop("sector"), "entity_id", "left")


def join_yearly(df: DataFrame, yearly: DataFrame, base_year: int) -> DataFrame:
    return df.withColumn("year", K.year_of("t", base_year)).join(yearly, "year", "left")


def join_nearby(df: DataFrame, nearby: DataFrame) -> DataFrame:
    return df.join(nearby, ["entity_id", "t"], "left")


def attach_target(features: DataFrame, target: DataFrame, value: str = "amount", name: str = "y") -> DataFrame:
    return features.join(target.select("entity_id", "t", F.col(value).alias(name)), ["entity_id", "t"], "left")


def semi_filter(df: DataFrame, keep: DataFrame, on: str = "entity_id") -> DataFrame:
    return df.join(keep.select(on).distinct(), on, "left_semi")


def build_mart(
    entities: DataFrame, lo: int, hi: int | Column, facts: DataFrame,
    static: DataFrame, yearly: DataFrame, base_year: int, group: str = "n_nationkey", sentinel: float = -1.0,
) -> DataFrame:
    """Grid with target, side tables, their neighbour statistics, static and yearly attributes.

    ``facts`` holds ``amount``, ``pht`` (second-hand) and ``lt`` (land) per ``(entity_id, t)``; it is stacked on
    the grid and aggregated with it: one shuffle instead of a join.
    """
    stacked = cells(entities, lo, hi).unionByName(facts.select("entity_id", "t", "amount", "pht", "lt"), allowMissingColumns=True)
    sides = [c for v in ("pht", "lt") for c in (F.avg(v).alias(f"{v}_mean"), F.sum(v).alias(f"{v}_sum"), F.max(v).alias(f"{v}_max"))]
    frame = (
        stacked.groupBy("entity_id", "t")
        .agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"), *sides, F.max("_on_grid").alias("_on_grid"))
        .where("_on_grid")
        .drop("_on_grid")
    )
    frame = join_static(frame, static)
    frame = peer_stats(frame, group, {"amount": STATS, "pht_sum": ("mean", "sum"), "lt_sum": ("mean", "sum")})
    names = {f"amount_peer_{s}": f"nht_nearby_{s}" for s in STATS}
    names |= {f"{v}_sum_peer_{s}": f"{v}_nearby_{s}" for v in ("pht", "lt") for s in ("mean", "sum")}
    frame = frame.withColumnsRenamed(names)
    return join_yearly(frame, yearly, base_year).fillna(sentinel)


def horizon_features(panel: DataFrame, last: int, steps: int, base_year: int, n_lags: int = 3) -> DataFrame:
    """Each entity's newest values as lags, with the calendar of every horizon period.

    One aggregation per entity replaces a history lookup per horizon row.
    """
    per = per_entity(
        panel,
        *[A.last_value(last - k).alias(f"lag_{k + 1}") for k in range(n_lags)],
        *[A.tail_mean(w, last).alias(f"roll_mean_{w}") for w in (3, 6, 12)],
        *[A.tail_std(w, last).alias(f"roll_std_{w}") for w in (3, 6, 12)],
    )
    rows = per.withColumn("t", F.explode(F.sequence(F.lit(last + 1), F.lit(last + steps))))
    return K.calendar_features(rows, base_year).withColumn("season", K.season_code("t"))


def align_to_horizon(horizon: DataFrame, forecasts: DataFrame, value: str = "forecast") -> DataFrame:
    """Every horizon row in its order number, unknown ids as 0."""
    out = horizon.join(forecasts.select("entity_id", "t", value), ["entity_id", "t"], "left")
    return out.select("row_no", "id", F.coalesce(value, F.lit(0.0)).alias(value))


def id_mismatch(left: DataFrame, right: DataFrame, on: str = "id") -> DataFrame:
    """One row: ids on either side only, and ids on both."""
    marks = left.select(on, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(on, F.lit(0), F.lit(1)))
    per = marks.groupBy(on).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("left_only"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("right_only"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("both"),
    )


def join_fanout(df: DataFrame, keys: tuple[str, ...] = ("entity_id", "t")) -> DataFrame:
    """One row: rows, distinct keys, and whether they agree."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows, unique = F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))
    return per.agg(rows.alias("n_rows"), unique.alias("n_keys"), (rows == unique).alias("is_unique"))
