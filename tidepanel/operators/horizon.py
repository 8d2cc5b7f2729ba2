"""Post-processing of horizon forecasts: ids, guards, damping, blends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import per_entity
from ..functions.keys import horizon_id


def with_ids(forecasts: DataFrame, base_year: int) -> DataFrame:
    return forecasts.withColumn("id", horizon_id("t", "entity_id", base_year))


def damp(forecasts: DataFrame, entities: DataFrame, factor: float = 0.5, value: str = "forecast") -> DataFrame:
    """Multiply the rows of the listed entities."""
    marked = forecasts.join(entities.select("entity_id", F.lit(factor).alias("_f")).distinct(), "entity_id", "left")
    return marked.withColumn(value, F.col(value) * F.coalesce("_f", F.lit(1.0))).drop("_f")


def lag_guard(value: Column, *lags: Column) -> Column:
    """0 where any of the lags is 0."""
    dead = reduce(lambda a, b: a | b, [F.coalesce(lag == 0, F.lit(False)) for lag in lags])
    return F.when(dead, F.lit(0.0)).otherwise(value)


def tail_guard(forecasts: DataFrame, panel: DataFrame, t2: int = 6, last: int = 66, value: str = "forecast") -> DataFrame:
    """0 for entities with a zero among their last ``t2`` periods."""
    recent = panel.where((F.col("t") > last - t2) & (F.col("t") <= last))
    dead = per_entity(recent, F.min("amount").alias("_low"))
    out = forecasts.join(dead, "entity_id", "left")
    return out.withColumn(value, F.when(F.col("_low") == 0, F.lit(0.0)).otherwise(F.col(value))).drop("_low")


def blend(files: list[DataFrame], weights: list[float], on: str = "id", value: str = "forecast") -> DataFrame:
    """Weighted sum per id: one aggregation, no joins. An id that a file lacks or repeats is an error."""
    parts = [f.select(on, (F.col(value) * w).alias(value), F.lit(i).alias("_file")) for i, (f, w) in enumerate(zip(files, weights))]
    stacked = reduce(DataFrame.unionByName, parts)
    per = stacked.groupBy(on).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("_n"), F.size(F.collect_set("_file")).alias("_files"))
    whole = (F.col("_n") == len(files)) & (F.col("_files") == len(files))
    problem = F.raise_error(F.concat(F.lit("not once in every file: "), F.coalesce(F.col(on).cast("string"), F.lit("null")))).cast("double")
    return per.select(on, F.when(whole, F.col(value)).otherwise(problem).alias(value))


def blend_masked(predictions: list[Column], weights: list[float], p_zero: Column, threshold: float = 0.5) -> Column:
    """Weighted sum, 0 where a zero is likelier than the threshold, never negative."""
    total = reduce(lambda a, b: a + b, [p * w for p, w in zip(predictions, weights)])
    return F.when(p_zero > threshold, F.lit(0.0)).otherwise(F.greatest(total, F.lit(0.0)))


def ensemble_mean(predictions: list[Column], p_zero: Column, threshold: float = 0.7) -> Column:
    return blend_masked(predictions, [1.0 / len(predictions)] * len(predictions), p_zero, threshold)
