"""Error metrics as single aggregations; ``by`` scores many groups in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import exact_quantiles
from ..session import staged


def ape(y: str = "y", p: str = "p", floor: float = 1e-12) -> Column:
    return F.abs((F.col(y) - F.col(p)) / F.greatest(F.col(y), F.lit(floor)))


def _good_rate(error: Column) -> Column:
    return F.avg((error <= 1.0).cast("double"))


def two_stage_columns(y: str = "y", p: str = "p", threshold: float = 0.7, boundary_passes: bool = False, floor: float = 1e-12) -> tuple[Column, Column]:
    """``(score, good_rate)``: 0 below the rate threshold, else 1 - mean good APE / rate."""
    error = ape(y, p, floor)
    rate = _good_rate(error)
    fails = rate < threshold if boundary_passes else rate <= threshold
    score = F.when(fails, F.lit(0.0)).otherwise(1.0 - F.avg(F.when(error <= 1.0, error)) / rate)
    return score, rate


def two_stage_score(df: DataFrame, by: tuple[str, ...] = (), y: str = "y", p: str = "p", threshold: float = 0.7) -> DataFrame:
    score, rate = two_stage_columns(y, p, threshold)
    return df.groupBy(*by).agg(score.alias("score"), rate.alias("good_rate"))


def two_stage_score_strict(df: DataFrame, by: tuple[str, ...] = (), y: str = "y", p: str = "p", threshold: float = 0.7) -> DataFrame:
    """Passes at the threshold itself; fails the job on no rows, negative truth or non-finite predictions."""
    finite = F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(F.col(p)) != float("inf"))
    score, rate = two_stage_columns(y, p, threshold, boundary_passes=True)
    problem = (
        F.when(F.count(F.lit(1)) == 0, F.lit("no rows to score"))
        .when(F.count_if(F.col(y) < 0) > 0, F.lit("negative truth"))
        .when(F.count_if(~finite) > 0, F.lit("non-finite prediction"))
    )
    checked = df.groupBy(*by).agg(problem.alias("_bad"), score.alias("score"), rate.alias("good_rate"))
    return checked.select(
        *by,
        F.when(F.col("_bad").isNotNull(), F.raise_error(F.col("_bad")).cast("double")).otherwise(F.col("score")).alias("score"),
        "good_rate",
    )


def two_stage_score_clipped(df: DataFrame, by: tuple[str, ...] = (), y: str = "y", p: str = "p", max_bad: float = 0.30, eps: float = 1e-12) -> DataFrame:
    clipped = df.withColumn("_p", F.greatest(F.col(p), F.lit(0.0)))
    error = ape(y, "_p")
    bad, rate = F.avg((error > 1.0).cast("double")), _good_rate(error)
    value = 1.0 - F.avg(F.when(error <= 1.0, error)) / (rate + eps)
    score = F.when(bad > max_bad, F.lit(0.0)).otherwise(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)))
    return clipped.groupBy(*by).agg(score.alias("score"), rate.alias("good_rate"))


def local_score(df: DataFrame, by: tuple[str, ...] = (), y: str = "y", p: str = "p", threshold: float = 0.3) -> DataFrame:
    """Rate times mean of 1 / (1 + good APE), with the truth floored at 1."""
    error = ape(y, p, 1.0)
    rate = _good_rate(error)
    gain = F.avg(F.when(error <= 1.0, 1.0 / (1.0 + error)))
    score = F.when(rate < threshold, F.lit(0.0)).otherwise(rate * gain)
    return df.groupBy(*by).agg(score.alias("score"), rate.alias("good_rate"), F.count(F.lit(1)).alias("n"))


def rmse_column(y: str = "y", p: str = "p") -> Column:
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2)))


def mape_column(y: str = "y", p: str = "p", eps: float = 1e-12) -> Column:
    return F.avg(ape(y, p, eps))


def ape_profile(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    errors = staged(df.select(ape(y, p).alias("ape")), "errors")
    shares = errors.agg(
        F.avg("ape").alias("mean_ape"),
        F.avg((F.col("ape") < 1).cast("double")).alias("share_below_1"),
        F.avg((F.col("ape") >= 1).cast("double")).alias("share_from_1"),
    )
    median = exact_quantiles(errors, "ape", {"median_ape": 0.5}, stage=False).scalar()
    return shares.withColumn("median_ape", median)


def prediction_counts(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.agg(
        F.count_if(F.col(p) < 0).alias("negative_predictions"),
        F.count_if(F.col(p) == 0).alias("zero_predictions"),
        F.count_if(F.col(y) == 0).alias("zero_truths"),
        F.count(F.lit(1)).alias("n"),
    )
