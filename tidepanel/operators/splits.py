"""The best split of a target by one feature, from running sums over range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import staged


def best_splits(df: DataFrame, cols: list[str], y: str = "y", least: int = 1) -> DataFrame:
    """Per feature the threshold that lowers the target's variance most: the exact root split of a regression tree.

    Columns ``feature``, ``threshold`` (halfway between neighbouring values; values up to it go left), ``gain`` (variance less the mean variance of the two sides),
    ``n_left``, ``n_right``, ``mean_left`` and ``mean_right``. Of equal gains the lowest threshold wins; both sides hold ``least`` rows.
    Rows without a target, and values that are null or NaN, count for nothing; a feature of one value has no row.

    Equal values are added up first. Their sums are sorted by range over all machines, each part's total is carried to the parts after it,
    and running sums then stay inside a part: no window spans a whole feature.
    """
    rows = df.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in cols])
    long = rows.unpivot("_y", cols, "feature", "x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    cells = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"))
    cells = staged(cells.repartitionByRange("feature", "x").withColumn("part", F.spark_partition_id()), "cells")

    parts = cells.groupBy("feature", "part").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("x").alias("first"))
    along, whole = Window.partitionBy("feature").orderBy("part"), Window.partitionBy("feature")
    ahead = along.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "feature", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(ahead), F.lit(0.0)).alias("s0"),
        F.lead("first").over(along).alias("beyond"), F.sum("n").over(whole).alias("n_all"), F.sum("s").over(whole).alias("s_all"),
    )
    inside = Window.partitionBy("feature", "part").orderBy("x")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tried = cells.join(staged(parts, "parts"), ["feature", "part"]).select(
        "feature", "x", (F.sum("n").over(so_far) + F.col("n0")).alias("n_left"), (F.sum("s").over(so_far) + F.col("s0")).alias("s_left"),
        F.coalesce(F.lead("x").over(inside), "beyond").alias("next"), "n_all", "s_all",
    )
    tried = tried.where(F.col("next").isNotNull()).withColumns({"n_right": F.col("n_all") - F.col("n_left"), "s_right": F.col("s_all") - F.col("s_left")})
    tried = tried.where((F.col("n_left") >= least) & (F.col("n_right") >= least))
    explained = F.pow("s_left", F.lit(2)) / F.col("n_left") + F.pow("s_right", F.lit(2)) / F.col("n_right") - F.pow("s_all", F.lit(2)) / F.col("n_all")
    tried = tried.withColumns({"gain": explained / F.col("n_all"), "threshold": (F.col("x") + F.col("next")) / 2})
    best = F.max_by(
        F.struct("threshold", "gain", "n_left", "n_right", (F.col("s_left") / F.col("n_left")).alias("mean_left"), (F.col("s_right") / F.col("n_right")).alias("mean_right")),
        F.struct("gain", -F.col("threshold")),
    )
    return tried.groupBy("feature").agg(best.alias("best")).select("feature", "best.*")
