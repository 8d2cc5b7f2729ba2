"""Profiles of a panel and of arbitrary frames."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.frames import per_entity
from ..functions.quantiles import exact_quantiles
from ..session import staged


def monthly_totals(obs: DataFrame) -> DataFrame:
    return obs.groupBy("t").agg(F.sum("amount").alias("total"))


def monthly_profile(obs: DataFrame) -> DataFrame:
    return obs.groupBy("t").agg(F.sum("amount").alias("total"), F.avg("amount").alias("mean_amount"), F.count("amount").alias("n"))


def entity_stats(panel: DataFrame) -> DataFrame:
    return per_entity(
        panel,
        F.avg("amount").alias("mean_amount"),
        F.stddev_samp("amount").alias("std_amount"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
        F.avg((F.col("amount") == 0).cast("double")).alias("zero_rate"),
        F.count_if(F.col("amount") > 0).alias("periods_with_data"),
    )


def zero_profile(panel: DataFrame, last: int = 66, recent: int = 12) -> DataFrame:
    """Per entity: zero rate, zero rate of the newest periods, zero in the last one, and the panel's rate."""
    zero = (F.col("amount") == 0).cast("double")
    known = panel.where(F.col("t") <= last)
    per = per_entity(
        known,
        F.avg(zero).alias("zero_rate"),
        F.avg(F.when(F.col("t") > last - recent, zero)).alias("recent_zero_rate"),
        F.max(F.when(F.col("t") == last, zero)).cast("int").alias("zero_in_last"),
        F.sum(zero).alias("_z"),
        F.count(F.lit(1)).alias("_n"),
    )
    per = staged(per, "zero-rates")
    overall = per.agg(F.sum("_z") / F.sum("_n")).scalar()
    return per.drop("_z", "_n").withColumn("panel_zero_rate", overall)


def describe(df: DataFrame, col: str) -> DataFrame:
    df = staged(df.select(col), "describe")
    moments = df.agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max")
    )
    quartiles = exact_quantiles(df, col, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, stage=False)
    packed = quartiles.select(F.struct("q25", "q50", "q75")).scalar()
    return moments.withColumn("_q", packed).select("n", "mean", "std", "min", "_q.q25", "_q.q50", "_q.q75", "max")


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("corr"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))


#: Columns of a block; a task holds six square matrices of a pair of blocks.
CORR_BLOCK = 256
#: Rows whose means the sums are taken about. That bears on rounding only, so any rows of the table will do.
SHIFT_ROWS = 1000


def _cross_products(df: DataFrame, left: list[str], right: list[str], shift: dict[str, float]) -> DataFrame:
    """``(a, b, n, sa, sb, saa, sbb, sab)`` of each pair, over rows where both have a value; one row per task and pair."""
    names = list(dict.fromkeys([*left, *right]))
    same = left == right
    rows = df.select(*[(F.col(c).cast("double") - F.lit(shift[c])).alias(f"_{i}") for i, c in enumerate(names)])
    at_left, at_right = [names.index(c) for c in left], [names.index(c) for c in right]

    def sums(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            a, b, has_a, has_b = x[:, at_left], x[:, at_right], there[:, at_left], there[:, at_right]
            new = np.stack([has_a.T @ has_b, a.T @ has_b, has_a.T @ b, (a * a).T @ has_b, has_a.T @ (b * b), a.T @ b])
            total = new if total is None else total + new
        if total is not None:
            i, j = np.triu_indices(len(left)) if same else np.indices(total.shape[1:]).reshape(2, -1)
            arrays = [pa.array(np.array(left, object)[i], pa.string()), pa.array(np.array(right, object)[j], pa.string()), *(pa.array(m[i, j]) for m in total)]
            yield pa.RecordBatch.from_arrays(arrays, ["col_a", "col_b", "n", "sa", "sb", "saa", "sbb", "sab"])

    return rows.mapInArrow(sums, "col_a string, col_b string, n double, sa double, sb double, saa double, sbb double, sab double")


def corr_matrix(df: DataFrame, cols: list[str], block: int = CORR_BLOCK) -> DataFrame:
    """All pairs as ``(col_a, col_b, corr)`` rows, each over the rows where both columns have a value (NaN counts as none).

    Columns are taken in blocks, and each pair of blocks reads its own columns only: every task multiplies its rows' blocks and emits
    one row of sums per pair of columns, which are added up by pair. Up to ``block`` columns that is one pass over ``df``, which should be staged beyond.
    Null where a column does not vary over the shared rows.
    """
    some = df.limit(SHIFT_ROWS).agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    shift = {c: v if v is not None and math.isfinite(v) else 0.0 for c, v in zip(cols, some)}
    blocks = [cols[i : i + block] for i in range(0, len(cols), block)]
    parts = reduce(DataFrame.union, [_cross_products(df, a, b, shift) for i, a in enumerate(blocks) for b in blocks[i:]])
    n, sa, sb, saa, sbb, sab = (F.sum(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab"))
    own_a, own_b = saa - sa * sa / n, sbb - sb * sb / n
    varies = (n > 1) & (own_a > 1e-13 * saa) & (own_b > 1e-13 * sbb)
    spread = F.sqrt(own_a) * F.sqrt(own_b)
    return parts.groupBy("col_a", "col_b").agg(F.when(varies, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (sab - sa * sb / n) / spread))).alias("corr"))


def missing_rate(df: DataFrame, top: int = 20) -> DataFrame:
    """Share of nulls per column, highest first."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_rate")) for c in df.columns]
    return row.select(F.inline(F.array(*cells))).orderBy(F.col("missing_rate").desc(), "column_name").limit(top)


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max; the last bin is closed; empty bins are kept."""
    df, x = staged(df.select(col), "histogram"), F.col(col).cast("double")
    bounds = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    rows = df.select(x.alias("_x"), bounds.alias("_b")).where(F.col("_x").isNotNull())
    position = F.floor(F.try_divide((F.col("_x") - F.col("_b.lo")) * bins, F.col("_b.hi") - F.col("_b.lo")))
    binned = rows.select(F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("bigint").alias("n"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).unionByName(every)
    width = (F.col("_b.hi") - F.col("_b.lo")) / bins
    edges = counts.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("_b", bounds)
    return edges.select("bin", (F.col("_b.lo") + F.col("bin") * width).alias("lower"), (F.col("_b.lo") + (F.col("bin") + 1) * width).alias("upper"), "n")


def time_medians(panel: DataFrame) -> DataFrame:
    return exact_quantiles(panel, "amount", {"median": 0.5}, by=["t"])


def column_max(df: DataFrame) -> DataFrame:
    return df.agg(*[F.max(c).alias(c) for c in df.columns])


def forecast_summary(df: DataFrame, value: str = "forecast") -> DataFrame:
    df = staged(df.select(value), "forecasts")
    row = df.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.count_if(F.col(value) > 0).alias("nonzero"),
        F.avg((F.col(value) == 0).cast("double")).alias("zero_rate"),
        F.stddev_samp(value).alias("std"),
        F.max(value).alias("max"),
    )
    return row.withColumn("median", exact_quantiles(df, value, {"median": 0.5}, stage=False).scalar())


def value_summary(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"))


def top_entities(stats: DataFrame, by: str, n: int = 5) -> DataFrame:
    return stats.orderBy(F.col(by).desc(), "entity_id").limit(n)


def sparse_entities(stats: DataFrame, periods: int | Column, below: int = 30) -> DataFrame:
    """Entities with data in every period, and entities with data in few."""
    kind = F.when(F.col("periods_with_data") == periods, "full").when(F.col("periods_with_data") < below, "sparse")
    return stats.select("entity_id", "periods_with_data", kind.alias("kind")).where(F.col("kind").isNotNull())



def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, df in tables.items()]
    return reduce(DataFrame.union, counts)
