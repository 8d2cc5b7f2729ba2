"""Small column operators: prefixes, fills, clips, flags, row statistics, types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .quantiles import exact_quantiles

# Multipliers by month number, 1 for months not listed.
MONTH_MULTIPLIERS = {1: 0.95, 2: 0.90, 3: 1.05, 6: 1.05, 11: 1.05}

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def add_prefix(df: DataFrame, prefix: str, exclude: tuple[str, ...] = ("entity_id", "t", "month", "sector")) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c not in exclude})


def fill_sentinel(df: DataFrame, value: float, cols: list[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=cols)


def impute_median(df: DataFrame, fit_df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill nulls with the exact medians of ``fit_df``, 0 for a column without values."""
    long = fit_df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "name", "value")
    medians = exact_quantiles(long, "value", {"median": 0.5}, by=["name"])
    # one row per column name, so the map is as wide as the column list
    lookup = medians.agg(F.map_from_entries(F.collect_list(F.struct("name", "median")))).scalar()
    filled = df.withColumn("_medians", lookup)
    filled = filled.withColumns({c: F.coalesce(F.col(c), F.col("_medians")[c], F.lit(0.0)) for c in cols})
    return filled.drop("_medians")


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip that keeps nulls, unlike bare ``least``/``greatest``."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def lag_ratio(df: DataFrame, ks: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    return df.withColumns({f"ratio_lag1_lag{k}": F.try_divide(F.col("lag_1"), F.col(f"lag_{k}") + 1) for k in ks})


def zero_flags(df: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    return df.withColumns({f"lag{k}_is_zero": F.coalesce(F.col(f"lag_{k}") == 0, F.lit(False)).cast("int") for k in ks})


def row_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sample std over the non-null ``cols`` of a row, and std / (mean + 1)."""
    present = [F.col(c).isNotNull().cast("int") for c in cols]
    n = sum(present[1:], present[0])
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0.0)))
    staged = df.withColumns({"_n": n, "_mean": F.try_divide(total, n)})
    squares = [F.coalesce(F.pow(F.col(c) - F.col("_mean"), 2), F.lit(0.0)) for c in cols]
    spread = sum(squares[1:], squares[0])
    staged = staged.withColumn("lag_std", F.when(F.col("_n") > 1, F.sqrt(spread / (F.col("_n") - 1))))
    return staged.withColumn("lag_cv", F.try_divide(F.col("lag_std"), F.col("_mean") + 1)).drop("_n", "_mean")


def is_zero(c: str = "amount") -> Column:
    return (F.col(c) == 0).cast("int")


def month_multiplier(month: Column, table: dict[int, float] = MONTH_MULTIPLIERS, peak: int = 12) -> Column:
    out = F.lit(1.0)
    for m, factor in table.items():
        if m != peak:
            out = F.when(month == m, F.lit(factor)).otherwise(out)
    return out


def align_columns(df: DataFrame, cols: list[str], value: float, keys: tuple[str, ...] = ("entity_id", "t")) -> DataFrame:
    """Exactly ``keys`` and ``cols``; columns that are missing become the constant."""
    missing = {c: F.lit(value) for c in cols if c not in df.columns}
    return (df.withColumns(missing) if missing else df).select(*keys, *cols)


def feature_cols(df: DataFrame, prefixes: tuple[str, ...] = (), exclude: tuple[str, ...] = ("entity_id", "t", "amount")) -> list[str]:
    """Numeric columns, optionally by name prefix, minus ``exclude``."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return [c for c in numeric if c not in exclude and (not prefixes or c.startswith(tuple(prefixes)))]


def cast_floats(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.col(c).cast("float") for c in doubles}) if doubles else df


def compact_types(df: DataFrame, keys: tuple[str, ...] = ("entity_id", "t")) -> DataFrame:
    """Narrowest integer type that holds each integer column; all-zero columns go.

    One aggregation finds all the ranges; one row comes back to the driver.
    """
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, _INTEGERS) and f.name not in keys]
    if not ints:
        return df
    bounds = df.agg(*[F.min(c).alias(f"lo_{c}") for c in ints], *[F.max(c).alias(f"hi_{c}") for c in ints]).first()
    drop, casts = [], {}
    for c in ints:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        if lo is None:
            continue
        if lo == 0 and hi == 0:
            drop.append(c)
        elif -128 <= lo and hi <= 127:
            casts[c] = F.col(c).cast("tinyint")
        elif -32768 <= lo and hi <= 32767:
            casts[c] = F.col(c).cast("smallint")
        elif -(2**31) <= lo and hi < 2**31:
            casts[c] = F.col(c).cast("int")
    return (df.withColumns(casts) if casts else df).drop(*drop)
