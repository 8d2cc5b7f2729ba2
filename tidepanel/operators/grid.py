"""Dense grids, wide and long layouts, and entity sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import over_cores


def grid(entities: DataFrame, lo: int, hi: int | Column) -> DataFrame:
    """Every entity at every period ``lo..hi``: a narrow ``explode``, no join. ``hi`` may be a scalar column."""
    return entities.select("entity_id", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("t"))


def cells(entities: DataFrame, lo: int, hi: int | Column) -> DataFrame:
    """The grid, marked ``_on_grid``, to be stacked on facts and aggregated with them.

    A short list of entities is one file and so one task, which would hold every cell of the panel in its aggregation. The entities are therefore
    dealt over the cores before they become cells.
    """
    return grid(over_cores(entities.select("entity_id")), lo, hi).withColumn("_on_grid", F.lit(True))


def densify(facts: DataFrame, entities: DataFrame, lo: int, hi: int | Column, values: tuple[str, ...] = ("amount",), digits: int | None = None) -> DataFrame:
    """Sum ``facts`` onto the grid; cells without facts are 0, facts off the grid are dropped.

    Grid and facts go through one aggregation together, so raw rows are combined
    before the only shuffle of rows and a busy entity costs no more than its cells.
    """
    rows = facts.where(F.col("t").between(lo, hi)).select("entity_id", "t", *values)
    summed = [F.coalesce(F.sum(v), F.lit(0.0)) for v in values]
    if digits is not None:
        summed = [F.round(s, digits) for s in summed]
    return (
        cells(entities, lo, hi).unionByName(rows, allowMissingColumns=True)
        .groupBy("entity_id", "t")
        .agg(*[s.alias(v) for s, v in zip(summed, values)], F.max("_on_grid").alias("_on_grid"))
        .where("_on_grid")
        .drop("_on_grid")
    )


def to_wide(panel: DataFrame, columns: list[int], index: str = "entity_id", over: str = "t", value: str = "amount", prefix: str = "", strict: bool = False) -> DataFrame:
    """Pivot with one column per declared key, in their order; absent cells and absent keys are 0.

    The keys must be declared, because a plan has a bounded number of columns. The
    calendar is bounded, so the default spreads ``t``; spread ``entity_id`` only
    for a short list of entities. Other keys are left out; with ``strict`` a row of such a key, or of none, stops the job.
    """
    key = F.col(over)
    if strict:
        message = F.concat(F.lit(f"{over} outside the declared columns: "), F.coalesce(key.cast("string"), F.lit("null")))
        key = F.when(key.isin(columns), key).otherwise(F.raise_error(message).cast(panel.schema[over].dataType))
    wide = panel.select(index, key.alias("_key"), value).groupBy(index).pivot("_key", columns).agg(F.sum(value))
    return wide.select(index, *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"{prefix}{c}") for c in columns])


def to_long(wide: DataFrame, columns: list[str], index: str = "entity_id", over: str = "t", value: str = "amount", prefix: str = "") -> DataFrame:
    long = wide.unpivot(index, columns, "_key", value)
    key = F.substring("_key", len(prefix) + 1, 20).cast("int")
    return long.select(index, key.alias(over), value)


def entity_union(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("entity_id")
    for frame in frames[1:]:
        out = out.union(frame.select("entity_id"))
    return out.distinct()


def missing_entities(train: DataFrame, horizon: DataFrame) -> DataFrame:
    return horizon.select("entity_id").distinct().join(train.select("entity_id").distinct(), "entity_id", "left_anti")


def synthetic_history(missing: DataFrame, medians: DataFrame, factor: float = 1.0, value: str = "median") -> DataFrame:
    """A history per missing entity from the per-period medians.

    ``medians`` has one row per period, so it fits in one array.
    """
    history = medians.agg(F.collect_list(F.struct("t", F.col(value).alias("amount")))).scalar()
    rows = missing.select("entity_id", F.explode(history).alias("_h"))
    return rows.select("entity_id", "_h.t", (F.col("_h.amount") * factor).alias("amount"))


def with_synthetic(panel: DataFrame, missing: DataFrame, made: DataFrame) -> DataFrame:
    """The panel without the missing entities' zero rows, plus their synthetic rows."""
    return panel.join(missing, "entity_id", "left_anti").unionByName(made)


def tail_present(obs: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows that an entity has, whatever their periods."""
    newest = Window.partitionBy("entity_id").orderBy(F.col("t").desc())
    return obs.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def continuity(obs: DataFrame, horizon_start: int) -> DataFrame:
    """One row: distinct periods, first, last, expected span, periods missing inside, gap to the horizon."""
    periods = obs.select("t").distinct()
    span = F.max("t") - F.min("t") + 1
    return periods.agg(
        F.count("t").alias("n_periods"),
        F.min("t").alias("t_min"),
        F.max("t").alias("t_max"),
        span.alias("expected"),
        (span - F.count("t")).alias("n_missing"),
        (F.lit(horizon_start) - F.max("t") - 1).alias("horizon_gap"),
    )


def latest(df: DataFrame, t_max: int | None = None) -> DataFrame:
    """Rows of the newest period, which is looked up unless it is given."""
    return df.where(F.col("t") == (df.agg(F.max("t")).scalar() if t_max is None else F.lit(t_max)))


def force_zero(df: DataFrame, entities: DataFrame, value: str = "forecast") -> DataFrame:
    """0 for the listed entities."""
    marked = df.join(entities.select("entity_id", F.lit(True).alias("_dead")).distinct(), "entity_id", "left")
    return marked.withColumn(value, F.when(F.col("_dead"), F.lit(0.0)).otherwise(F.col(value))).drop("_dead")


def between(lo: int, hi: int, t: Column | None = None) -> Column:
    return (F.col("t") if t is None else t).between(lo, hi)
