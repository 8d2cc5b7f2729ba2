"""Window specifications over ``(entity_id, t)``.

Rows are unique per ``(entity_id, t)`` when these run, so a window partition is
never longer than the time axis, however many raw rows an entity has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def whole_entity() -> WindowSpec:
    return Window.partitionBy("entity_id")


def in_time() -> WindowSpec:
    return Window.partitionBy("entity_id").orderBy("t")


def trailing(width: int) -> WindowSpec:
    """The ``width`` rows before the current one."""
    return in_time().rowsBetween(-width, -1)


def full_window(agg: Callable[[Column], Column], value: Column, width: int, frame: WindowSpec | None = None) -> Column:
    """``agg`` over the frame, null unless the frame holds ``width`` non-null values."""
    frame = trailing(width) if frame is None else frame
    return F.when(F.count(value).over(frame) == width, agg(value).over(frame))


def over_cores(df: DataFrame) -> DataFrame:
    """Rows dealt by entity over the cores, by number: few bytes that cost much work would else be put together into few tasks."""
    return df.repartition(max(8, df.sparkSession.sparkContext.defaultParallelism), "entity_id")


def per_entity(panel: DataFrame, *aggs: Column) -> DataFrame:
    """One row per entity from a panel that is unique per ``(entity_id, t)``.

    The narrow cells are moved once, and the aggregation then runs where they are.
    A partial aggregation before the shuffle would find next to nothing to combine
    and would move its wide buffers instead.
    """
    return panel.repartition("entity_id").groupBy("entity_id").agg(*aggs)
