"""A user's own forecaster per entity."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def custom_forecaster(panel: DataFrame, forecast: Callable[[pd.DataFrame], pd.DataFrame], schema: str = "entity_id long, t int, forecast double") -> DataFrame:
    """Run ``forecast`` on each entity's panel rows, sorted by ``t``.

    The panel is unique per ``(entity_id, t)``, so a group is as long as the time axis.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return forecast(rows.sort_values("t"))

    return panel.groupBy("entity_id").applyInPandas(run, schema)
