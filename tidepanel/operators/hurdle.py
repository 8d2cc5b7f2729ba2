"""Hurdle ensemble: probability of zero, regressors on positives, seasonal baseline."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, functions as F

from . import tails as A
from . import validation as V
from ..functions import keys as K
from ..session import staged
from ..functions.frames import trailing, whole_entity
from .forecast import forecast_seasonal
from .horizon import blend_masked
from .lags import positive_log
from .learn import FEATURES, fit_forest, fit_positive, fit_zero_classifier, model_matrix, p_zero
from .recursive import array_features, history_state
from .seasonal import apply_december

_PARTS = ("geo", "model_a", "model_b")


def _with_geo(panel: DataFrame, cut: int) -> DataFrame:
    frame = trailing(6)
    base = F.coalesce(F.exp(F.avg(positive_log(F.col("amount"))).over(frame)), F.lit(0.0))
    base = F.when(F.min("amount").over(frame) == 0, F.lit(0.0)).otherwise(base)
    boost = A.december_boost(cut, over=whole_entity())
    return panel.select("entity_id", "t", apply_december(base, boost).alias("geo"))


def hurdle_forecast(panel: DataFrame, last: int = 66, steps: int = 12, holdout: int = 12, gbt: dict | None = None, forest: dict | None = None, classifier: dict | None = None) -> tuple[DataFrame, dict]:
    """Forecast rows and the weights chosen on the newest ``holdout`` periods.

    Everything is fitted before the holdout; the zero classifier learns on the dense
    panel, because present rows hold no zeros.
    """
    known = staged(panel.where(F.col("t") <= last), "panel")  # read four times
    matrix = staged(model_matrix(known), "matrix")
    train = matrix.where(F.col("t") <= last - holdout)
    valid = matrix.where(F.col("t") > last - holdout)
    with ThreadPoolExecutor(3) as pool:  # the fits need nothing of each other
        fits = (
            pool.submit(fit_zero_classifier, train, FEATURES, **(classifier or {})),
            pool.submit(fit_positive, train, FEATURES, **(gbt or {})),
            pool.submit(fit_forest, train.where(F.col("y") > 0), FEATURES, **(forest or {})),
        )
        zero, model_a, model_b = (fit.result() for fit in fits)

    def score_rows(df: DataFrame) -> DataFrame:
        out = p_zero(zero, df)
        out = model_a.predict(out, "model_a")
        out = model_b.predict(out, "model_b")
        return out.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in ("model_a", "model_b")})

    pairs = score_rows(valid).join(_with_geo(known, last - holdout), ["entity_id", "t"])
    grid = V.grid_blend_weights(pairs, _PARTS, "p_zero")
    chosen = V.best(grid, ["threshold", "w1", "w2"]).first().asDict()

    ahead = history_state(known, last).withColumns(array_features())
    ahead = ahead.withColumn("t", F.explode(F.sequence(F.lit(last + 1), F.lit(last + steps))))
    ahead = ahead.withColumn("month_num", K.month_of("t")).drop("hist").fillna(0.0, subset=FEATURES)
    geo = forecast_seasonal(known, last, steps).withColumnRenamed("forecast", "geo")
    ready = score_rows(ahead).join(geo, ["entity_id", "t"])
    weights = [chosen["w1"], chosen["w2"], chosen["w3"]]
    value = blend_masked([F.col(c) for c in _PARTS], weights, F.col("p_zero"), chosen["threshold"])
    return ready.select("entity_id", "t", "p_zero", value.alias("forecast")), chosen
