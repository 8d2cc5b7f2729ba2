"""Baseline forecasters, horizon post-processing, metrics and validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.frames import per_entity
from ..operators import custom, forecast as FC, grid as G, horizon as H, joins as J, metrics as M, profile as R, seasonal as S, tails as A, validation as V
from ..session import scratch_path, staged
from ..sources import fixtures as X
from .aggregates import LOOKBACK, MEDIAN_BOOST, multiplier_sql, trend_sql, weighted_sql
from .registry import MONTH_NAME, boost_sql, geo_sql, query, rounded, score_sql

_GEO66 = geo_sql()


def _tail(agg: str, n: int) -> str:
    return f"{agg}(CASE WHEN t > {66 - n} AND t <= 66 THEN amount END)"


def _fc(base: str, boost: str = "1.0", cols: str = "") -> str:
    """Per-entity columns, then one row per horizon period with the December factor."""
    return f"per AS (SELECT entity_id{cols} FROM train GROUP BY entity_id) SELECT entity_id, t, round(({base}) * CASE WHEN t % 12 = 11 THEN {boost} ELSE 1.0 END, 4) AS forecast FROM per CROSS JOIN ahead"


def _train(spark, d) -> DataFrame:
    return X.panel(spark, d, X.LAST)


@query("forecast_geo", _fc("g", cols=f", {_GEO66} AS g"))
def forecast_geo(spark, d):
    return rounded(FC.forecast_geo(_train(spark, d)))


@query("forecast_seasonal", _fc("g", "b", f", {_GEO66} AS g, {boost_sql()} AS b"))
def forecast_seasonal(spark, d):
    return rounded(FC.forecast_seasonal(_train(spark, d)))


@query("forecast_seasonal_capped", _fc("g", "b", f", {_GEO66} AS g, {boost_sql(1.5)} AS b"))
def forecast_seasonal_capped(spark, d):
    return rounded(FC.forecast_seasonal(_train(spark, d), cap=1.5))


@query(
    "forecast_damped_median",
    """
tailed AS (SELECT entity_id, amount, row_number() OVER (PARTITION BY entity_id ORDER BY t DESC) AS rn FROM obs WHERE t <= 66),
per AS (SELECT entity_id, CASE WHEN min(amount) = 0 OR avg(amount) < 100 THEN 0.0 ELSE 0.3 * median(amount) END AS base FROM tailed WHERE rn <= 6 GROUP BY entity_id),
unseen AS (SELECT 0.2 * median(m) AS v FROM (SELECT median(amount) AS m FROM train GROUP BY entity_id))
SELECT h.entity_id, h.t, round(coalesce(p.base, (SELECT v FROM unseen)), 4) AS forecast FROM horizon h LEFT JOIN per p ON p.entity_id = h.entity_id
""",
)
def forecast_damped_median(spark, d):
    return rounded(FC.forecast_damped_median(X.obs(spark, d, X.LAST), _train(spark, d), X.horizon(spark, d)))


_EWM = "sum(amount * pow(5.0 / 7.0, 66 - t)) / sum(pow(5.0 / 7.0, 66 - t))"
_MONTHS = "CASE t % 12 + 1 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 1.05 WHEN 6 THEN 1.05 WHEN 11 THEN 1.05 ELSE 1.0 END"


@query(
    "forecast_weighted",
    _fc(f"(0.5 * g6 + 0.25 * g3 + 0.15 * g9 + 0.1 * e) * {_MONTHS}", "least(b, 1.8)",
        f", {geo_sql(6, 6)} AS g6, {geo_sql(3, 3)} AS g3, {geo_sql(9, 9)} AS g9, {_EWM} AS e, {boost_sql()} AS b"),
)
def forecast_weighted(spark, d):
    return rounded(FC.forecast_weighted(_train(spark, d)))


@query(
    "forecast_adaptive",
    _fc("CASE lb WHEN 3 THEN g3 WHEN 6 THEN g6 ELSE g9 END", "least(b, 1.8)",
        f", {LOOKBACK} AS lb, {geo_sql(6, 6)} AS g6, {geo_sql(3, 3)} AS g3, {geo_sql(9, 9)} AS g9, {boost_sql()} AS b"),
)
def forecast_adaptive(spark, d):
    return rounded(FC.forecast_adaptive(_train(spark, d)))


@query("forecast_trend", _fc("g * r", "least(b, 1.8)", f", {_GEO66} AS g, {trend_sql(3, 0.7, 1.5)} AS r, {boost_sql()} AS b"))
def forecast_trend(spark, d):
    return rounded(FC.forecast_trend(_train(spark, d)))


@query(
    "forecast_conservative",
    _fc("0.7 * g + 0.2 * md + 0.1 * mn", "least(b, 1.5)", f", {_GEO66} AS g, {_tail('median', 6)} AS md, {_tail('avg', 6)} AS mn, {boost_sql()} AS b"),
)
def forecast_conservative(spark, d):
    return rounded(FC.forecast_conservative(_train(spark, d)))


@query("forecast_robust_december", _fc("g * r", "b", f", {_GEO66} AS g, {trend_sql(6, 0.8, 1.3)} AS r, {MEDIAN_BOOST} AS b"))
def forecast_robust_december(spark, d):
    return rounded(FC.forecast_robust_december(_train(spark, d)))


@query(
    "forecast_geo_eps",
    _fc("CASE WHEN low = 0 THEN 0.0 ELSE g END", cols=f", {_tail('min', 6)} AS low, exp(avg(CASE WHEN t > 60 THEN ln(CASE WHEN amount = 0 THEN 1e-10 ELSE amount END) END)) AS g"),
)
def forecast_geo_eps(spark, d):
    return rounded(FC.forecast_geo_eps(_train(spark, d)))


@query(
    "forecast_ewgm",
    multiplier_sql(0.85, 1.4) + f""",
per AS (SELECT entity_id, CASE WHEN avg(CASE WHEN t > 56 THEN CASE WHEN amount = 0 THEN 1.0 ELSE 0.0 END END) > 2 / 10.0 + 1e-8 OR sum(amount) = 0 THEN 0.0
        ELSE 0.34 * max(CASE WHEN t = 66 THEN amount END) + 0.34 * {weighted_sql(12, 0.5, True)} END AS base, {_GEO66} AS model FROM train GROUP BY entity_id)
SELECT per.entity_id, t, round(base * CASE WHEN t % 12 = 11 THEN multiplier ELSE 1.0 END + 0.32 * model, 4) AS forecast
FROM per JOIN mult ON mult.entity_id = per.entity_id CROSS JOIN ahead
""",
)
def forecast_ewgm(spark, d):
    return rounded(FC.forecast_ewgm(_train(spark, d), model=A.geo_mean_guard(6, 6, X.LAST)))


@query(
    "forecast_geo_present",
    f"""
tailed AS (SELECT entity_id, amount, row_number() OVER (PARTITION BY entity_id ORDER BY t DESC) AS rn FROM obs WHERE t <= 66),
base AS (SELECT entity_id, CASE WHEN count(*) < 6 OR min(amount) = 0 THEN 0.0 ELSE exp(avg(ln(amount + 1e-10))) END AS base FROM tailed WHERE rn <= 6 GROUP BY entity_id),
boosts AS (SELECT entity_id, {boost_sql()} AS b FROM obs WHERE t <= 66 GROUP BY entity_id)
SELECT base.entity_id, t, round(base * CASE WHEN t % 12 = 11 THEN b ELSE 1.0 END, 4) AS forecast FROM base JOIN boosts ON boosts.entity_id = base.entity_id CROSS JOIN ahead
""",
)
def forecast_geo_present(spark, d):
    return rounded(FC.forecast_geo_present(X.obs(spark, d, X.LAST)))


@query("forecast_mean", _fc("CASE WHEN low = 0 THEN 0.0 ELSE m END", cols=f", {_tail('min', 6)} AS low, {_tail('avg', 6)} AS m"))
def forecast_mean(spark, d):
    return rounded(FC.forecast_mean(_train(spark, d)))


@query(
    "events_forecast",
    """
ev AS (SELECT CAST(user_id AS BIGINT) AS entity_id, CAST(date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM events), CAST(ts AS DATE)) AS INTEGER) AS t, round(sum(value), 2) AS amount FROM events GROUP BY 1, 2),
days AS (SELECT CAST(unnest(range(0, (SELECT max(t) + 1 FROM ev))) AS INTEGER) AS t),
evp AS (SELECT u.entity_id, days.t, coalesce(ev.amount, 0.0) AS amount FROM (SELECT DISTINCT entity_id FROM ev) u CROSS JOIN days LEFT JOIN ev ON ev.entity_id = u.entity_id AND ev.t = days.t),
per AS (SELECT entity_id, CASE WHEN min(CASE WHEN t > 19 AND t <= 22 THEN amount END) = 0 THEN 0.0 ELSE coalesce(exp(avg(CASE WHEN t > 15 AND t <= 22 THEN ln(nullif(amount, 0)) END)), 0.0) END AS g,
  coalesce(least(avg(CASE WHEN t <= 22 AND t % 7 = 6 AND amount > 0 THEN amount END) / avg(CASE WHEN t <= 22 AND t % 7 <> 6 AND amount > 0 THEN amount END), CASE WHEN
    avg(CASE WHEN t <= 22 AND t % 7 = 6 AND amount > 0 THEN amount END) / avg(CASE WHEN t <= 22 AND t % 7 <> 6 AND amount > 0 THEN amount END) IS NOT NULL THEN 2.0 END), 1.3) AS b
  FROM evp GROUP BY entity_id)
SELECT entity_id, t, round(g * CASE WHEN t % 7 = 6 THEN b ELSE 1.0 END, 4) AS forecast FROM per CROSS JOIN (SELECT CAST(unnest(range(23, 30)) AS INTEGER) AS t)
""",
)
def events_forecast(spark, d):
    panel = X.events_panel(spark, d)
    return rounded(FC.forecast_seasonal(panel, last=22, steps=7, lookback=7, guard=3, season=7, peak=6))


# ---- horizon ----


@query("horizon_ids", f"SELECT e.entity_id, t, CAST(1995 + t // 12 AS VARCHAR) || ' ' || {MONTH_NAME}[t % 12 + 1] || '_sector ' || CAST(e.entity_id AS VARCHAR) AS id FROM entities e CROSS JOIN ahead")
def horizon_ids(spark, d):
    return H.with_ids(G.grid(X.entities(spark, d), X.LAST + 1, X.END), X.BASE_YEAR)


_SYNTH = f"""
missing AS (SELECT entity_id FROM horizon EXCEPT SELECT entity_id FROM obs WHERE t <= 66),
medians AS (SELECT t, median(amount) AS amount FROM train GROUP BY t),
hist AS (SELECT entity_id, t, amount FROM train WHERE entity_id NOT IN (SELECT entity_id FROM missing)
         UNION ALL SELECT entity_id, t, amount FROM missing CROSS JOIN medians),
per AS (SELECT entity_id, {_GEO66} AS g FROM hist GROUP BY entity_id)
"""


@query("damp_synthetic", _SYNTH + "SELECT entity_id, t, round(CASE WHEN entity_id IN (SELECT entity_id FROM missing) THEN g * 0.5 ELSE g END, 4) AS forecast FROM per CROSS JOIN ahead")
def damp_synthetic(spark, d):
    panel = staged(_train(spark, d), "panel")
    missing = G.missing_entities(X.obs(spark, d, X.LAST), X.horizon_entities(spark, d))
    history = G.with_synthetic(panel, missing, G.synthetic_history(missing, R.time_medians(panel)))
    return rounded(H.damp(FC.forecast_geo(history), missing))


@query(
    "lag_guard",
    f"per AS (SELECT entity_id, CASE WHEN max(CASE WHEN t = 66 THEN amount END) = 0 OR max(CASE WHEN t = 65 THEN amount END) = 0 THEN 0.0 ELSE {_tail('avg', 6)} END AS f FROM train GROUP BY entity_id) "
    "SELECT entity_id, t, round(f, 4) AS forecast FROM per CROSS JOIN ahead",
)
def lag_guard(spark, d):
    rows = J.horizon_features(_train(spark, d), X.LAST, X.STEPS, X.BASE_YEAR, 2)
    value = H.lag_guard(F.col("roll_mean_6"), F.col("lag_1"), F.col("lag_2"))
    return rounded(rows.select("entity_id", "t", value.alias("forecast")))


@query("tail_guard", f"per AS (SELECT entity_id, {_EWM} AS e, {_tail('min', 6)} AS low FROM train GROUP BY entity_id) SELECT entity_id, t, round(CASE WHEN low = 0 THEN 0.0 ELSE e END, 4) AS forecast FROM per CROSS JOIN ahead")
def tail_guard(spark, d):
    panel = staged(_train(spark, d), "panel")
    model = FC.expand_horizon(per_entity(panel, A.ewm_last(6, X.LAST).alias("forecast")), X.LAST)
    return rounded(H.tail_guard(model.select("entity_id", "t", "forecast"), panel))


@query(
    "blend_files",
    f"per AS (SELECT entity_id, {_GEO66} AS g, {boost_sql()} AS b, {_tail('min', 6)} AS low, {_tail('avg', 6)} AS m, {trend_sql(3, 0.7, 1.5)} AS r FROM train GROUP BY entity_id) "
    f"SELECT CAST(1995 + t // 12 AS VARCHAR) || ' ' || {MONTH_NAME}[t % 12 + 1] || '_sector ' || CAST(entity_id AS VARCHAR) AS id, "
    "round(0.4 * g * CASE WHEN t % 12 = 11 THEN b ELSE 1.0 END + 0.35 * CASE WHEN low = 0 THEN 0.0 ELSE m END + 0.25 * g * r * CASE WHEN t % 12 = 11 THEN least(b, 1.8) ELSE 1.0 END, 3) AS forecast "
    "FROM per CROSS JOIN ahead",
)
def blend_files(spark, d):
    from ..sources import sinks, tables

    panel = staged(_train(spark, d), "panel")
    paths = []
    for fc in (FC.forecast_seasonal(panel), FC.forecast_mean(panel), FC.forecast_trend(panel)):
        paths.append(scratch_path(spark, "blend"))
        numbered = H.with_ids(fc, X.BASE_YEAR).withColumn("row_no", F.struct("t", "entity_id"))
        sinks.write_submission(numbered, paths[-1])
    files = tables.read_forecasts(spark, paths)
    out = H.blend(files, [0.4, 0.35, 0.25], value="new_house_transaction_amount")
    return rounded(out.withColumnRenamed("new_house_transaction_amount", "forecast"), 3)


_PARTS = f"{_GEO66} AS g, {_tail('median', 6)} AS md, {_tail('avg', 6)} AS mn, avg(CASE WHEN t > 54 THEN CASE WHEN amount = 0 THEN 1.0 ELSE 0.0 END END) AS pz"


@query("blend_masked", f"per AS (SELECT entity_id, {_PARTS} FROM train GROUP BY entity_id) SELECT entity_id, t, round(CASE WHEN pz > 0.1 THEN 0.0 ELSE greatest(0.5 * g + 0.3 * md + 0.2 * mn, 0.0) END, 4) AS forecast FROM per CROSS JOIN ahead")
def blend_masked(spark, d):
    per = per_entity(
        _train(spark, d), A.geo_mean_guard(6, 6, X.LAST).alias("geo"), A.tail_median(6, X.LAST).alias("md"), A.tail_mean(6, X.LAST).alias("mn"),
        F.avg(F.when(A.within(12, X.LAST), (F.col("amount") == 0).cast("double"))).alias("p_zero"),
    )
    value = H.blend_masked([F.col("geo"), F.col("md"), F.col("mn")], [0.5, 0.3, 0.2], F.col("p_zero"), 0.1)
    return rounded(FC.expand_horizon(per, X.LAST).select("entity_id", "t", value.alias("forecast")))


@query("ensemble_mean", f"per AS (SELECT entity_id, {_PARTS} FROM train GROUP BY entity_id) SELECT entity_id, t, round(CASE WHEN pz > 0.7 THEN 0.0 ELSE greatest((g + md + mn) / 3, 0.0) END, 4) AS forecast FROM per CROSS JOIN ahead")
def ensemble_mean(spark, d):
    per = per_entity(
        _train(spark, d), A.geo_mean_guard(6, 6, X.LAST).alias("geo"), A.tail_median(6, X.LAST).alias("md"), A.tail_mean(6, X.LAST).alias("mn"),
        F.avg(F.when(A.within(12, X.LAST), (F.col("amount") == 0).cast("double"))).alias("p_zero"),
    )
    value = H.ensemble_mean([F.col("geo"), F.col("md"), F.col("mn")], F.col("p_zero"))
    return rounded(FC.expand_horizon(per, X.LAST).select("entity_id", "t", value.alias("forecast")))


# ---- metrics ----

_PAIRS = f"""
per AS (SELECT entity_id, {_GEO66} AS base, {boost_sql()} AS boost FROM train GROUP BY entity_id),
pairs AS (SELECT p.entity_id, p.t, p.amount AS y, CASE WHEN p.t % 12 = 11 THEN base * boost ELSE base END AS p
          FROM panel p JOIN per ON per.entity_id = p.entity_id JOIN ahead ON ahead.t = p.t)
"""


def _pairs(spark, d) -> DataFrame:
    """Forecast and truth of every horizon cell, from one pass over the panel."""
    per = per_entity(
        X.panel(spark, d, X.END),
        A.geo_mean_guard(6, 6, X.LAST).alias("base"), A.december_boost(X.LAST).alias("boost"),
        F.collect_list(F.when(F.col("t") > X.LAST, F.struct("t", F.col("amount").alias("y")))).alias("ahead"),
    )
    cells = per.select("entity_id", "base", "boost", F.inline("ahead"))
    return cells.select("entity_id", "t", "y", S.apply_december(F.col("base"), F.col("boost")).alias("p"))


_SCORE, _RATE = score_sql()


@query("two_stage_score", _PAIRS + f"SELECT round({_SCORE}, 6) AS score, round({_RATE}, 6) AS good_rate FROM pairs")
def two_stage_score(spark, d):
    return rounded(M.two_stage_score(_pairs(spark, d)), 6)


@query("two_stage_score_strict", _PAIRS + f"SELECT t, round({score_sql(fails='<')[0]}, 6) AS score, round({_RATE}, 6) AS good_rate FROM pairs GROUP BY t")
def two_stage_score_strict(spark, d):
    return rounded(M.two_stage_score_strict(_pairs(spark, d), ("t",)), 6)


@query("two_stage_score_cut", _PAIRS + f"SELECT t, round({score_sql(threshold=0.3, fails='<')[0]}, 6) AS score, round({_RATE}, 6) AS good_rate FROM pairs GROUP BY t")
def two_stage_score_cut(spark, d):
    return rounded(M.two_stage_score_strict(_pairs(spark, d), ("t",), threshold=0.3), 6)


@query(
    "two_stage_score_clipped",
    _PAIRS + "SELECT round(CASE WHEN avg(CASE WHEN a > 1 THEN 1.0 ELSE 0.0 END) > 0.3 THEN 0.0 ELSE greatest(0.0, 1 - avg(CASE WHEN a <= 1 THEN a END) / "
    "(avg(CASE WHEN a <= 1 THEN 1.0 ELSE 0.0 END) + 1e-12)) END, 6) AS score, round(avg(CASE WHEN a <= 1 THEN 1.0 ELSE 0.0 END), 6) AS good_rate "
    "FROM (SELECT abs((y - greatest(p - 20000, 0)) / greatest(y, 1e-12)) AS a FROM pairs)",
)
def two_stage_score_clipped(spark, d):
    shifted = _pairs(spark, d).withColumn("p", F.col("p") - 20000)
    return rounded(M.two_stage_score_clipped(shifted), 6)


@query(
    "local_score",
    _PAIRS + "SELECT round(CASE WHEN avg(CASE WHEN a <= 1 THEN 1.0 ELSE 0.0 END) < 0.3 THEN 0.0 ELSE avg(CASE WHEN a <= 1 THEN 1.0 ELSE 0.0 END) * avg(CASE WHEN a <= 1 THEN 1 / (1 + a) END) END, 6) AS score, "
    "round(avg(CASE WHEN a <= 1 THEN 1.0 ELSE 0.0 END), 6) AS good_rate, count(*) AS n FROM (SELECT abs(y - p) / greatest(y, 1) AS a FROM pairs)",
)
def local_score(spark, d):
    return rounded(M.local_score(_pairs(spark, d)), 6)


@query("rmse", _PAIRS + "SELECT round(sqrt(avg(pow(y - p, 2))), 3) AS rmse FROM pairs")
def rmse(spark, d):
    return rounded(_pairs(spark, d).agg(M.rmse_column().alias("rmse")), 3)


@query("mape", _PAIRS + "SELECT t, round(avg(abs((y - p) / greatest(y, 1.0))), 4) AS mape FROM pairs GROUP BY t")
def mape(spark, d):
    return rounded(_pairs(spark, d).groupBy("t").agg(M.mape_column(eps=1.0).alias("mape")))


@query(
    "ape_profile",
    _PAIRS + "SELECT round(avg(a) / 1e9, 4) AS mean_ape_e9, round(avg(CASE WHEN a < 1 THEN 1.0 ELSE 0.0 END), 6) AS share_below_1, round(avg(CASE WHEN a >= 1 THEN 1.0 ELSE 0.0 END), 6) AS share_from_1, "
    "round(median(a), 6) AS median_ape FROM (SELECT abs((y - p) / greatest(y, 1e-12)) AS a FROM pairs)",
)
def ape_profile(spark, d):
    # zero truths put the mean near 1e16, so it is shown in units of 1e9
    rows = M.ape_profile(_pairs(spark, d)).withColumn("mean_ape_e9", F.col("mean_ape") / 1e9).drop("mean_ape")
    return rounded(rows, 6, mean_ape_e9=4)


@query("prediction_counts", _PAIRS + "SELECT count(CASE WHEN p < 0 THEN 1 END) AS negative_predictions, count(CASE WHEN p = 0 THEN 1 END) AS zero_predictions, count(CASE WHEN y = 0 THEN 1 END) AS zero_truths, count(*) AS n FROM pairs")
def prediction_counts(spark, d):
    return M.prediction_counts(_pairs(spark, d))


# ---- validation and search ----

_CV = f"""
folds AS (SELECT * FROM (VALUES (0, 18), (1, 30), (2, 42), (3, 54)) AS f(fold, hi)),
per AS (SELECT fold, hi, entity_id, {geo_sql(6, 6, 'hi')} AS p FROM panel CROSS JOIN folds GROUP BY fold, hi, entity_id),
pairs AS (SELECT per.fold, a.entity_id, a.t, a.amount AS y, per.p FROM per JOIN panel a ON a.entity_id = per.entity_id AND a.t > per.hi AND a.t <= per.hi + 12)
"""


@query("cv_geo_folds", _CV + f"SELECT CAST(fold AS INTEGER) AS fold, round({_SCORE}, 6) AS score, round({_RATE}, 6) AS good_rate, round(sqrt(avg(pow(y - p, 2))), 3) AS rmse FROM pairs GROUP BY fold")
def cv_geo_folds(spark, d):
    return rounded(V.score_folds(V.cv_geo_pairs(X.panel(spark, d, X.LAST))).drop("mape"), 6, rmse=3)


@query("cv_geo_summary", _CV + f", scored AS (SELECT fold, {_SCORE} AS score FROM pairs GROUP BY fold) SELECT round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score FROM scored")
def cv_geo_summary(spark, d):
    return rounded(V.fold_summary(V.score_folds(V.cv_geo_pairs(X.panel(spark, d, X.LAST)))), 6)


@query("cv_geo_overall", _CV + f"SELECT round({_SCORE}, 6) AS score, round({_RATE}, 6) AS good_rate FROM pairs")
def cv_geo_overall(spark, d):
    return rounded(M.two_stage_score(V.cv_geo_pairs(X.panel(spark, d, X.LAST))), 6)


@query(
    "ts_folds",
    "n AS (SELECT count(DISTINCT t) AS n FROM obs WHERE t <= 66), ranked AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM obs WHERE t <= 66)), "
    "cuts AS (SELECT CAST(range AS INTEGER) AS fold, n - (4 - range) * 12 AS cut FROM range(4) CROSS JOIN n) "
    "SELECT fold, (SELECT min(t) FROM ranked) AS train_lo, a.t AS train_hi, b.t AS valid_lo, c.t AS valid_hi "
    "FROM cuts JOIN ranked a ON a.i = cut JOIN ranked b ON b.i = cut + 1 JOIN ranked c ON c.i = cut + 12",
)
def ts_folds(spark, d):
    return V.ts_folds(X.obs(spark, d, X.LAST))


_BACK = f"""
boosts AS (SELECT entity_id, {boost_sql(last='54')} AS b FROM train GROUP BY entity_id),
rolled AS (SELECT a.entity_id, a.t, a.amount AS y, CASE WHEN min(h.amount) = 0 THEN 0.0 ELSE exp(avg(ln(nullif(h.amount, 0)))) END AS g
           FROM train a JOIN train h ON h.entity_id = a.entity_id AND h.t BETWEEN a.t - 6 AND a.t - 1 WHERE a.t > 54 GROUP BY a.entity_id, a.t, a.amount)
"""


@query("rolling_backtest", _BACK + "SELECT r.entity_id, r.t, r.y, round(CASE WHEN r.t % 12 = 11 THEN g * b ELSE g END, 4) AS p FROM rolled r JOIN boosts ON boosts.entity_id = r.entity_id")
def rolling_backtest(spark, d):
    return rounded(V.rolling_backtest(X.panel(spark, d, X.LAST)))


@query("holdout_split", "SELECT entity_id, t, amount, CASE WHEN t > (SELECT max(t) FROM train) - 12 THEN 'valid' ELSE 'train' END AS role FROM train")
def holdout_split(spark, d):
    return V.holdout(X.panel(spark, d, X.LAST))


def _grid_sql(pairs: str) -> str:
    return f"""
params AS ({pairs}),
per AS (SELECT q.lookback, q.guard, entity_id, {geo_sql('q.lookback', 'q.guard', '54')} AS p FROM panel CROSS JOIN params q GROUP BY q.lookback, q.guard, entity_id),
scored AS (SELECT per.lookback, per.guard, {score_sql('a.amount', 'per.p')[0]} AS score, {score_sql('a.amount', 'per.p')[1]} AS good_rate
           FROM per JOIN panel a ON a.entity_id = per.entity_id AND a.t BETWEEN 55 AND 66 GROUP BY per.lookback, per.guard)
"""


_LOOKBACKS = "SELECT unnest([3, 6, 9, 12, 18, 24]) AS lookback"


@query("grid_lookback", _grid_sql(f"SELECT lookback, lookback AS guard FROM ({_LOOKBACKS})") + "SELECT CAST(lookback AS INTEGER) AS lookback, round(score, 6) AS score, round(good_rate, 6) AS good_rate FROM scored")
def grid_lookback(spark, d):
    return rounded(V.grid_geo(X.panel(spark, d, X.LAST), [3, 6, 9, 12, 18, 24], None).drop("guard"), 6)


@query(
    "grid_lookback_guard",
    _grid_sql(f"SELECT lookback, guard FROM ({_LOOKBACKS}) CROSS JOIN (SELECT unnest([3, 6, 9, 12]) AS guard)")
    + "SELECT CAST(lookback AS INTEGER) AS lookback, " + ", ".join(f"round(max(CASE WHEN guard = {g} THEN score END), 6) AS guard_{g}" for g in (3, 6, 9, 12)) + " FROM scored GROUP BY lookback",
)
def grid_lookback_guard(spark, d):
    grid = V.grid_geo(X.panel(spark, d, X.LAST), [3, 6, 9, 12, 18, 24], [3, 6, 9, 12])
    wide = grid.groupBy("lookback").pivot("guard", [3, 6, 9, 12]).agg(F.max("score"))
    return rounded(wide.withColumnsRenamed({str(g): f"guard_{g}" for g in (3, 6, 9, 12)}), 6)


_BLEND = f"""
per AS (SELECT entity_id, {geo_sql(6, 6, '54')} AS geo, avg(CASE WHEN t > 48 AND t <= 54 THEN amount END) AS mean6, median(CASE WHEN t > 42 AND t <= 54 THEN amount END) AS med12,
        avg(CASE WHEN t > 42 AND t <= 54 THEN CASE WHEN amount = 0 THEN 1.0 ELSE 0.0 END END) * 4 AS pz FROM train GROUP BY entity_id),
pairs AS (SELECT a.amount AS y, geo, mean6, med12, pz FROM per JOIN train a ON a.entity_id = per.entity_id AND a.t > 54)
"""


def _blend_pairs(spark, d) -> DataFrame:
    last = X.LAST - 12
    per = per_entity(
        X.panel(spark, d, X.LAST),
        A.geo_mean_guard(6, 6, last).alias("geo"), A.tail_mean(6, last).alias("mean6"), A.tail_median(12, last).alias("med12"),
        (F.avg(F.when(A.within(12, last), (F.col("amount") == 0).cast("double"))) * 4).alias("pz"),
        F.collect_list(F.when(F.col("t") > last, F.col("amount"))).alias("ys"),
    )
    return per.select(F.explode("ys").alias("y"), "geo", "mean6", "med12", "pz")


@query(
    "grid_blend_alpha",
    _BLEND + f", grid AS (SELECT CAST(range AS DOUBLE) / 20 AS alpha FROM range(21)), tried AS (SELECT alpha, y, alpha * geo + (1 - alpha) * mean6 AS p FROM pairs CROSS JOIN grid) "
    f"SELECT alpha, round({_SCORE}, 6) AS score, round({_RATE}, 6) AS good_rate FROM tried GROUP BY alpha",
)
def grid_blend_alpha(spark, d):
    return rounded(V.grid_blend_alpha(_blend_pairs(spark, d), "geo", "mean6"), 6)


@query(
    "grid_blend_weights",
    _BLEND + f""",
grid AS (SELECT z AS threshold, u AS w1, v AS w2, round(1.0 - u - v, 10) AS w3 FROM (SELECT unnest([0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS z) CROSS JOIN (SELECT unnest([0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS u)
         CROSS JOIN (SELECT unnest([0.2, 0.3, 0.4]::DOUBLE[]) AS v) WHERE round(1.0 - u - v, 10) BETWEEN 0.1 AND 0.5),
tried AS (SELECT grid.*, y, CASE WHEN pz > threshold THEN 0.0 ELSE greatest(w1 * geo + w2 * mean6 + w3 * med12, 0.0) END AS p FROM pairs CROSS JOIN grid)
SELECT threshold, w1, w2, w3, round({_SCORE}, 6) AS score, round({_RATE}, 6) AS good_rate FROM tried GROUP BY threshold, w1, w2, w3
""",
)
def grid_blend_weights(spark, d):
    return rounded(V.grid_blend_weights(_blend_pairs(spark, d), ("geo", "mean6", "med12"), "pz"), 6)


@query(
    "custom_forecaster",
    "per AS (SELECT entity_id, avg(CASE WHEN t > 54 THEN amount END) AS level, "
    "(avg(CASE WHEN t > 60 THEN amount END) - avg(CASE WHEN t > 54 AND t <= 60 THEN amount END)) / 6 AS slope FROM train GROUP BY entity_id) "
    "SELECT entity_id, t, round(greatest(level + slope * (t - 66), 0.0), 4) AS forecast FROM per CROSS JOIN ahead",
)
def custom_forecaster(spark, d):
    def drift(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows.loc[rows["t"] <= X.LAST, "amount"].tail(12)
        slope = (known.tail(6).mean() - known.head(6).mean()) / 6
        steps = range(1, X.STEPS + 1)
        values = [max(known.mean() + slope * s, 0.0) for s in steps]
        return pd.DataFrame({"entity_id": int(rows["entity_id"].iloc[0]), "t": [X.LAST + s for s in steps], "forecast": values})

    return rounded(custom.custom_forecaster(X.panel(spark, d, X.LAST), drift))
