"""Columns, filters, joins, grids and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C, keys as K
from ..operators import forecast as FC, grid as G, horizon as H, joins as J, lags as L, learn as ML, peers as P, seasonal as S, validation as V
from ..session import staged
from ..sources import fixtures as X
from .registry import boost_sql, geo_sql, half_up, half_up_sql, query, rounded

_W = "OVER (PARTITION BY entity_id ORDER BY t)"


def _lag(k: int) -> str:
    return f"lag(amount, {k}) {_W}"


def _roll(agg: str, w: int, x: str = "amount") -> str:
    frame = f"OVER (PARTITION BY entity_id ORDER BY t ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {frame} = {w} THEN {agg}({x}) {frame} END"


def _geo(w: int) -> str:
    return f"exp({_roll('avg', w, 'ln(nullif(amount, 0))')})"


def _lags_sql(source: str, ks=(1, 2, 3, 6, 12)) -> str:
    return f"SELECT entity_id, t, amount, {', '.join(f'{_lag(k)} AS lag_{k}' for k in ks)} FROM {source}"


_LAG_FRAME = (
    "SELECT entity_id, t, amount, "
    + ", ".join(f"{_lag(k)} AS lag_{k}" for k in (1, 2, 3, 6, 12))
    + ", "
    + ", ".join(f"round({_roll('avg', w)}, 4) AS roll_mean_{w}, round({_geo(w)}, 4) AS roll_geo_mean_{w}" for w in (3, 6, 12))
)
_LAGGED = "lagged AS (" + _lags_sql("panel") + ")\n"


def _lagged(spark, d):
    return L.lags(X.panel(spark, d))


# ---- columns ----


@query("add_prefix", "SELECT entity_id, t, num AS pht_num, area AS pht_area, amount AS pht_amount, amount / area AS pht_price FROM second_hand")
def add_prefix(spark, d):
    return C.add_prefix(X.second_hand(spark, d), "pht")


@query(
    "fill_sentinel",
    _LAGGED + "SELECT entity_id, t, amount, " + ", ".join(f"coalesce(lag_{k}, -1.0) AS lag_{k}" for k in (1, 2, 3, 6, 12)) + " FROM lagged",
)
def fill_sentinel(spark, d):
    return C.fill_sentinel(_lagged(spark, d), -1.0)


@query(
    "impute_median",
    _LAGGED + "SELECT entity_id, t, "
    + ", ".join(f"round(coalesce(lag_{k}, (SELECT median(lag_{k}) FROM lagged WHERE t <= 66)), 4) AS lag_{k}" for k in (1, 2, 3, 6, 12))
    + " FROM lagged",
)
def impute_median(spark, d):
    rows = _lagged(spark, d)
    cols = [f"lag_{k}" for k in (1, 2, 3, 6, 12)]
    return rounded(C.impute_median(rows, rows.where(F.col("t") <= X.LAST), cols).drop("amount"))


@query(
    "clip_range",
    _LAGGED + "SELECT entity_id, t, CASE WHEN lag_1 < 50000 THEN 50000.0 WHEN lag_1 > 200000 THEN 200000.0 ELSE lag_1 END AS clipped, "
    "CASE WHEN lag_1 - 100000 < 0 THEN 0.0 ELSE round(lag_1 - 100000, 2) END AS floored FROM lagged",
)
def clip_range(spark, d):
    lag = F.col("lag_1")
    return _lagged(spark, d).select(
        "entity_id", "t", C.clip(lag, 50000.0, 200000.0).alias("clipped"), F.round(C.clip(lag - 100000, lo=0.0), 2).alias("floored")
    )


@query(
    "lag_ratio",
    _LAGGED + "SELECT entity_id, t, " + ", ".join(f"round(lag_1 / (lag_{k} + 1), 4) AS ratio_lag1_lag{k}" for k in (1, 3, 6)) + " FROM lagged",
)
def lag_ratio(spark, d):
    return rounded(C.lag_ratio(_lagged(spark, d))).select("entity_id", "t", *[f"ratio_lag1_lag{k}" for k in (1, 3, 6)])


@query(
    "zero_flags",
    _LAGGED + "SELECT entity_id, t, CAST(coalesce(lag_1 = 0, false) AS INTEGER) AS lag1_is_zero, CAST(coalesce(lag_3 = 0, false) AS INTEGER) AS lag3_is_zero FROM lagged",
)
def zero_flags(spark, d):
    return C.zero_flags(_lagged(spark, d)).select("entity_id", "t", "lag1_is_zero", "lag3_is_zero")


_ROW_STATS = """
stats AS (
  SELECT entity_id, t, stddev_samp(v) AS s, avg(v) AS m
  FROM (SELECT entity_id, t, unnest([lag_1, lag_2, lag_3, lag_6, lag_12]) AS v FROM lagged) GROUP BY entity_id, t)
"""


@query("row_lag_stats", _LAGGED + "," + _ROW_STATS + "SELECT entity_id, t, round(s, 4) AS lag_std, round(s / (m + 1), 4) AS lag_cv FROM stats")
def row_lag_stats(spark, d):
    rows = C.row_stats(_lagged(spark, d), [f"lag_{k}" for k in (1, 2, 3, 6, 12)])
    return rounded(rows.select("entity_id", "t", "lag_std", "lag_cv"))


@query("feature_selection", _LAGGED + "SELECT entity_id, t, lag_1, lag_2, lag_3, lag_6, lag_12 FROM lagged WHERE lag_12 IS NOT NULL")
def feature_selection(spark, d):
    """The columns that a learner takes by name, without the rows that have gaps in them."""
    rows = _lagged(spark, d)
    names = C.feature_cols(rows, ("lag_",))
    return rows.select("entity_id", "t", *names).dropna(subset=names)


@query("compact_types", "SELECT entity_id, t, CAST(num AS TINYINT) AS num, CAST(amount AS FLOAT) AS amount FROM obs")
def compact_types(spark, d):
    rows = X.obs(spark, d).select("entity_id", "t", "num", "amount", F.lit(0).alias("nothing"))
    return C.cast_floats(C.compact_types(rows))


@query(
    "month_multiplier",
    "SELECT entity_id, t, round(amount * CASE t % 12 + 1 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 1.05 WHEN 6 THEN 1.05 WHEN 11 THEN 1.05 ELSE 1.0 END, 4) AS adjusted FROM panel",
)
def month_multiplier(spark, d):
    return rounded(X.panel(spark, d).select("entity_id", "t", (F.col("amount") * C.month_multiplier(K.month_of())).alias("adjusted")))


_YEARLY = """
yearly AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total,
           round(avg(o_totalprice), 2) AS avg_price FROM orders GROUP BY 1)
"""


@query("yearly_head", _YEARLY + "SELECT year, n_orders, total FROM yearly ORDER BY year LIMIT 6")
def yearly_head(spark, d):
    return X.yearly(spark, d).orderBy("year").limit(6).drop("avg_price")


@query(
    "align_columns",
    _LAGGED + "SELECT entity_id, t, lag_1, lag_3, CAST(-1 AS DOUBLE) AS roll_mean_3, CAST(-1 AS DOUBLE) AS ewm_6 FROM lagged WHERE t > 66",
)
def align_columns(spark, d):
    # only lag_1..3 exist for the horizon; the model also wants two rolling columns
    rows = L.lags(X.panel(spark, d), (1, 2, 3)).where(F.col("t") > X.LAST)
    return C.align_columns(rows, ["lag_1", "lag_3", "roll_mean_3", "ewm_6"], -1.0)


# ---- filters ----


@query(
    "fold_assignment",
    """
folds AS (SELECT * FROM (VALUES (0, 18, 19, 30), (1, 30, 31, 42), (2, 42, 43, 54), (3, 54, 55, 66)) AS f(fold, train_hi, valid_lo, valid_hi))
SELECT CAST(f.fold AS INTEGER) AS fold, CASE WHEN p.t <= f.train_hi THEN 'train' ELSE 'valid' END AS role, p.entity_id, p.t, p.amount
FROM panel p JOIN folds f ON p.t BETWEEN 0 AND f.train_hi OR p.t BETWEEN f.valid_lo AND f.valid_hi
""",
)
def fold_assignment(spark, d):
    return V.assign_folds(X.panel(spark, d)).drop("train_hi")


@query(
    "model_matrix",
    f"framed AS ({_LAG_FRAME} FROM train) SELECT entity_id, t, amount AS y, "
    + ", ".join(f"{c}" for c in ML.lag_feature_names())
    + ", CAST(t % 12 + 1 AS INTEGER) AS month_num FROM framed WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in ML.lag_feature_names()),
)
def model_matrix(spark, d):
    return rounded(ML.model_matrix(X.panel(spark, d, X.LAST)))


@query("latest_snapshot", "SELECT entity_id, t, amount FROM train WHERE t = (SELECT max(t) FROM train)")
def latest_snapshot(spark, d):
    return G.latest(X.panel(spark, d, X.LAST))


@query(
    "semi_filter",
    "SELECT entity_id, t, amount FROM panel WHERE t IN (SELECT t FROM horizon) AND entity_id IN (SELECT entity_id FROM obs WHERE t = 66)",
)
def semi_filter(spark, d):
    active = X.obs(spark, d).where(F.col("t") == X.LAST)
    return J.semi_filter(X.panel(spark, d).where(G.between(X.LAST + 1, X.END)), active)


@query(
    "force_zero",
    f"per AS (SELECT entity_id, {geo_sql()} AS base FROM train GROUP BY entity_id) "
    "SELECT entity_id, t, CASE WHEN entity_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) THEN 0.0 ELSE round(base, 4) END AS forecast FROM per CROSS JOIN ahead",
)
def force_zero(spark, d):
    # suppliers in debt stand for the entities that a user wants at zero
    debtors = X.table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("bigint").alias("entity_id"))
    return rounded(G.force_zero(FC.forecast_geo(X.panel(spark, d, X.LAST)), debtors))


# ---- joins ----


@query("densify_panel", "SELECT entity_id, t, amount FROM panel")
def densify_panel(spark, d):
    return X.panel(spark, d)


_STATIC = """
parts AS (SELECT CAST(l_suppkey AS BIGINT) AS entity_id, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1),
statics AS (
  SELECT CAST(s.s_suppkey AS BIGINT) AS entity_id, s.s_acctbal, s.s_nationkey AS n_nationkey, r.r_regionkey, coalesce(p.n_parts, 0) AS n_parts
  FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN parts p ON p.entity_id = s.s_suppkey)
"""


@query("join_static", _STATIC + "SELECT p.*, s.s_acctbal, s.n_nationkey, s.r_regionkey, s.n_parts FROM panel p LEFT JOIN statics s ON s.entity_id = p.entity_id")
def join_static(spark, d):
    return J.join_static(X.panel(spark, d), X.entity_static(spark, d))


@query(
    "join_yearly",
    _YEARLY + "SELECT p.*, CAST(1995 + p.t // 12 AS INTEGER) AS year, y.n_orders, y.total, y.avg_price FROM panel p LEFT JOIN yearly y ON y.year = 1995 + p.t // 12",
)
def join_yearly(spark, d):
    return J.join_yearly(X.panel(spark, d), X.yearly(spark, d), X.BASE_YEAR)


_NEAR = """
near AS (
  SELECT a.entity_id, b.t, avg(b.amount) AS m, sum(b.amount) AS s, max(b.amount) AS x, stddev_samp(b.amount) AS sd
  FROM entities a JOIN entities o ON o.n_nationkey = a.n_nationkey AND o.entity_id <> a.entity_id
  JOIN panel b ON b.entity_id = o.entity_id GROUP BY a.entity_id, b.t)
"""
_NEAR_COLS = f"{half_up_sql('n.m')} AS amount_peer_mean, round(n.s, 2) AS amount_peer_sum, n.x AS amount_peer_max, round(n.sd, 3) AS amount_peer_std"


@query("nearby_agg", _NEAR + f"SELECT p.entity_id, p.t, {_NEAR_COLS} FROM panel p LEFT JOIN near n ON n.entity_id = p.entity_id AND n.t = p.t")
def nearby_agg(spark, d):
    members = X.panel(spark, d).join(X.nation_of(spark, d), "entity_id")
    rows = P.peer_stats(members, "n_nationkey", {"amount": P.STATS}).drop("n_nationkey", "amount")
    rows = rows.withColumn("amount_peer_mean", half_up("amount_peer_mean"))
    return rounded(rows, 3, amount_peer_sum=2, amount_peer_mean=4)


@query(
    "join_nearby",
    _NEAR + f"SELECT p.*, {_NEAR_COLS}, q.amount AS second_hand_sum FROM panel p LEFT JOIN near n ON n.entity_id = p.entity_id AND n.t = p.t "
    "LEFT JOIN second_hand q ON q.entity_id = p.entity_id AND q.t = p.t",
)
def join_nearby(spark, d):
    members = X.panel(spark, d).join(X.nation_of(spark, d), "entity_id")
    panel = P.peer_stats(members, "n_nationkey", {"amount": P.STATS}).drop("n_nationkey")
    side = P.nearby_agg(X.second_hand(spark, d), "amount", ("sum",), "second_hand")
    panel = panel.withColumn("amount_peer_mean", half_up("amount_peer_mean"))
    return rounded(J.join_nearby(panel, side), 3, amount=2, amount_peer_sum=2, second_hand_sum=2, amount_peer_mean=4)


_MART_PEERS = """
others AS (SELECT a.entity_id, o.entity_id AS other FROM entities a JOIN entities o ON o.n_nationkey = a.n_nationkey AND o.entity_id <> a.entity_id),
pht_near AS (SELECT a.entity_id, b.t, avg(b.amount) AS m, sum(b.amount) AS s FROM others a JOIN second_hand b ON b.entity_id = a.other GROUP BY 1, 2),
lt_near AS (SELECT a.entity_id, b.t, avg(b.transaction_amount) AS m, sum(b.transaction_amount) AS s FROM others a JOIN land b ON b.entity_id = a.other GROUP BY 1, 2)
"""


@query(
    "feature_mart",
    _STATIC + "," + _YEARLY + "," + _NEAR + "," + _MART_PEERS + f"""
SELECT p.entity_id, p.t, p.amount,
  coalesce(q.amount, -1.0) AS pht_mean, coalesce(q.amount, -1.0) AS pht_sum, coalesce(q.amount, -1.0) AS pht_max,
  coalesce(l.transaction_amount, -1.0) AS lt_mean, coalesce(l.transaction_amount, -1.0) AS lt_sum, coalesce(l.transaction_amount, -1.0) AS lt_max,
  s.s_acctbal, s.n_nationkey, s.r_regionkey, s.n_parts,
  coalesce({half_up_sql('n.m')}, -1.0) AS nht_nearby_mean, coalesce(round(n.s, 2), -1.0) AS nht_nearby_sum,
  coalesce(n.x, -1.0) AS nht_nearby_max, coalesce(round(n.sd, 3), -1.0) AS nht_nearby_std,
  coalesce({half_up_sql('pn.m')}, -1.0) AS pht_nearby_mean, coalesce(round(pn.s, 2), -1.0) AS pht_nearby_sum,
  coalesce({half_up_sql('ln2.m')}, -1.0) AS lt_nearby_mean, coalesce(round(ln2.s, 2), -1.0) AS lt_nearby_sum,
  CAST(1995 + p.t // 12 AS INTEGER) AS year, coalesce(y.n_orders, -1) AS n_orders, coalesce(y.total, -1.0) AS total, coalesce(y.avg_price, -1.0) AS avg_price
FROM panel p
LEFT JOIN second_hand q ON q.entity_id = p.entity_id AND q.t = p.t
LEFT JOIN land l ON l.entity_id = p.entity_id AND l.t = p.t
LEFT JOIN statics s ON s.entity_id = p.entity_id
LEFT JOIN near n ON n.entity_id = p.entity_id AND n.t = p.t
LEFT JOIN pht_near pn ON pn.entity_id = p.entity_id AND pn.t = p.t
LEFT JOIN lt_near ln2 ON ln2.entity_id = p.entity_id AND ln2.t = p.t
LEFT JOIN yearly y ON y.year = 1995 + p.t // 12
""",
)
def feature_mart(spark, d):
    facts = X.all_facts(spark, d)
    end = facts.agg(F.max("t")).scalar()
    mart = J.build_mart(X.entities(spark, d), 0, end, facts, X.entity_static(spark, d), X.yearly(spark, d), X.BASE_YEAR)
    means = [c for c in mart.columns if c.endswith("_nearby_mean")]
    mart = mart.withColumns({c: F.when(F.col(c) == -1.0, -1.0).otherwise(half_up(c)) for c in means})
    return rounded(mart, 3, **{c: 2 for c in mart.columns if c.endswith("_sum")}, **{c: 4 for c in means})


@query(
    "shift_join",
    "SELECT p.entity_id, p.t, p.num, p.amount, " + ", ".join(f"s{m}.num AS num_{m}, s{m}.amount AS amount_{m}" for m in (1, 2, 12)) + " FROM obs p "
    + " ".join(f"LEFT JOIN obs s{m} ON s{m}.entity_id = p.entity_id AND s{m}.t = p.t - {m}" for m in (1, 2, 12)),
)
def shift_join(spark, d):
    return L.shift_join(X.obs(spark, d).select("entity_id", "t", "num", "amount"), (1, 2, 12), ("num", "amount"))


_OBS = ("num", "area", "amount", "price", "area_per_unit", "total_price_per_unit")


@query(
    "shift_all",
    "wide AS (SELECT entity_id, t, num, area, amount, amount / area AS price, area / num AS area_per_unit, amount / num AS total_price_per_unit FROM obs) "
    "SELECT p.*, " + ", ".join(f"s{m}.{c} AS {c}_{m}" for m in (1, 2, 12) for c in _OBS) + " FROM wide p "
    + " ".join(f"LEFT JOIN wide s{m} ON s{m}.entity_id = p.entity_id AND s{m}.t = p.t - {m}" for m in (1, 2, 12)),
)
def shift_all(spark, d):
    """Every column of the observations, of the period itself and of three earlier ones."""
    return L.shift_join(X.obs(spark, d))


@query(
    "align_to_horizon",
    f"per AS (SELECT entity_id, {geo_sql()} AS base FROM train GROUP BY entity_id) "
    "SELECT h.row_no, h.id, round(coalesce(p.base, 0.0), 4) AS forecast FROM horizon h LEFT JOIN per p ON p.entity_id = h.entity_id",
)
def align_to_horizon(spark, d):
    return rounded(J.align_to_horizon(X.horizon(spark, d), FC.forecast_geo(X.panel(spark, d, X.LAST))))


@query(
    "id_mismatch",
    "SELECT count(*) FILTER (WHERE r.t IS NULL) AS left_only, count(*) FILTER (WHERE h.t IS NULL) AS right_only, count(*) FILTER (WHERE h.t IS NOT NULL AND r.t IS NOT NULL) AS both "
    "FROM horizon h FULL JOIN (SELECT entity_id, CAST(unnest(range(67, 85)) AS INTEGER) AS t FROM entities) r ON r.entity_id = h.entity_id AND r.t = h.t",
)
def id_mismatch(spark, d):
    # a forecast file that reaches further and lacks the unseen entity
    return J.id_mismatch(X.horizon(spark, d), H.with_ids(FC.forecast_geo(X.panel(spark, d, X.LAST), steps=18), X.BASE_YEAR))


@query(
    "join_fanout_check",
    "joined AS (SELECT p.entity_id, p.t FROM panel p LEFT JOIN obs o ON o.entity_id = p.entity_id AND o.t = p.t) "
    "SELECT count(*) AS n_rows, count(DISTINCT (entity_id, t)) AS n_keys, count(*) = count(DISTINCT (entity_id, t)) AS is_unique FROM joined",
)
def join_fanout_check(spark, d):
    return J.join_fanout(J.attach_target(X.panel(spark, d).select("entity_id", "t"), X.obs(spark, d)))


def _tail(agg: str, n: int, last: int = 66) -> str:
    return f"{agg}(CASE WHEN t > {last} - {n} AND t <= {last} THEN amount END)"


@query(
    "horizon_features",
    "per AS (SELECT entity_id, "
    + ", ".join(f"max(CASE WHEN t = 66 - {k} THEN amount END) AS lag_{k + 1}" for k in range(3))
    + ", " + ", ".join(f"round({_tail('avg', w)}, 4) AS roll_mean_{w}, round({_tail('stddev_samp', w)}, 4) AS roll_std_{w}" for w in (3, 6, 12))
    + " FROM train GROUP BY entity_id) SELECT per.*, t, CAST(t % 12 + 1 AS INTEGER) AS month_num, CAST(1995 + t // 12 AS INTEGER) AS year, "
    "CAST((t % 12) // 3 + 1 AS INTEGER) AS quarter, CAST(t % 12 = 11 AS INTEGER) AS is_december, "
    "CAST(CASE WHEN t % 12 IN (11, 0, 1) THEN 0 WHEN t % 12 < 5 THEN 1 WHEN t % 12 < 8 THEN 2 ELSE 3 END AS INTEGER) AS season FROM per CROSS JOIN ahead",
)
def horizon_features(spark, d):
    return rounded(J.horizon_features(X.panel(spark, d, X.LAST), X.LAST, X.STEPS, X.BASE_YEAR))


@query(
    "join_boost",
    f"per AS (SELECT entity_id, {boost_sql()} AS boost FROM train GROUP BY entity_id) "
    "SELECT p.*, round(b.boost, 6) AS boost FROM panel p LEFT JOIN per b ON b.entity_id = p.entity_id",
)
def join_boost(spark, d):
    return rounded(S.join_boost(X.panel(spark, d), X.LAST), 6)


# ---- windows ----


@query("lags_present", _lags_sql("obs", (1, 2, 3, 4, 5, 6, 12)))
def lags_present(spark, d):
    return L.lags(X.obs(spark, d).select("entity_id", "t", "amount"), (1, 2, 3, 4, 5, 6, 12))


@query("lags_dense", _lags_sql("panel", (1, 2, 3, 4, 5, 6, 12)))
def lags_dense(spark, d):
    return L.lags(X.panel(spark, d), (1, 2, 3, 4, 5, 6, 12))


def _rolling_sql(agg: str, name: str) -> str:
    return "SELECT entity_id, t, " + ", ".join(f"round({_roll(agg, w)}, 4) AS {name}_{w}" for w in (3, 6, 12)) + " FROM panel"


@query("rolling_mean", _rolling_sql("avg", "roll_mean"))
def rolling_mean(spark, d):
    return rounded(L.rolling(X.panel(spark, d), "mean").drop("amount"))


@query("rolling_geo_mean", "SELECT entity_id, t, " + ", ".join(f"round({_geo(w)}, 4) AS roll_geo_mean_{w}" for w in (3, 6, 12)) + " FROM panel")
def rolling_geo_mean(spark, d):
    return rounded(L.rolling(X.panel(spark, d), "geo").drop("amount"))


@query("rolling_std", _rolling_sql("stddev_samp", "roll_std").replace(", 4)", ", 3)"))
def rolling_std(spark, d):
    return rounded(L.rolling(X.panel(spark, d), "std").drop("amount"), 3)


@query("rolling_max", _rolling_sql("max", "roll_max"))
def rolling_max(spark, d):
    return rounded(L.rolling(X.panel(spark, d), "max").drop("amount"))


def _current(agg: str, w: int, name: str) -> str:
    frame = f"OVER (PARTITION BY entity_id ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count(amount) {frame} = {w} THEN {agg}(amount) {frame} END, 4) AS {name}_cur_{w}"


@query(
    "rolling_min_current",
    "SELECT entity_id, t, "
    + ", ".join(_current(a, w, n) for a, n in (("avg", "roll_mean"), ("min", "roll_min"), ("max", "roll_max")) for w in (3, 6, 12))
    + " FROM panel",
)
def rolling_min_current(spark, d):
    rows = X.panel(spark, d)
    for kind in ("mean", "min", "max"):
        rows = L.rolling_current(rows, kind)
    return rounded(rows.drop("amount"))


@query(
    "ewm_running",
    f"SELECT entity_id, t, amount, {half_up_sql('sum(amount * pow(1.4, t)) OVER before / sum(pow(1.4, t)) OVER before')} AS ewm_6 FROM panel "
    "WINDOW before AS (PARTITION BY entity_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def ewm_running(spark, d):
    rows = L.ewm_running(X.panel(spark, d), 6)
    return rounded(rows.withColumn("ewm_6", half_up("ewm_6")), amount=2)


@query(
    "growth_rate",
    "SELECT entity_id, t, " + ", ".join(f"round(amount / nullif({_lag(k)}, 0) - 1, 6) + 0.0 AS growth_{k}" for k in (1, 3)) + " FROM panel",
)
def growth_rate(spark, d):
    return rounded(L.pct_change(X.panel(spark, d)).drop("amount"), 6)


@query("label_next", f"SELECT entity_id, t, amount, lead(amount, 1) {_W} AS label FROM panel")
def label_next(spark, d):
    return L.label_next(X.panel(spark, d))


@query(
    "tail_present",
    "SELECT entity_id, t, amount FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY t DESC) AS rn FROM obs WHERE t <= 66) WHERE rn <= 6",
)
def tail_present(spark, d):
    return G.tail_present(X.obs(spark, d, X.LAST).select("entity_id", "t", "amount"), 6)


@query("features_at", f"framed AS ({_LAG_FRAME} FROM panel WHERE t <= 67) SELECT * EXCLUDE (amount) FROM framed WHERE t = 67")
def features_at(spark, d):
    return rounded(L.features_at(X.panel(spark, d, X.LAST), X.LAST + 1, X.entities(spark, d)))


@query("lag_feature_frame", f"{_LAG_FRAME} FROM obs")
def lag_feature_frame(spark, d):
    return rounded(L.lag_features(X.obs(spark, d).select("entity_id", "t", "amount")))


@query(
    "advanced_features",
    f"framed AS ({_LAG_FRAME} FROM panel)," + _ROW_STATS.replace("lagged", "framed")
    + "SELECT f.*, round(sin(2 * pi() * (f.t % 12) / 12), 4) + 0.0 AS sin_12, round(cos(2 * pi() * (f.t % 12) / 12), 4) + 0.0 AS cos_12, "
    "round(f.t / (SELECT max(t) FROM panel), 4) AS year_progress, "
    + ", ".join(f"round(lag_1 / (lag_{k} + 1), 4) AS ratio_lag1_lag{k}" for k in (1, 3, 6))
    + ", CAST(coalesce(lag_1 = 0, false) AS INTEGER) AS lag1_is_zero, CAST(coalesce(lag_3 = 0, false) AS INTEGER) AS lag3_is_zero, "
    "round(s, 4) AS lag_std, round(s / (m + 1), 4) AS lag_cv FROM framed f JOIN stats ON stats.entity_id = f.entity_id AND stats.t = f.t",
)
def advanced_features(spark, d):
    return rounded(L.advanced_features(X.panel(spark, d), t_max=X.last_period(spark, d)))


# ---- sets and layouts ----


@query("entity_union", "SELECT entity_id FROM obs UNION SELECT entity_id FROM horizon")
def entity_union(spark, d):
    return G.entity_union(X.obs(spark, d), X.horizon_entities(spark, d))


@query("missing_entities", "SELECT entity_id FROM horizon EXCEPT SELECT entity_id FROM obs WHERE t <= 66")
def missing_entities(spark, d):
    return G.missing_entities(X.obs(spark, d, X.LAST), X.horizon_entities(spark, d))


@query(
    "synthetic_history",
    "medians AS (SELECT t, median(amount) AS m FROM train GROUP BY t), "
    "missing AS (SELECT entity_id FROM horizon EXCEPT SELECT entity_id FROM obs WHERE t <= 66) "
    "SELECT entity_id, t, amount FROM train WHERE entity_id IN (SELECT entity_id FROM obs WHERE t <= 66) "
    "UNION ALL SELECT entity_id, t, round(m * 0.7, 4) FROM missing CROSS JOIN medians",
)
def synthetic_history(spark, d):
    from ..operators.profile import time_medians

    panel = staged(X.panel(spark, d, X.LAST), "panel")
    missing = G.missing_entities(X.obs(spark, d, X.LAST), X.horizon_entities(spark, d))
    made = G.synthetic_history(missing, time_medians(panel), 0.7)
    return rounded(G.with_synthetic(panel, missing, made))


#: The declared columns of the pivot: the months of the line items. A later one stops the job.
_PERIODS = list(range(83))


@query("pivot_wide", "SELECT entity_id, " + ", ".join(f"coalesce(sum(amount) FILTER (t = {t}), 0.0) AS t{t}" for t in _PERIODS) + " FROM panel GROUP BY entity_id")
def pivot_wide(spark, d):
    return G.to_wide(X.panel(spark, d), _PERIODS, prefix="t", strict=True)


@query("unpivot_long", "SELECT entity_id, t, amount FROM panel")
def unpivot_long(spark, d):
    wide = G.to_wide(X.panel(spark, d), _PERIODS, prefix="t", strict=True)
    return G.to_long(wide, [f"t{t}" for t in _PERIODS], prefix="t")


@query("distinct_entities", "SELECT count(DISTINCT entity_id) AS n_entities, count(DISTINCT t) AS n_periods FROM obs")
def distinct_entities(spark, d):
    return X.obs(spark, d).agg(F.count_distinct("entity_id").alias("n_entities"), F.count_distinct("t").alias("n_periods"))
