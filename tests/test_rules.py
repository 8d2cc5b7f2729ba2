"""Edge rules on tiny panels."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import columns as C, keys as K
from tidepanel.functions.quantiles import exact_quantiles
from tidepanel.operators import forecast as FC, grid as G, horizon as H, joins as J, lags as L, metrics as M, peers as P, profile as R, tails as A, validation as V
from tidepanel.plans import QUERIES


def one(df):
    return df.first().asDict()


def test_month_texts(spark):
    df = spark.createDataFrame([("2019-Jan",), ("2019 Jan",), ("2024-Jul",), ("2019-Foo",)], "month string")
    assert [r["t"] for r in K.parse_month(df).collect()] == [0, 0, 66, None]


def test_explode_id_default(spark):
    df = spark.createDataFrame([("2024 Aug_sector 1",), ("2024 Xxx_sector 12",)], "id string")
    rows = K.explode_id(df, default_t=67).collect()
    assert [(r["t"], r["entity_id"]) for r in rows] == [(67, 1), (67, 12)]


def test_all_zero(panel):
    p = panel({1: [0] * 24})
    row = one(p.groupBy("entity_id").agg(A.geo_mean_guard(6, 6, 23).alias("g"), A.december_boost(23).alias("b"), A.adaptive_lookback(23).alias("n")))
    assert (row["g"], row["b"], row["n"]) == (0.0, 1.3, 6)


def test_zero_outside_guard(panel):
    values = [10.0] * 24
    values[23 - 8] = 0
    p = panel({1: values})
    row = one(p.groupBy("entity_id").agg(A.geo_mean_guard(9, 6, 23).alias("skip"), A.geo_mean_guard(9, 9, 23).alias("hit")))
    assert row["skip"] == pytest.approx(10.0) and row["hit"] == 0.0


def test_single_positive(panel):
    p = panel({1: [0] * 11 + [5]})
    assert one(p.groupBy("entity_id").agg(F.stddev_samp(F.when(F.col("amount") > 0, F.col("amount"))).alias("s")))["s"] is None
    first = L.rolling(p, "mean", (3,)).orderBy("t").collect()
    assert [r["roll_mean_3"] for r in first[:4]] == [None, None, None, 0.0]


def test_gap_present_and_dense_lags_differ(spark, panel):
    p = panel({1: [1, 2, None, 4, 5]})
    present = {r["t"]: r["lag_1"] for r in L.lags(p, (1,)).collect()}
    shifted = {r["t"]: r["amount_1"] for r in L.shift_join(p, (1,)).collect()}
    dense = G.densify(p, p.select("entity_id").distinct(), 0, 4)
    lagged = {r["t"]: r["lag_1"] for r in L.lags(dense, (1,)).collect()}
    assert present[3] == 2.0 and shifted[3] is None and lagged[3] == 0.0


def test_densify_drops_facts_off_the_grid(spark, panel):
    p = panel({1: [1, 2], 9: [7]})
    only = spark.createDataFrame([(1,), (2,)], "entity_id long")
    rows = {(r["entity_id"], r["t"]): r["amount"] for r in G.densify(p, only, 0, 2).collect()}
    assert rows == {(1, 0): 1.0, (1, 1): 2.0, (1, 2): 0.0, (2, 0): 0.0, (2, 1): 0.0, (2, 2): 0.0}


def test_cells_of_a_one_file_list_of_entities_are_dealt(spark, panel):
    ids = [*range(1, 401), 7, None, None]
    only = spark.createDataFrame([(i,) for i in ids], "entity_id long").coalesce(1)
    held = [r["count"] for r in G.cells(only, 0, 9).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 10 * len(ids) and max(held) <= sum(held) / 2
    rows = G.densify(panel({7: [1, 2]}), only, 0, 9)
    assert rows.count() == 10 * 401
    assert [r["amount"] for r in rows.where("entity_id = 7").orderBy("t").collect()] == [1.0, 2.0] + [0.0] * 8


DENSE = (
    "align_columns", "clip_range", "december_vs_rest", "densify_panel", "entity_stats", "feature_selection", "fill_sentinel", "fold_assignment", "growth_rate",
    "join_boost", "join_yearly", "label_next", "lag_ratio",
)


@pytest.mark.parametrize("name", DENSE)
def test_the_grid_of_a_query_is_dealt(spark, sf, monkeypatch, name):
    """No query makes the cells of its panel from one file of entities in one task."""
    made = []
    original = G.grid

    def grid(entities, lo, hi):
        made.append(entities.select("entity_id").groupBy(F.spark_partition_id()).count())
        return original(entities, lo, hi)

    monkeypatch.setattr(G, "grid", grid)
    QUERIES[name](spark, sf)
    held = [[r["count"] for r in parts.collect()] for parts in made]
    assert held and all(len(h) > 1 and max(h) < sum(h) for h in held)


def test_no_leak(panel):
    a, b = panel({1: range(1, 31)}), panel({1: list(range(1, 21)) + [999] * 10})
    names = L.lag_feature_names() + ["ewm_6"]
    fa, fb = (L.ewm_running(L.lag_features(x)).where("t = 20").select(*names).first() for x in (a, b))
    assert fa == fb


def test_lag_frame_matches_pandas(spark, sf):
    from tidepanel.sources import fixtures as X

    rows = L.ewm_running(L.rolling(L.rolling(L.lag_features(X.panel(spark, sf)), "std"), "max")).toPandas().sort_values(["entity_id", "t"])
    for _, g in rows.groupby("entity_id"):
        s = g["amount"].shift(1)
        np.testing.assert_allclose(g["roll_mean_6"], s.rolling(6).mean(), rtol=1e-9)
        np.testing.assert_allclose(g["roll_std_6"], s.rolling(6).std(), rtol=1e-6, atol=1e-6)
        np.testing.assert_allclose(g["roll_max_12"], s.rolling(12).max(), rtol=1e-12)
        np.testing.assert_allclose(g["roll_geo_mean_3"], np.exp(np.log(s.replace(0, np.nan)).rolling(3).mean()), rtol=1e-9)
        np.testing.assert_allclose(g["ewm_6"], s.ewm(span=6).mean(), rtol=1e-9)


def test_ewm_last_matches_pandas(panel):
    values = [3, 0, 8, 1, 9, 4]
    got = one(panel({1: values}).groupBy("entity_id").agg(A.ewm_last(6, 5).alias("e")))["e"]
    assert got == pytest.approx(pd.Series(values, dtype=float).ewm(span=6).mean().iloc[-1])


@pytest.mark.parametrize("n", [1, 2, 3, 10, 5000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.gamma(1.0, 100.0, n), 1)
    df = spark.createDataFrame(pd.DataFrame({"g": rng.integers(0, 3, n), "v": values}))
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    # a small accuracy exercises the bracketed path, whole groups are ranked otherwise
    for accuracy in (20, 10_000):
        got = one(exact_quantiles(df, "v", probs, accuracy=accuracy))
        for k, p in probs.items():
            assert got[k] == pytest.approx(np.quantile(values, p)), (k, accuracy)
        for row in exact_quantiles(df, "v", probs, by=["g"], accuracy=accuracy).collect():
            part = df.where(F.col("g") == row["g"]).toPandas()["v"]
            for k, p in probs.items():
                assert row[k] == pytest.approx(np.quantile(part, p)), (row["g"], k, accuracy)


def test_exact_quantiles_hot_value(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(7.0)).otherwise(F.col("id").cast("double")).alias("v"))
    values = df.toPandas()["v"]
    got = one(exact_quantiles(df, "v", {"q1": 0.1, "q5": 0.5, "q9": 0.9}, accuracy=100))
    for k, p in (("q1", 0.1), ("q5", 0.5), ("q9", 0.9)):
        assert got[k] == pytest.approx(np.quantile(values, p))


def test_exact_quantiles_keep_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    rows = {r["g"]: r["q"] for r in exact_quantiles(df, "v", {"q": 0.5}, by=["g"]).collect()}
    assert rows == {None: 2.0, "a": 5.0}


def test_long_history_running_mean(spark, panel):
    values = np.random.default_rng(5).gamma(2.0, 10.0, 10_000).round(2)
    got = L.ewm_running(panel({1: values})).toPandas().sort_values("t")
    np.testing.assert_allclose(got["ewm_6"], pd.Series(values).shift(1).ewm(span=6).mean(), rtol=1e-9)


def test_peers_match_pairs(spark, panel):
    rng = np.random.default_rng(3)
    p = panel({e: list(np.round(rng.gamma(1, 50, 5), 2)) for e in range(12)})
    # group 0 holds most entities, group 2 only one
    p = p.withColumn("g", F.when(F.col("entity_id") < 8, 0).when(F.col("entity_id") < 11, 1).otherwise(2))
    p = p.withColumn("amount", F.when((F.col("entity_id") == 3) & (F.col("t") == 2), F.lit(None)).otherwise(F.col("amount")))
    pdf = p.toPandas()
    for r in P.peer_stats(p, "g", {"amount": (*P.STATS, "count")}).collect():
        others = pdf[(pdf.g == r["g"]) & (pdf.t == r["t"]) & (pdf.entity_id != r["entity_id"])]["amount"].dropna()
        assert r["amount_peer_count"] == len(others)
        if len(others) == 0:
            assert r["amount_peer_mean"] is None and r["amount_peer_max"] is None
            continue
        assert r["amount_peer_mean"] == pytest.approx(others.mean())
        assert r["amount_peer_sum"] == pytest.approx(others.sum())
        assert r["amount_peer_max"] == others.max()
        if len(others) > 1:
            assert r["amount_peer_std"] == pytest.approx(others.std(), abs=1e-9)
        else:
            assert r["amount_peer_std"] is None


def test_peers_of_a_dominant_member(panel):
    p = panel({1: [10.0], 2: [20.0], 3: [30.0], 4: [1e9]}).withColumn("g", F.lit(1))
    rows = {r["entity_id"]: r for r in P.peer_stats(p, "g", {"amount": P.STATS}).collect()}
    assert (rows[4]["amount_peer_std"], rows[4]["amount_peer_mean"], rows[4]["amount_peer_sum"]) == (10.0, 20.0, 60.0)
    assert rows[1]["amount_peer_std"] == pytest.approx(np.std([20.0, 30.0, 1e9], ddof=1))


def test_peer_std_of_equal_peers_is_zero(panel):
    p = panel({1: [0.0], 2: [0.0], 3: [123456.78], 4: [0.0]}).withColumn("g", F.lit(1))
    row = one(P.peer_stats(p, "g", {"amount": P.STATS}).where("entity_id = 3"))
    assert row["amount_peer_std"] == 0.0 and row["amount_peer_max"] == 0.0


def pairs(spark, rows):
    return spark.createDataFrame([(float(y), float(p)) for y, p in rows], "y double, p double")


def test_score_at_the_threshold(spark):
    df = pairs(spark, [(10, 9)] * 7 + [(10, 100)] * 3)
    assert one(M.two_stage_score(df)) == {"score": 0.0, "good_rate": 0.7}
    assert one(M.two_stage_score_strict(df))["score"] == pytest.approx(1 - 0.1 / 0.7)
    assert one(M.two_stage_score_clipped(df))["score"] == pytest.approx(1 - 0.1 / 0.7)


def test_zero_truth(spark):
    rows = pairs(spark, [(0, 0), (0, 1)]).select(M.ape().alias("a")).collect()
    assert rows[0]["a"] == 0.0 and rows[1]["a"] >= 1e12


@pytest.mark.parametrize("rows,word", [([(-1, 1)], "negative"), ([(1, math.inf)], "finite"), ([], "no rows")])
def test_strict_score_rejects(spark, rows, word):
    df = pairs(spark, rows)
    with pytest.raises(Exception, match=word):
        M.two_stage_score_strict(df).collect()


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (9.0,)], "x double")
    assert [r[0] for r in df.select(C.clip(F.col("x"), 0.0, 5.0)).collect()] == [None, 0.0, 5.0]


def test_compact_types(spark):
    df = spark.createDataFrame([(1, 0, 5, 300, 70000, 0), (2, 1, -5, -300, 1, 0)], "entity_id long, t int, a long, b long, c long, z long")
    out = C.compact_types(df)
    assert dict(out.dtypes) == {"entity_id": "bigint", "t": "int", "a": "tinyint", "b": "smallint", "c": "int"}


def test_unseen_entity(spark, panel):
    p = panel({1: [100 + i for i in range(12)], 2: [0] * 12})
    horizon = spark.createDataFrame([(e, 12, f"x{e}", e) for e in (1, 2, 3)], "entity_id long, t int, id string, row_no long")
    present = p.where("amount > 0")
    rows = {r["entity_id"]: r["forecast"] for r in FC.forecast_damped_median(present, p, horizon, last=11).collect()}
    medians = [np.median([100 + i for i in range(12)]), 0.0]
    assert rows[1] == pytest.approx(0.3 * np.median([106, 107, 108, 109, 110, 111]))
    assert rows[2] == rows[3] == pytest.approx(0.2 * np.median(medians))
    aligned = J.align_to_horizon(horizon, FC.forecast_geo(p, last=11, steps=1)).orderBy("row_no").collect()
    assert aligned[2]["forecast"] == 0.0 and len(aligned) == 3


def test_seasonal_only_lifts_december(panel):
    values = [10.0 if t % 12 != 11 else 15.0 for t in range(24)]
    rows = {r["t"]: r["forecast"] for r in FC.forecast_seasonal(panel({1: values}), last=23, steps=12, lookback=6, guard=6).collect()}
    base = math.exp((5 * math.log(10) + math.log(15)) / 6)
    assert rows[24] == pytest.approx(base) and rows[35] == pytest.approx(base * 1.5)


def test_adaptive_lookback_reads_its_own_window(panel):
    p = panel({1: [1000, 1, 1, 900, 1, 1, 1, 1, 2, 3, 4]})
    row = one(p.groupBy("entity_id").agg(A.adaptive_lookback(10).alias("n")))
    assert row["n"] == 3
    got = FC.forecast_adaptive(p, last=10, steps=1).first()["forecast"]
    assert got == pytest.approx((2 * 3 * 4) ** (1 / 3) * 1.0 if 11 % 12 != 11 else (24 ** (1 / 3)) * 1.3)


def test_trend_ratio_without_base(panel):
    row = one(panel({1: [0, 0, 0, 5, 5, 5]}).groupBy("entity_id").agg(A.trend_ratio(3, 0.7, 1.5, 5).alias("r")))
    assert row["r"] == 1.0


def test_guards(spark, panel):
    p = panel({1: [1, 2, 3, 4, 5, 6], 2: [1, 2, 0, 4, 5, 6]})
    fc = FC.forecast_mean(p, last=5, steps=2, guard=1)
    rows = H.tail_guard(fc, p, 6, 5).collect()
    assert all((r["forecast"] == 0) == (r["entity_id"] == 2) for r in rows) and len(rows) == 4


def test_blend_needs_every_id_once_in_every_file(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "id string, forecast double")
    b = spark.createDataFrame([("x", 3.0)], "id string, forecast double")
    assert [(r["id"], r["forecast"]) for r in H.blend([a.where("id = 'x'"), b], [0.5, 0.5]).collect()] == [("x", 2.0)]
    twice = spark.createDataFrame([("x", 1.0), ("x", 1.0)], "id string, forecast double")
    for files in ([a, b], [twice, b], [twice, a.where("id = 'y'")]):
        with pytest.raises(Exception, match="not once in every file"):
            H.blend(files, [0.5, 0.5]).collect()
    assert one(J.id_mismatch(a, b)) == {"left_only": 1, "right_only": 0, "both": 1}


def test_backtest_boost_scope(panel):
    p = panel({1: [10.0 if t % 12 != 11 else 15.0 + t / 10 for t in range(36)]})
    only, everything = (V.rolling_backtest(p, 35, 12, boost_scope=s).where("t = 35").first()["p"] for s in ("train", "all"))
    assert only != everything


def test_folds_hold_whole_periods(spark, panel):
    p = panel({1: range(67), 2: range(67)})
    rows = V.ts_folds(p).orderBy("fold").collect()
    assert [(r["train_hi"], r["valid_lo"], r["valid_hi"]) for r in rows] == [(18, 19, 30), (30, 31, 42), (42, 43, 54), (54, 55, 66)]


def test_features_at_equals_the_full_frame(spark, panel):
    p = panel({1: range(1, 31), 2: range(31, 61)})
    ids = p.select("entity_id").distinct()
    at = L.features_at(p.where("t < 29"), 29, ids).orderBy("entity_id").collect()
    full = L.lag_features(p).where("t = 29").drop("amount").orderBy("entity_id").collect()
    assert [r.asDict() for r in at] == [r.asDict() for r in full]


def test_wide_and_back(panel):
    p = panel({1: [1, 2, 3], 2: [4, 5, 6]})
    wide = G.to_wide(p, [0, 1, 2, 3], prefix="t")
    assert wide.where("entity_id = 1").first()["t3"] == 0.0
    assert G.to_long(wide, ["t0", "t1", "t2"], prefix="t").exceptAll(p).count() == 0
    by_time = G.to_wide(p, [1, 2, 95], index="t", over="entity_id", prefix="e")
    assert by_time.where("t = 2").first().asDict() == {"t": 2, "e1": 3.0, "e2": 6.0, "e95": 0.0}


def test_strict_pivot_stops_at_undeclared_periods(spark, panel):
    p = panel({1: [5, 6], 2: [None, 7, 8]})
    wide = {r["entity_id"]: r.asDict() for r in G.to_wide(p, [2, 0, 1, 9], prefix="t", strict=True).collect()}
    assert list(wide[1]) == ["entity_id", "t2", "t0", "t1", "t9"]
    assert wide[1] == {"entity_id": 1, "t2": 0.0, "t0": 5.0, "t1": 6.0, "t9": 0.0} and wide[2]["t2"] == 8.0
    with pytest.raises(Exception, match="t outside the declared columns: 2"):
        G.to_wide(p, [0, 1], prefix="t", strict=True).collect()
    with pytest.raises(Exception, match="outside the declared columns: null"):
        G.to_wide(p.withColumn("t", F.when(F.col("t") > 0, F.col("t"))), [1, 2], strict=True).collect()
    assert G.to_wide(p, [0]).count() == 2


def test_correlations_of_250_columns(spark):
    rng = np.random.default_rng(3)
    wide = rng.normal(size=(400, 250)) @ np.diag(rng.uniform(1, 1e4, 250)) + rng.uniform(-1e5, 1e5, 250)
    wide[rng.random(wide.shape) < 0.1] = np.nan
    wide[:, 7] = 3.0
    wide[:, 8] = np.nan
    wide[1:, 9] = np.nan
    frame = pd.DataFrame(wide, columns=[f"c{i}" for i in range(250)])
    df = spark.createDataFrame(frame).withColumn("c10", F.when(~F.isnan("c10"), F.col("c10")))  # nulls and NaN count alike
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in R.corr_matrix(df, list(frame.columns)).collect()}
    assert len(got) == 250 * 251 // 2
    want = frame.corr()
    for i, a in enumerate(frame.columns):
        for b in frame.columns[i:]:
            w, g = want.at[a, b], got[a, b]
            assert (g is None and (math.isnan(w) or {a, b} & {"c7"})) or g == pytest.approx(w, abs=1e-9)
    some = list(frame.columns[:40])
    blocks = {(r["col_a"], r["col_b"]): r["corr"] for r in R.corr_matrix(df, some, block=16).collect()}
    assert blocks.keys() == {(a, b) for i, a in enumerate(some) for b in some[i:]}
    assert all(v is None and got[k] is None or v == pytest.approx(got[k], abs=1e-9) for k, v in blocks.items())


def test_shifts_of_250_columns(spark, panel):
    p = panel({1: list(range(30)), 2: [None, 4, None, 6]})
    wide = p.withColumns({f"c{i}": F.col("amount") + i for i in range(250)}).withColumn("_shift_1", F.lit("x"))
    out = L.shift_join(wide)
    assert len(out.columns) == 2 + 252 * 4
    start = time.time()
    rows = {(r["entity_id"], r["t"]): r for r in out.collect()}
    assert time.time() - start < 60
    assert rows[1, 20]["c249_12"] == 8.0 + 249 and rows[1, 20]["c0_1"] == 19.0 and rows[1, 1]["c5_2"] is None
    assert rows[2, 3]["amount_2"] == 4.0 and rows[2, 3]["amount_1"] is None and rows[2, 3]["_shift_1_2"] == "x"
    assert out.schema["c3_2"].dataType.simpleString() == "double"
