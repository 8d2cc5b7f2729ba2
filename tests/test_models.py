"""Learned forecasters: closed forms and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import lags as L, learn as ML, recursive as RC, validation as V
from tidepanel.sources import fixtures as X


@pytest.fixture(scope="module")
def matrix(spark, sf):
    df = ML.model_matrix(X.panel(spark, sf, X.LAST)).persist()
    df.count()
    return df


def numpy_ridge(pdf, alpha):
    x, y = pdf[ML.FEATURES].to_numpy(float), pdf["y"].to_numpy(float)
    scale = x.std(axis=0)
    z, yc = (x - x.mean(axis=0)) / scale, y - y.mean()
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ yc) / scale
    return w, y.mean() - w @ x.mean(axis=0)


@pytest.mark.parametrize("alpha", [0.001, 1.0, 19.307, 100.0])
def test_ridge_closed_form(spark, matrix, alpha):
    w, b = numpy_ridge(matrix.toPandas(), alpha)
    model = ML.fit_ridge(matrix, ML.FEATURES, alpha).model
    np.testing.assert_allclose(model.coefficients.toArray(), w, rtol=1e-5, atol=1e-7)
    assert model.intercept == pytest.approx(b, rel=1e-5)


def test_gram_path_equals_fits(spark, matrix):
    row = ML.gram(matrix.withColumn("fold", F.lit(0)), ML.FEATURES).first()
    pdf = matrix.toPandas()
    for alpha, w, b in ML.ridge_path(row, len(ML.FEATURES), [0.1, 10.0]):
        expected, intercept = numpy_ridge(pdf, alpha)
        np.testing.assert_allclose(w, expected, rtol=1e-6, atol=1e-9)
        assert b == pytest.approx(intercept, rel=1e-6)


def test_lasso_optimality(spark, matrix):
    alpha = 500.0
    pdf = matrix.toPandas()
    model = ML.fit_linear(matrix, ML.FEATURES, alpha, "lasso").model
    x, y = pdf[ML.FEATURES].to_numpy(float), pdf["y"].to_numpy(float)
    residual = y - x @ model.coefficients.toArray() - model.intercept
    scale = x.std(axis=0)
    slope = ((x - x.mean(axis=0)) / scale).T @ residual / len(y)
    w = model.coefficients.toArray()
    assert np.all(np.abs(slope) <= alpha * 1.02)
    np.testing.assert_allclose(slope[w != 0], alpha * np.sign(w[w != 0]), rtol=0.02)


def test_array_features_equal_windows(spark, sf):
    panel = X.panel(spark, sf, X.LAST)
    names = L.lag_feature_names()
    state = RC.history_state(panel, X.LAST).withColumns(RC.array_features()).select("entity_id", *names)
    window = L.features_at(panel, X.LAST + 1, X.entities(spark, sf)).select("entity_id", *names)
    a, b = (df.toPandas().sort_values("entity_id").reset_index(drop=True) for df in (state, window))
    for c in names:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9)


def test_recursion_equals_a_plain_loop(spark, sf, matrix):
    fitted = ML.fit_ridge(matrix, ML.FEATURES, 1.0)
    panel = X.panel(spark, sf, X.LAST)
    state = RC.history_state(panel, X.LAST).withColumn("dead", F.col("entity_id") == 3)
    got = RC.recursive_forecast(fitted, state, X.LAST, 6, guard="dead", checkpoint_every=2).toPandas()
    w, b = fitted.model.coefficients.toArray(), fitted.model.intercept
    for entity, rows in panel.toPandas().groupby("entity_id"):
        values = list(rows.sort_values("t")["amount"])
        for step in range(1, 7):
            tail = np.array(values[-12:])
            geo = [0.0 if (tail[-n:] <= 0).any() else np.exp(np.log(tail[-n:]).mean()) for n in (3, 6, 12)]
            x = [tail[-k] for k in (1, 2, 3, 6, 12)] + [tail[-n:].mean() for n in (3, 6, 12)] + geo + [(X.LAST + step) % 12 + 1]
            values.append(0.0 if entity == 3 else max(float(w @ np.array(x) + b), 0.0))
        mine = got[got.entity_id == entity].sort_values("t")
        np.testing.assert_allclose(mine["forecast"], values[-6:], rtol=1e-6, atol=1e-6)
        assert list(mine["t"]) == list(range(67, 73))


def test_fold_grams_add_up(spark, matrix):
    whole = {g["fold"]: g for g in ML.fold_grams(matrix, ML.FEATURES)}
    for i, (lo, hi, _, _) in enumerate(V.FOLDS):
        row = ML.gram(matrix.where(F.col("t").between(lo, hi)).withColumn("fold", F.lit(i)), ML.FEATURES).first()
        assert whole[i]["n"] == row["n"]
        np.testing.assert_allclose(whole[i]["products"], row["products"], rtol=1e-9)


def test_classifier_skips_one_class(spark, matrix):
    assert ML.fit_zero_classifier(matrix.where("y > 0"), ML.FEATURES, numTrees=5) is None
    assert ML.p_zero(None, matrix).agg(F.max("p_zero")).first()[0] == 0.0


@pytest.mark.parametrize("key", ["hurdle_forecast", "recursive_forecast", "direct_forecast", "gbt_early_stop"])
def test_forecast_invariants(spark, sf, key):
    from tidepanel.plans import QUERIES

    out = QUERIES[key](spark, sf).toPandas()
    entities = out["entity_id"].nunique()
    assert len(out) == entities * 12 and entities in (10, 11)
    assert (out["forecast"] >= 0).all() and out["forecast"].notna().all()
    assert not out.duplicated(["entity_id", "t"]).any()


def test_search_and_grid(spark, matrix):
    grid = ML.grid_ridge(matrix, ML.FEATURES, [0.1, 10.0])
    assert grid.count() == 8
    found = ML.search(matrix, ML.FEATURES, [{"maxDepth": 2, "maxIter": 2}], folds=((0, 30, 31, 42), (0, 42, 43, 54)))
    assert found.columns == ["trial", "maxDepth", "maxIter", *ML.MEASURES] and found.count() == 1
    assert ML.random_candidates(3) == ML.random_candidates(3)


def test_recursion_runs_on_all_cores(spark, panel):
    state = RC.history_state(panel({e: range(e, e + 20) for e in range(1, 200)}), 19)
    assert state.rdd.getNumPartitions() >= 8
    hist = {r["entity_id"]: r["hist"] for r in state.collect()}
    assert len(hist) == 199 and hist[5] == [float(v) for v in range(13, 25)]
