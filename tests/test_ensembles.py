"""Tree ensembles as node tables, best splits, patience, racing and the lasso path."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tidepanel.operators import ensembles as E, learn as ML, splits as S, validation as V
from tidepanel.plans import learned as L
from tidepanel.session import scratch_path
from tidepanel.sources import fixtures as X


@pytest.fixture(scope="module")
def matrix(spark, sf):
    df = ML.model_matrix(X.panel(spark, sf, X.LAST)).persist()
    df.count()
    return df


@pytest.fixture(scope="module")
def boosted(matrix):
    return ML.fit_gbt(matrix, ML.FEATURES, maxDepth=4, maxIter=12)


def walk(nodes, row):
    """Prediction in plain Python from collected nodes."""
    trees = {}
    for n in nodes:
        trees.setdefault((n["tree"], n["weight"]), {})[n["node"]] = n
    total = 0.0
    for (_, weight), tree in sorted(trees.items()):
        node = tree[0]
        while node["feature"] is not None:
            x = row[node["feature"]]
            x = math.nan if x is None else x
            node = tree[node["left"] if x <= node["threshold"] else node["right"]]
        total += weight * node["value"]
    return total


def same(spark, fitted, df, spark_prediction):
    nodes = E.node_table(fitted, spark)
    rows = E.NodeModel(nodes, fitted.cols).predict(spark_prediction(df), "mine").collect()
    plain = nodes.collect()
    assert rows
    for r in rows:
        assert r["mine"] == pytest.approx(r["theirs"], rel=1e-9, abs=1e-9)
    for r in rows[:40]:
        assert r["mine"] == pytest.approx(walk(plain, r.asDict()), rel=1e-9, abs=1e-9)


def test_boosted_nodes(spark, matrix, boosted):
    gaps = matrix.withColumns({c: F.when(F.col("t") % 5 != 0, F.col(c)) for c in ("lag_1", "roll_mean_6")})
    same(spark, boosted, gaps, lambda df: boosted.predict(df, "theirs"))


def test_forest_nodes(spark, matrix):
    fitted = ML.fit_forest(matrix, ML.FEATURES, numTrees=7, maxDepth=5)
    same(spark, fitted, matrix, lambda df: fitted.predict(df, "theirs"))


def test_classifier_nodes(spark, sf):
    rows = ML.filled_matrix(X.panel(spark, sf, X.LAST))
    fitted = ML.fit_zero_classifier(rows, ML.FEATURES, numTrees=6, maxDepth=4)
    same(spark, fitted, rows, lambda df: ML.p_zero(fitted, df, "theirs"))


def test_nodes_are_saved_and_cut(spark, matrix, boosted, tmp_path):
    nodes = E.node_table(boosted, spark)
    E.save_nodes(nodes, f"file://{tmp_path}/nodes")
    loaded = E.load_nodes(spark, f"file://{tmp_path}/nodes")
    assert sorted(map(str, loaded.collect())) == sorted(map(str, nodes.collect()))
    few = ML.fit_gbt(matrix, ML.FEATURES, maxDepth=4, maxIter=5)
    rows = few.predict(E.NodeModel(E.cut(loaded, 5), ML.FEATURES).predict(matrix, "mine"), "theirs").collect()
    assert all(r["mine"] == pytest.approx(r["theirs"], rel=1e-9) for r in rows)


def test_error_curve_of_every_prefix(spark, matrix, boosted):
    valid = matrix.where("t > 54")
    nodes = E.node_table(boosted, spark)
    curve = {r["trees"]: r for r in E.error_curve(valid, nodes, ML.FEATURES).collect()}
    assert sorted(curve) == list(range(1, 13))
    n = valid.count()
    for k in (1, 4, 12):
        rows = E.NodeModel(E.cut(nodes, k), ML.FEATURES).predict(valid).collect()
        assert curve[k]["n"] == n
        assert curve[k]["rmse"] == pytest.approx(math.sqrt(sum((r["y"] - r["p"]) ** 2 for r in rows) / n), rel=1e-9)


def test_patience_goes_past_a_plateau(spark):
    curve = spark.createDataFrame([(i + 1, e) for i, e in enumerate([9.0, 5.0, 5.0, 5.1, 5.0, 4.0, 4.2, 4.3, 4.1, 4.5, 3.0])], "trees int, rmse double")
    assert E.best_prefix(curve, 1) == 2
    assert E.best_prefix(curve, 4) == 6
    assert E.best_prefix(curve, 5) == 11
    assert E.best_prefix(curve.where("trees < 1"), 5) == 0


def test_patience_keeps_more_trees_than_a_tolerance(spark):
    """A target whose error stands still for some trees: each step of the stairs needs a tree of its own."""
    rows = [(i, 60 if i % 2 else 10, float(i % 16), float((i % 16) // 4 * 8 + (i % 16 >= 8) * 30)) for i in range(640)]
    df = spark.createDataFrame(rows, "entity_id long, t int, x double, y double")
    params = {"maxDepth": 1, "maxIter": 40, "stepSize": 0.1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    early = ML.fit_gbt(df.withColumn("v", F.col("t") > 54), ["x"], validation="v", validationTol=0.2, **params)
    patient, curve = E.fit_patient(df, ["x"], F.col("t") > 54, patience=10, **params)
    kept = patient.nodes.agg(F.max("tree") + 1).first()[0]
    errors = {r["trees"]: r["rmse"] for r in curve.collect()}
    assert kept > early.model.getNumTrees and errors[kept] == min(errors.values())


def plain_split(rows, feature, y="y"):
    pairs = sorted((r[feature], r[y]) for r in rows if r[feature] is not None and not math.isnan(r[feature]) and r[y] is not None)
    best = None
    for k in range(1, len(pairs)):
        if pairs[k][0] == pairs[k - 1][0]:
            continue
        left, right = [v for _, v in pairs[:k]], [v for _, v in pairs[k:]]
        gain = np.var([v for _, v in pairs]) - (len(left) * np.var(left) + len(right) * np.var(right)) / len(pairs)
        if best is None or gain > best[0] + 1e-9:
            best = gain, (pairs[k - 1][0] + pairs[k][0]) / 2, len(left), len(right)
    return best


def test_best_split_equals_a_plain_search(spark):
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(0, 40)), None if i % 7 == 0 else float(rng.normal()), 1.0, None if i % 11 == 0 else float(rng.normal() + (i % 40 > 25))) for i in range(900)]
    rows += [(math.nan, 1.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, same double, y double").repartition(7)
    got = {r["feature"]: r for r in S.best_splits(df, ["a", "b", "same"]).collect()}
    assert set(got) == {"a", "b"}
    for feature in got:
        gain, threshold, n_left, n_right = plain_split(df.collect(), feature)
        assert got[feature]["gain"] == pytest.approx(gain, rel=1e-6)
        assert (got[feature]["threshold"], got[feature]["n_left"], got[feature]["n_right"]) == (pytest.approx(threshold), n_left, n_right)
    assert S.best_splits(df.where("a > 1e9"), ["a"]).collect() == []
    few = S.best_splits(df, ["b"], least=200).first()
    assert min(few["n_left"], few["n_right"]) >= 200


def test_best_split_is_the_root_of_a_tree_of_depth_one(spark, matrix):
    bins = max(matrix.select(c).distinct().count() for c in ("lag_1", "lag_12")) + 2
    tree = DecisionTreeRegressor(labelCol="y", maxDepth=1, maxBins=bins).fit(ML.assemble(matrix, ["lag_1", "lag_12"]))
    root = tree._java_obj.rootNode()
    best = max(S.best_splits(matrix, ["lag_1", "lag_12"]).collect(), key=lambda r: r["gain"])
    assert ["lag_1", "lag_12"][root.split().featureIndex()] == best["feature"]
    assert root.split().threshold() == pytest.approx(best["threshold"])
    assert root.gain() == pytest.approx(best["gain"], rel=1e-6)


def test_lasso_path_is_optimal_on_twelve_features(spark, matrix):
    row = ML.gram(matrix.withColumn("fold", F.lit(0)), ML.FEATURES).first()
    alphas = ML.lasso_alphas(row, len(ML.FEATURES))
    pdf = matrix.toPandas()
    x, y = pdf[ML.FEATURES].to_numpy(float), pdf["y"].to_numpy(float)
    scale = x.std(axis=0)
    z = (x - x.mean(axis=0)) / scale
    seen = []
    for alpha, w, b in ML.lasso_path(row, len(ML.FEATURES), alphas):
        slope = z.T @ (y - x @ w - b) / len(y)
        assert np.all(np.abs(slope) <= alpha * (1 + 1e-6) + 1e-6)
        np.testing.assert_allclose(slope[w != 0], alpha * np.sign(w[w != 0]), rtol=1e-5)
        seen.append((w != 0).sum())
    assert seen[-1] == 0 and seen[0] >= 6
    rule, alpha = ML.fit_lasso_path(matrix, ML.FEATURES)
    assert alpha in alphas and rule.predict(matrix).where("p is null").count() == 0


def test_race_goes_on_with_the_best(spark, matrix):
    candidates = [{**c, "maxDepth": 2 + i % 2} for i, c in enumerate(ML.random_candidates(6, trees=(3, 9)))]
    folds = ((0, 42, 43, 54), (0, 54, 55, 66))
    found = ML.race(matrix, ML.FEATURES, candidates, rungs=(1, 2, 3), folds=folds).collect()
    assert [r["trial"] for r in found] == list(range(6))
    assert sorted(r["rung"] for r in found) == [0, 0, 0, 1, 2, 2]
    assert all(r["trees"] == min((1, 3, 6)[r["rung"]], r["maxIter"]) for r in found)
    # each prefix is scored like the sum of its parts: the first rung is a boosted model of one tree
    one = next(r for r in found if r["rung"] == 0)
    params = {**candidates[one["trial"]], "maxIter": 1, "seed": 42}
    plain = ML.fold_report(ML.cross_validate(matrix, lambda train: ML.fit_gbt(train, ML.FEATURES, **params), folds)).first()
    assert one["mean_score"] == pytest.approx(plain["mean_score"]) and one["rmse"] == pytest.approx(plain["rmse"])


def test_race_adds_up_what_it_saved(spark, matrix, monkeypatch):
    """Two rungs give what two models in memory give, one without trees left changes nothing, and a session without checkpoints gets them."""
    asked = []
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(type(spark.sparkContext), "setCheckpointDir", lambda self, path: asked.append(path))
    params, (lo, hi, valid_lo, valid_hi) = {**ML.random_candidates(1)[0], "maxDepth": 3, "maxIter": 3}, (0, 54, 55, 66)
    found = ML.race(matrix, ML.FEATURES, [params], rungs=(2, 4, 2), folds=((lo, hi, valid_lo, valid_hi),)).first()
    assert (found["rung"], found["trees"]) == (2, 3)
    assert [path.startswith(scratch_path(spark, "checkpoints")[:-12]) for path in asked] == [True]
    train, valid = matrix.where(F.col("t").between(lo, hi)), matrix.where(F.col("t").between(valid_lo, valid_hi))
    one = ML.fit_gbt(train, ML.FEATURES, **{**params, "maxIter": 2, "seed": 42})
    rest = one.predict(train).withColumn("rest", F.col("y") - F.col("p")).drop("p")
    two = ML.fit_gbt(rest, ML.FEATURES, "rest", **{**params, "maxIter": 1, "seed": 43})
    pairs = two.predict(one.predict(valid, "a"), "b").select(F.lit(0).alias("fold"), "y", (F.col("a") + F.col("b")).alias("p"))
    plain = ML.fold_report(pairs).first()
    assert [found[m] for m in ML.MEASURES] == [pytest.approx(plain[m]) for m in ML.MEASURES]


def test_random_search_runs_the_whole_race(spark, monkeypatch):
    """Every trial that stays gets its trees, up to its own number, in every fold. Fits are stood in for, so that only the work asked for is counted."""
    fitted = []

    class Zero:
        """In place of a fitted model."""

        model = property(lambda self: self)

        def write(self):
            return self

        def save(self, path):
            pass

        @staticmethod
        def load(path):
            return Zero()

        def setPredictionCol(self, name):
            self.name = name
            return self

        def transform(self, df):
            return df.withColumn(self.name, F.lit(0.0))

        def predict(self, df, name="p"):
            return self.setPredictionCol(name).transform(df)

    def fit(df, cols, y, **params):
        fitted.append(params["maxIter"])
        return Zero()

    rows = spark.createDataFrame([(e, t, float(t)) for e in range(2) for t in range(12, 67)], "entity_id long, t int, y double")
    rows = rows.withColumns({c: F.col("y") for c in ML.FEATURES}).coalesce(1).persist()
    monkeypatch.setattr(ML, "fit_gbt", fit)
    monkeypatch.setattr(ML, "GBTRegressionModel", Zero)
    monkeypatch.setattr(L, "_history", lambda spark, d: None)
    monkeypatch.setattr(L, "_matrix", lambda panel: rows)
    found = L.random_search(spark, "").orderBy("trial").collect()
    wanted = ML.random_candidates(40)
    assert [r["maxIter"] for r in found] == [c["maxIter"] for c in wanted] and min(r["maxIter"] for r in found) >= 300
    # equal scores keep the order of the trials: 40, 20, 10, 5 and 3 of them run
    assert [r["rung"] for r in found] == [4] * 3 + [3] * 2 + [2] * 5 + [1] * 10 + [0] * 20
    assert [r["trees"] for r in found] == [min((75, 150, 300, 600, 1200)[r["rung"]], r["maxIter"]) for r in found]
    assert sum(fitted) == len(V.FOLDS) * sum(r["trees"] for r in found)
    assert [r["trial"] for r in found if r["chosen"]] == [0]


def test_a_leaf_leads_to_itself(spark):
    """A root that is a leaf, a shallow leaf and a gap give what a walk gives, however many steps the ensemble has."""
    inner, leaf = (0, 0.5, 0, "x", 1.0, 1, 2, 9.0, 5), (0, 0.5, 1, None, None, None, None, 2.0, 5)
    rows = [inner, leaf, (0, 0.5, 2, "y", 0.0, 3, 4, 8.0, 5), (0, 0.5, 3, None, None, None, None, 4.0, 5), (0, 0.5, 4, None, None, None, None, 6.0, 5)]
    nodes = spark.createDataFrame([*rows, (1, 1.0, 0, None, None, None, None, 10.0, 5), (2, 1.0, 0, "gone", 3.0, 1, 2, 7.0, 5)], E.NODES)
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, -1.0), (3, 2.0, None), (4, None, 0.0)], "i int, x double, y double")
    found = {r["i"]: r["p"] for r in E.NodeModel(nodes, ["y", "x"]).predict(df).collect()}
    assert found == {1: 18.0, 2: 19.0, 3: 20.0, 4: 19.0}


@pytest.mark.parametrize("fit", [ML.fit_forest, ML.fit_zero_classifier])
def test_forests_keep_nodes_from_level_to_level(spark, fit):
    """No level walks the trees from their roots, and the trees are those that such walks give, also with rows that come twice."""
    rng = np.random.default_rng(11)
    rows = [(float(rng.integers(0, 30)), float(rng.normal()), float(max(rng.normal() + i % 3, 0.0))) for i in range(600)]
    df = spark.createDataFrame([*rows, *rows[:200]], "a double, b double, y double")
    kept, walked = (fit(df, ["a", "b"], numTrees=6, maxDepth=5, **more).model for more in ({}, {"cacheNodeIds": False}))
    assert kept.getCacheNodeIds() and kept.getCheckpointInterval() == -1
    trees = [m.toDebugString.split("\n", 1)[1] for m in (kept, walked)]
    assert kept.totalNumNodes > 60 and trees[0] == trees[1]
