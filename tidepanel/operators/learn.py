"""Learned forecasters on Spark ML."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
import math
import random

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys as K
from ..functions.columns import is_zero
from ..session import allow_checkpoints, scratch_path, staged
from . import validation as V
from .lags import LAGS, WINDOWS, label_next, lag_feature_names, lag_features

FEATURES = [*lag_feature_names(), "month_num"]

#: A forest keeps the node of every row in every tree from one level to the next. Otherwise each level walks each row down each tree from its root, all of
#: them out of cache. The trees are the same. The ids spill to the executors' disks; a level is soon made again from the one before, so none is checkpointed.
KEPT_NODES = {"cacheNodeIds": True, "checkpointInterval": -1}


def model_matrix(panel: DataFrame, ks=LAGS, windows=WINDOWS) -> DataFrame:
    """Lag features with the target ``y``; rows without full features are dropped."""
    frame = lag_features(panel.select("entity_id", "t", "amount"), ks, windows)
    frame = frame.withColumn("month_num", K.month_of("t")).withColumnRenamed("amount", "y")
    return frame.dropna(subset=lag_feature_names(ks, windows))


def filled_matrix(panel: DataFrame, value: float = 0.0) -> DataFrame:
    """Lag features with the target ``y``, gaps filled, from the first full lag on: the option for learners that should see gaps."""
    frame = lag_features(panel.select("entity_id", "t", "amount"))
    frame = frame.withColumn("month_num", K.month_of("t")).withColumnRenamed("amount", "y")
    return frame.where(F.col(f"lag_{max(LAGS)}").isNotNull()).fillna(value, subset=lag_feature_names())


def assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df)


@dataclass
class Fitted:
    """A fitted model and the columns it reads; ``predict`` adds ``p``."""

    model: object
    cols: list[str]

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        out = self.model.setPredictionCol(name).transform(assemble(df, self.cols))
        return out.drop("features")


def fit_linear(df: DataFrame, cols: list[str], alpha: float = 1.0, kind: str = "ridge", y: str = "y") -> Fitted:
    """Ridge, lasso or least squares on features scaled by their population deviation.

    The penalties are stated for the sum (ridge) and half the mean (lasso) of squared
    errors with a free intercept; the solver scales the target too, hence the factor.
    """
    params: dict[str, float] = {"regParam": 0.0, "elasticNetParam": 0.0}
    if kind == "ridge":
        size = df.agg(F.count(y).alias("n"), F.stddev_pop(y).alias("s")).first()
        params["regParam"] = alpha * size["s"] / size["n"]
    elif kind == "lasso":
        params = {"regParam": alpha, "elasticNetParam": 1.0}
    regression = LinearRegression(labelCol=y, solver="normal", standardization=True, maxIter=500, tol=1e-10, **params)
    return Fitted(regression.fit(assemble(df, cols)), cols)


def fit_ridge(df: DataFrame, cols: list[str], alpha: float = 1.0, y: str = "y") -> Fitted:
    return fit_linear(df, cols, alpha, "ridge", y)


def fit_gbt(df: DataFrame, cols: list[str], y: str = "y", validation: str | None = None, **params) -> Fitted:
    """Boosted trees; with a boolean ``validation`` column boosting stops early."""
    settings = {"maxDepth": 5, "stepSize": 0.05, "maxIter": 400, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}
    settings |= params
    if validation is not None:
        settings |= {"validationIndicatorCol": validation, "validationTol": settings.pop("validationTol", 0.01)}
    return Fitted(GBTRegressor(labelCol=y, **settings).fit(assemble(df, cols)), cols)


def fit_forest(df: DataFrame, cols: list[str], y: str = "y", **params) -> Fitted:
    settings = {"numTrees": 300, "maxDepth": 8, "seed": 42, **KEPT_NODES} | params
    return Fitted(RandomForestRegressor(labelCol=y, **settings).fit(assemble(df, cols)), cols)


def fit_positive(df: DataFrame, cols: list[str], y: str = "y", **params) -> Fitted:
    """Boosted trees on positive targets; callers clip the prediction at 0."""
    return fit_gbt(df.where(F.col(y) > 0), cols, y, **params)


def fit_zero_classifier(df: DataFrame, cols: list[str], y: str = "y", **params) -> Fitted | None:
    """Forest for ``y = 0``; None when the rows hold one class only."""
    labelled = df.withColumn("_zero", is_zero(y).cast("double"))
    share = labelled.agg(F.avg("_zero")).first()[0]
    if share is None or share in (0.0, 1.0):
        return None
    settings = {"numTrees": 100, "maxDepth": 10, "seed": 42, **KEPT_NODES} | params
    forest = RandomForestClassifier(labelCol="_zero", **settings)
    return Fitted(forest.fit(assemble(labelled, cols)), cols)


def p_zero(classifier: Fitted | None, df: DataFrame, name: str = "p_zero") -> DataFrame:
    if classifier is None:
        return df.withColumn(name, F.lit(0.0))
    out = classifier.model.transform(assemble(df, classifier.cols))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importance(fitted: Fitted, spark, top: int | None = None) -> DataFrame:
    """Features by absolute coefficient or by tree importance, largest first."""
    model = fitted.model
    values = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
    rows = [(name, float(v)) for name, v in zip(fitted.cols, values.toArray())]
    ranked = spark.createDataFrame(rows, "feature string, weight double").orderBy(F.abs("weight").desc(), "feature")
    return ranked if top is None else ranked.limit(top)


# ---- ridge over many penalties and folds from one aggregation ----


def gram(df: DataFrame, cols: list[str], y: str = "y", by: str = "fold") -> DataFrame:
    """Per group: row count, sums and cross products of the features and the target."""
    names = [*cols, y]
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(c).cast("double") for c in names]).alias("sums"),
        F.array(*[p.cast("double") for p in products]).alias("products"),
    )


def _standardized(row, n_cols: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sums, the features' scales, and the centred cross products of the scaled features with each other and with the target."""
    n, size = row["n"], n_cols + 1
    sums = np.array(row["sums"])
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = row["products"]
    full = full + np.triu(full, 1).T
    centred = full - np.outer(sums, sums) / n
    scale = np.sqrt(np.clip(np.diag(centred)[:n_cols], 0, None) / n)
    scale[scale == 0] = 1.0
    return n, sums, scale, centred[:n_cols, :n_cols] / np.outer(scale, scale), centred[:n_cols, n_cols] / scale


def _intercept(n: float, sums: np.ndarray, weights: np.ndarray) -> float:
    return float((sums[-1] - weights @ sums[:-1]) / n)


def ridge_path(row, n_cols: int, alphas: list[float]) -> list[tuple[float, np.ndarray, float]]:
    """``(alpha, coefficients, intercept)`` for every penalty from one ``gram`` row."""
    n, sums, scale, xx, xy = _standardized(row, n_cols)
    out = []
    for alpha in alphas:
        weights = np.linalg.solve(xx + alpha * np.eye(n_cols), xy) / scale
        out.append((alpha, weights, _intercept(n, sums, weights)))
    return out


def lasso_path(row, n_cols: int, alphas: list[float], sweeps: int = 100_000, tol: float = 1e-12) -> list[tuple[float, np.ndarray, float]]:
    """The same for the lasso, half the mean squared error plus ``alpha`` times the absolute scaled coefficients, by cyclic coordinate descent.

    Only the sums are touched, so a sweep costs the square of the number of features whatever the number of rows. Penalties are taken from
    the largest down, each started from the one before.
    """
    n, sums, scale, xx, xy = _standardized(row, n_cols)
    xx, xy = xx / n, xy / n
    w, found = np.zeros(n_cols), {}
    for alpha in sorted(set(alphas), reverse=True):
        for _ in range(sweeps):
            before = w.copy()
            for j in range(n_cols):
                if xx[j, j] > 0:
                    slope = xy[j] - xx[j] @ w + xx[j, j] * w[j]
                    w[j] = math.copysign(max(abs(slope) - alpha, 0.0), slope) / xx[j, j]
            if np.abs(w - before).max(initial=0.0) <= tol * max(1.0, np.abs(w).max(initial=0.0)):
                break
        found[alpha] = w / scale
    return [(alpha, found[alpha], _intercept(n, sums, found[alpha])) for alpha in alphas]


def lasso_alphas(row, n_cols: int, steps: int = 8, least: float = 1e-3) -> list[float]:
    """Evenly spaced logarithms up to the smallest penalty that leaves no coefficient."""
    n, _, _, _, xy = _standardized(row, n_cols)
    top = float(np.abs(xy).max() / n)
    return [top * least ** (1 - i / (steps - 1)) for i in range(steps)]


def fold_grams(matrix: DataFrame, cols: list[str], folds=V.FOLDS, y: str = "y") -> list[dict]:
    """The sums of each fold's training rows. Every row is summed once, in the block of periods between two cuts; the driver adds the blocks up."""
    cuts = sorted({f[1] for f in folds} | {f[0] - 1 for f in folds})
    block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("t")))
    rows = {r["block"]: r for r in gram(matrix.where(F.col("t") <= cuts[-1]).withColumn("block", block), cols, y, "block").collect()}
    out = []
    for i, (lo, hi, _, _) in enumerate(folds):
        own = [r for b, r in rows.items() if cuts.index(lo - 1) < b <= cuts.index(hi)]
        out.append(
            {"fold": i, "n": sum(r["n"] for r in own), "sums": np.sum([r["sums"] for r in own], axis=0), "products": np.sum([r["products"] for r in own], axis=0)}
        )
    return out


def linear(cols: list[str], weights, intercept: float) -> Column:
    out = F.lit(float(intercept))
    for c, w in zip(cols, weights):
        out = out + F.col(c) * F.lit(float(w))
    return out


def grid_linear(matrix: DataFrame, cols: list[str], alphas: list[float], folds=V.FOLDS, y: str = "y", path=ridge_path) -> DataFrame:
    """Scores of every penalty in every fold: one job for the sums, one for the scores. ``path`` fits the penalties to a fold's sums.

    Only one row of sums per block of periods reaches the driver, whatever the panel's size.
    """
    paths = {g["fold"]: path(g, len(cols), alphas) for g in fold_grams(matrix, cols, folds, y)}
    fold = None
    for i, (_, _, lo, hi) in enumerate(folds):
        here = F.col("t").between(lo, hi)
        fold = F.when(here, i) if fold is None else fold.when(here, i)
    valid = matrix.withColumn("fold", fold).where(F.col("fold").isNotNull())
    tried = []
    for k, alpha in enumerate(alphas):
        p = None
        for i, fits in paths.items():
            value = linear(cols, fits[k][1], fits[k][2])
            p = F.when(F.col("fold") == i, value) if p is None else p.when(F.col("fold") == i, value)
        tried.append(F.struct(F.lit(alpha).alias("alpha"), p.alias("p")))
    pairs = valid.select("fold", F.col(y).alias("y"), F.inline(F.array(*tried)))
    return V.score_folds(pairs, ("alpha", "fold"))


def grid_ridge(matrix: DataFrame, cols: list[str], alphas: list[float], folds=V.FOLDS, y: str = "y") -> DataFrame:
    return grid_linear(matrix, cols, alphas, folds, y)


@dataclass
class LinearRule:
    """Coefficients that predict like a fitted model."""

    cols: list[str]
    weights: np.ndarray
    intercept: float

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        return df.withColumn(name, linear(self.cols, self.weights, self.intercept))


def fit_lasso_path(matrix: DataFrame, cols: list[str], folds=V.FOLDS, y: str = "y") -> tuple[LinearRule, float]:
    """The lasso of all rows at the penalty that scores best over the folds, and that penalty."""
    whole = gram(matrix.withColumn("fold", F.lit(0)), cols, y).first()
    alphas = lasso_alphas(whole, len(cols))
    alpha = best_alpha(grid_linear(matrix, cols, alphas, folds, y, lasso_path))
    _, weights, intercept = lasso_path(whole, len(cols), [alpha])[0]
    return LinearRule(cols, weights, intercept), alpha


def best_alpha(scores: DataFrame) -> float:
    """The penalty of the best mean fold score, the smaller of equal ones."""
    per = scores.groupBy("alpha").agg(F.avg("score").alias("mean")).orderBy(F.col("mean").desc(), "alpha")
    return per.first()["alpha"]


# ---- searches over fitted models ----


def cross_validate(matrix: DataFrame, fit, folds=V.FOLDS, parallelism: int = 4) -> DataFrame:
    """Out-of-fold pairs of ``fit(train)`` for every fold; the fits run concurrently. A fold is a range of periods, so rows are filtered, not copied."""

    def one(job: tuple[int, tuple]) -> DataFrame:
        i, (lo, hi, valid_lo, valid_hi) = job
        fitted = fit(matrix.where(F.col("t").between(lo, hi)))
        valid = matrix.where(F.col("t").between(valid_lo, valid_hi)).withColumn("fold", F.lit(i))
        return fitted.predict(valid).select("fold", "entity_id", "t", "y", "p")

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(one, enumerate(folds)))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


MEASURES = ("mean_score", "std_score", "good_rate", "rmse", "mape")


def fold_report(pairs: DataFrame) -> DataFrame:
    """One row: mean and deviation of the fold scores, and the fold means of good rate, RMSE and MAPE."""
    return V.score_folds(pairs).agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), *[F.avg(c).alias(c) for c in ("good_rate", "rmse", "mape")]
    )


def search(matrix: DataFrame, cols: list[str], candidates: list[dict], folds=V.FOLDS, fit=fit_gbt, parallelism: int = 4) -> DataFrame:
    """A row per candidate: its parameters and the ``MEASURES`` of its folds.

    A trial is scored to one row as soon as it is fitted, so the plan does not grow with the trials.
    ``matrix`` should be staged or persisted; every fit reads it.
    """

    def one(job: tuple[int, dict]) -> tuple:
        i, params = job
        row = fold_report(cross_validate(matrix, lambda train: fit(train, cols, **params), folds, 1)).first()
        return (i, *params.values(), *[row[m] for m in MEASURES])

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(one, enumerate(candidates)))
    kinds = {int: "int", float: "double", str: "string"}
    fields = ["trial int", *[f"{k} {kinds[type(v)]}" for k, v in candidates[0].items()], *[f"{m} double" for m in MEASURES]]
    return matrix.sparkSession.createDataFrame(rows, ", ".join(fields))


#: Trees that the rungs of a race add, as many in all as the tuning ranges allow.
RUNGS = (75, 75, 150, 300, 600)


def race(
    matrix: DataFrame, cols: list[str], candidates: list[dict], rungs=RUNGS, keep: float = 0.5, folds=V.FOLDS, y: str = "y", parallelism: int = 8,
) -> DataFrame:
    """Every candidate starts; after each rung the best ``keep`` of them go on, with ``rungs`` more trees fitted to their residuals.

    A row per candidate: its parameters, the last ``rung`` it ran (from 0), its ``trees`` a fold, and the ``MEASURES`` of that prefix of its ensemble. Candidates of equal
    score keep their order. No candidate grows beyond its ``maxIter``. The first tree of a rung takes a full step, as a boosted model's first tree does.
    Fits of a rung run side by side; each reads only its fold's rows of ``matrix``, which should be staged. What was fitted waits in the shared folder, so that the driver
    holds the ensembles of ``parallelism`` fits, not of all. Spark ML needs checkpoints for ensembles of some hundred trees, else the stack overflows.
    """
    spark = matrix.sparkSession
    allow_checkpoints(spark)
    grown: dict[tuple[int, int], list[str]] = {(i, f): [] for i in range(len(candidates)) for f in range(len(folds))}
    pairs: dict[tuple[int, int], DataFrame] = {}
    size, last, alive = dict.fromkeys(range(len(candidates)), 0), {}, list(range(len(candidates)))

    def predicted(df: DataFrame, blocks: list[Fitted]) -> DataFrame:
        for b, block in enumerate(blocks):
            df = block.predict(df, f"_b{b}")
        total = F.lit(0.0)
        for b in range(len(blocks)):
            total = total + F.col(f"_b{b}")
        return df.withColumn("p", total).drop(*[f"_b{b}" for b in range(len(blocks))])

    def grow(job: tuple[int, int, int]) -> None:
        i, f, trees = job
        lo, hi, valid_lo, valid_hi = folds[f]
        blocks = [Fitted(GBTRegressionModel.load(path), cols) for path in grown[i, f]]
        rest = predicted(matrix.where(F.col("t").between(lo, hi)), blocks).withColumn("_rest", F.col(y) - F.col("p")).drop("p")
        block = fit_gbt(rest, cols, "_rest", **{**candidates[i], "maxIter": trees, "seed": 42 + len(blocks)})
        valid = predicted(matrix.where(F.col("t").between(valid_lo, valid_hi)), [*blocks, block])
        pairs[i, f] = staged(valid.select(F.lit(f).alias("fold"), F.col(y).alias("y"), "p"), "pairs")
        path = scratch_path(spark, "block")
        block.model.write().save(path)
        grown[i, f].append(path)

    def score(i: int) -> tuple:
        row = fold_report(reduce(DataFrame.union, [pairs[i, f] for f in range(len(folds))])).first()
        return tuple(row[m] for m in MEASURES)

    with ThreadPoolExecutor(parallelism) as pool:
        for rung, trees in enumerate(rungs):
            more = {i: min(trees, candidates[i]["maxIter"] - size[i]) for i in alive}
            list(pool.map(grow, [(i, f, more[i]) for i in alive for f in range(len(folds)) if more[i] > 0]))
            for i, measures in zip(alive, pool.map(score, alive)):
                size[i] += more[i]
                last[i] = (rung, size[i], *measures)
            # a score is null without a good row
            alive = sorted(alive, key=lambda i: (-(last[i][2] if last[i][2] is not None else -math.inf), i))[: max(1, math.ceil(keep * len(alive)))]
    kinds = {int: "int", float: "double", str: "string"}
    fields = ["trial int", *[f"{k} {kinds[type(v)]}" for k, v in candidates[0].items()], "rung int", "trees int", *[f"{m} double" for m in MEASURES]]
    rows = [(i, *c.values(), *last[i]) for i, c in enumerate(candidates)]
    return spark.createDataFrame(rows, ", ".join(fields))


def random_candidates(n: int = 40, seed: int = 42, trees: tuple[int, int] = (300, 1200)) -> list[dict]:
    """Seeded draws from the tuning ranges; the learning rate is log-uniform."""
    draw = random.Random(seed)
    return [
        {
            "maxDepth": draw.randint(4, 10),
            "minInstancesPerNode": draw.randint(1, 20),
            "stepSize": round(10 ** draw.uniform(-2.0, math.log10(0.2)), 6),
            "maxIter": draw.randint(*trees),
            "subsamplingRate": round(draw.uniform(0.5, 1.0), 4),
            "featureSubsetStrategy": f"{draw.uniform(0.5, 0.99):.4f}",
            "minInfoGain": round(10 ** draw.uniform(-6, -1), 8),
        }
        for _ in range(n)
    ]


def direct_forecast(panel: DataFrame, last: int = 66, steps: int = 12, first: int = 18, **params) -> DataFrame:
    """Next-period model fitted before the newest known label, applied to the newest row.

    The one prediction per entity is repeated over the horizon.
    """
    frame = lag_features(panel.where(F.col("t") <= last).select("entity_id", "t", "amount"))
    frame = label_next(frame.withColumn("now", F.col("amount")).withColumn("month_num", K.month_of("t")))
    frame = K.fourier(frame, [12, 6, 3]).fillna(-2.0, subset=lag_feature_names())
    cols = ["now", *FEATURES, *[f"{f}_{p}" for p in (12, 6, 3) for f in ("sin", "cos")]]
    frame = staged(frame, "direct")
    known = frame.where((F.col("t") > first) & (F.col("t") <= last - 1))
    marked = known.withColumn("is_valid", F.col("t") == last - 1)
    fitted = fit_gbt(marked, cols, y="label", validation="is_valid", **params)
    newest = fitted.predict(frame.where(F.col("t") == last), "p").select("entity_id", F.greatest("p", F.lit(0.0)).alias("forecast"))
    return newest.withColumn("t", F.explode(F.sequence(F.lit(last + 1), F.lit(last + steps)))).select("entity_id", "t", "forecast")

