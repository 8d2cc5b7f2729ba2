"""Time-ordered validation and parameter searches as single jobs.

Parameter lists and fold lists are literals in the plan, expanded with a narrow
``explode``; no parameter table is joined to the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import per_entity, trailing, whole_entity
from . import tails as A
from .lags import positive_log
from .metrics import rmse_column, mape_column, two_stage_columns
from .seasonal import apply_december

# train_lo, train_hi, valid_lo, valid_hi of the expanding folds.
FOLDS = ((0, 18, 19, 30), (0, 30, 31, 42), (0, 42, 43, 54), (0, 54, 55, 66))


def literal_rows(names: tuple[str, ...], rows) -> Column:
    """A list of parameter tuples as one array-of-structs literal."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def assign_folds(df: DataFrame, folds=FOLDS, history: int | None = None) -> DataFrame:
    """One copy of a row per fold that trains or validates on it.

    ``history`` keeps only that many periods before the validation range.
    """
    table = literal_rows(("fold", "train_lo", "train_hi", "valid_lo", "valid_hi"), [(i, *f) for i, f in enumerate(folds)])
    t = F.col("t")

    def used(f: Column) -> Column:
        start = f["train_lo"] if history is None else F.greatest(f["train_lo"], f["train_hi"] - history + 1)
        return t.between(start, f["train_hi"]) | t.between(f["valid_lo"], f["valid_hi"])

    rows = df.withColumn("_f", F.explode(F.filter(table, used)))
    role = F.when(t <= F.col("_f.train_hi"), "train").otherwise("valid")
    return rows.select("_f.fold", role.alias("role"), F.col("_f.train_hi").alias("train_hi"), *df.columns)


def ts_folds(df: DataFrame, n_splits: int = 4, test_size: int = 12) -> DataFrame:
    """Expanding folds over the distinct periods, so that no period is split."""
    periods = df.select("t").distinct().agg(F.sort_array(F.collect_list("t")).alias("ts"))
    folds = periods.select("ts", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
    cut = F.size("ts") - (n_splits - F.col("fold")) * test_size
    return folds.where(cut > 0).select(
        "fold",
        F.element_at("ts", F.lit(1)).alias("train_lo"),
        F.element_at("ts", cut).alias("train_hi"),
        F.element_at("ts", cut + 1).alias("valid_lo"),
        F.element_at("ts", cut + test_size).alias("valid_hi"),
    )


def holdout(df: DataFrame, size: int = 12, t_max: int | None = None) -> DataFrame:
    """Roles by distance from the newest period, which is looked up unless it is given."""
    newest = df.agg(F.max("t")).scalar() if t_max is None else F.lit(t_max)
    return df.withColumn("role", F.when(F.col("t") > newest - size, "valid").otherwise("train"))


def cv_geo_pairs(panel: DataFrame, folds=FOLDS, lookback: int = 6, guard: int = 6) -> DataFrame:
    """Out-of-fold ``(fold, entity_id, t, y, p)`` of the geometric-mean forecast."""
    # placed by entity before rows are copied per fold; (fold, entity) then needs no shuffle
    rows = assign_folds(panel.repartition("entity_id"), folds, history=max(lookback, guard))
    valid = F.when(F.col("role") == "valid", F.struct("t", "amount"))
    per = rows.groupBy("fold", "entity_id").agg(
        A.geo_mean_guard(lookback, guard, F.col("train_hi")).alias("p"),
        F.collect_list(valid).alias("actual"),
    )
    out = per.select("fold", "entity_id", "p", F.explode("actual").alias("_a"))
    return out.select("fold", "entity_id", "_a.t", F.col("_a.amount").alias("y"), "p")


def fold_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))


def rolling_backtest(panel: DataFrame, last: int = 66, n_test: int = 12, lookback: int = 6, boost_scope: str = "train", cap: float = 2.0, default: float = 1.3) -> DataFrame:
    """Each of the last ``n_test`` periods predicted from the ``lookback`` before it.

    ``boost_scope="train"`` takes the boost from before the tested periods only,
    ``"all"`` from everything up to ``last``.
    """
    known = panel.where(F.col("t") <= last)
    frame = trailing(lookback)
    base = F.coalesce(F.exp(F.avg(positive_log(F.col("amount"))).over(frame)), F.lit(0.0))
    base = F.when(F.min("amount").over(frame) == 0, F.lit(0.0)).otherwise(base)
    boost = A.december_boost(last - n_test if boost_scope == "train" else last, cap, default, over=whole_entity())
    rows = known.withColumns({"_p": base, "_b": boost}).where(F.col("t") > last - n_test)
    return rows.select("entity_id", "t", F.col("amount").alias("y"), apply_december(F.col("_p"), F.col("_b")).alias("p"))


def grid_geo(panel: DataFrame, lookbacks: list[int], guards: list[int] | None, last: int = 54, steps: int = 12) -> DataFrame:
    """Score of the geometric-mean forecast for every lookback, or lookback and guard.

    One aggregation per entity yields one mean per lookback, one minimum per guard
    and the actuals; every parameter pair is then scored from that one row.
    ``guards=None`` uses the lookback as the guard.
    """
    pairs = [(n, n) for n in lookbacks] if guards is None else [(n, g) for n in lookbacks for g in guards]
    spans = sorted({g for _, g in pairs})
    reach = max(max(n, g) for n, g in pairs)
    rows = panel.where(F.col("t").between(last - reach + 1, last + steps))
    per = per_entity(
        rows,
        *[A.geo_mean(n, last).alias(f"_g{n}") for n in lookbacks],
        *[A.lowest(g, last).alias(f"_l{g}") for g in spans],
        F.collect_list(F.when(F.col("t") > last, F.col("amount"))).alias("_ys"),
    )
    cases = F.array(
        *[
            F.struct(F.lit(n).alias("lookback"), F.lit(g).alias("guard"), A.guarded(F.col(f"_g{n}"), F.col(f"_l{g}")).alias("p"))
            for n, g in pairs
        ]
    )
    scored = per.select(F.explode(cases).alias("_c"), "_ys").select("_c.*", F.explode("_ys").alias("y"))
    score, rate = two_stage_columns()
    return scored.groupBy("lookback", "guard").agg(score.alias("score"), rate.alias("good_rate"))


def best(grid: DataFrame, tie_break: list[str], score: str = "score") -> DataFrame:
    """The row with the highest score."""
    return grid.orderBy(F.col(score).desc(), *tie_break).limit(1)


def grid_blend_alpha(pairs: DataFrame, a: str, b: str, steps: int = 21, y: str = "y") -> DataFrame:
    """Score of ``alpha * a + (1 - alpha) * b`` for evenly spaced alphas."""
    alphas = F.array(*[F.lit(i / (steps - 1)) for i in range(steps)])
    rows = pairs.select(y, a, b, F.explode(alphas).alias("alpha"))
    rows = rows.withColumn("p", F.col("alpha") * F.col(a) + (1 - F.col("alpha")) * F.col(b))
    score, rate = two_stage_columns(y, "p")
    return rows.groupBy("alpha").agg(score.alias("score"), rate.alias("good_rate"))


def grid_blend_weights(pairs: DataFrame, cols: tuple[str, str, str], p_zero: str, thresholds=(0.3, 0.4, 0.5, 0.6), first=(0.3, 0.4, 0.5, 0.6), second=(0.2, 0.3, 0.4), y: str = "y") -> DataFrame:
    """Score per zero threshold and weight triple whose rest weight lies in [0.1, 0.5]."""
    params = [
        (z, u, v, round(1.0 - u - v, 10))
        for z in thresholds
        for u in first
        for v in second
        if 0.1 <= round(1.0 - u - v, 10) <= 0.5
    ]
    names = ("threshold", "w1", "w2", "w3")
    rows = pairs.select(y, *cols, p_zero, F.explode(literal_rows(names, params)).alias("_g")).select("*", "_g.*")
    total = F.col("w1") * F.col(cols[0]) + F.col("w2") * F.col(cols[1]) + F.col("w3") * F.col(cols[2])
    rows = rows.withColumn("p", F.when(F.col(p_zero) > F.col("threshold"), F.lit(0.0)).otherwise(F.greatest(total, F.lit(0.0))))
    score, rate = two_stage_columns(y, "p")
    return rows.groupBy(*names).agg(score.alias("score"), rate.alias("good_rate"))


def score_folds(pairs: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    score, rate = two_stage_columns()
    return pairs.groupBy(*by).agg(
        score.alias("score"), rate.alias("good_rate"), rmse_column().alias("rmse"), mape_column().alias("mape")
    )
