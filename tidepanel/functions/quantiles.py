"""Exact quantiles that never put a whole group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, Window

from ..session import staged


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None, accuracy: int = 10_000, stage: bool = True
) -> DataFrame:
    """Linearly interpolated quantiles per group: one column per entry of ``probs``.

    ``percentile``/``median`` hold every distinct value of a group in one task,
    which fails when a group is a whole table. Here a bounded sketch brackets each
    quantile, a second pass counts the rows below the bracket and the values
    inside it, and only those values are ranked: ``5 / accuracy`` of a large
    group, or all of a group of at most ``10 * accuracy`` rows. The values are read
    twice, so they are staged first; ``stage=False`` suits a frame that is cheap to
    read again, such as a file or a staged table. Candidates are ranked in parts, so
    that no task sorts them all. A null group key is a group like any other.
    """
    by = list(by or [])
    source = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if stage:
        source = staged(source, "quantile-values")
    names = list(probs)
    slack = 2.0 / accuracy
    lows = [max(probs[n] - slack, 0.0) for n in names]
    highs = [min(probs[n] + slack, 1.0) for n in names]
    sketch = source.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", lows + highs, accuracy).alias("_q"),
    )
    small = F.col("_n") <= 10 * accuracy
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.when(small, F.col("_min")).otherwise(F.col("_q")[i]).alias("lo"),
                F.when(small, F.col("_max")).otherwise(F.col("_q")[i + len(names)]).alias("hi"),
            )
            for i in range(len(names))
        ]
    )
    sketch = sketch.where(F.col("_n") > 0).select(*by, "_n", brackets.alias("_b"))
    if by:
        sketch = staged(sketch, "quantile-brackets")
        bracketed = _same(source, sketch, by)
    else:
        one = sketch.select(F.struct("_n", "_b")).scalar()
        bracketed = source.withColumn("_s", one).select("_v", F.col("_s._n").alias("_n"), F.col("_s._b").alias("_b"))
    # values below a bracket collapse into the null value, so they only cost a count
    hits = F.filter("_b", lambda b: F.col("_v") <= b["hi"])
    hits = F.transform(hits, lambda b: F.struct(b["i"].alias("i"), F.when(F.col("_v") >= b["lo"], F.col("_v")).alias("v")))
    counted = (
        bracketed.select(*by, "_n", F.explode(hits).alias("_h"))
        .groupBy(*by, "_n", F.col("_h.i").alias("_i"), F.col("_h.v").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    counted = staged(counted, "quantile-candidates")
    ranked = _ranked_in_parts(counted, [*by, "_i"])
    columns = []
    for i, name in enumerate(names):
        position = F.lit(probs[name]) * (F.col("_n") - 1)
        here = (F.col("_i") == i) & F.col("_v").isNotNull()
        left = F.min(F.when(here & (F.col("_cum") > F.floor(position)), F.col("_v")))
        right = F.min(F.when(here & (F.col("_cum") > F.ceil(position)), F.col("_v")))
        fraction = F.max(position - F.floor(position))
        columns.append((left + (right - left) * fraction).alias(name))
    return ranked.groupBy(*by).agg(*columns)


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal too."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def _ranked(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Running row count up to each candidate value."""
    upto = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("_cum", F.sum("_c").over(upto))


def _ranked_in_parts(counted: DataFrame, keys: list[str], parts: int = 256) -> DataFrame:
    """``_ranked`` by value ranges of about equal size: range totals first, then each range alone."""
    points = [k / parts for k in range(1, parts)]
    splits = counted.where(F.col("_v").isNotNull()).groupBy(*keys).agg(F.percentile_approx("_v", points, 10_000).alias("_p"))
    # a part is the number of split points below the value, so parts are in value order
    part = F.when(F.col("_v").isNull(), F.lit(-1)).otherwise(F.size(F.filter("_p", lambda p: p < F.col("_v"))))
    placed = _same(counted, staged(splits, "quantile-splits"), keys, "left").withColumn("_part", part).drop("_p")
    totals = placed.groupBy(*keys, "_part").agg(F.sum("_c").alias("_t"))
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    before = totals.withColumn("_before", F.sum("_t").over(upto) - F.col("_t")).drop("_t")
    ranked = _same(_ranked(placed, [*keys, "_part"]), staged(before, "quantile-parts"), [*keys, "_part"])
    return ranked.withColumn("_cum", F.col("_cum") + F.col("_before")).drop("_part", "_before")
