"""Statistics over the other members of an entity's group, without pairing members.

The group totals are aggregated once per ``(group, t)`` and an entity's own value
is taken out again, so the work is linear in the panel however large a group is. The member
farthest from the mean gets statistics of the others alone, from a second aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged


STATS = ("mean", "sum", "max", "std")


def peer_stats(panel: DataFrame, group: str, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """``panel`` plus ``<value>_peer_<stat>`` over the other rows of the same group and period.

    ``wanted`` names the statistics (``mean sum max std count``) per value column.

    A null value counts as an absent row. Without any other row the result is null,
    and ``std`` needs two. ``panel`` must be unique per ``(entity_id, t)``.
    """
    panel = staged(panel, "peers-panel")
    values = list(wanted)
    keys = [group, "t"]
    first = panel.groupBy(*keys).agg(
        *[
            expr
            for v in values
            for expr in (
                F.count(v).alias(f"_n_{v}"),
                F.sum(v).alias(f"_s_{v}"),
                F.avg(v).alias(f"_m_{v}"),
                (F.var_pop(v) * F.count(v)).alias(f"_q_{v}"),
                F.max(v).alias(f"_top_{v}"),
                F.max_by("entity_id", v).alias(f"_who_{v}"),
                F.min(v).alias(f"_low_{v}"),
                F.min_by("entity_id", v).alias(f"_least_{v}"),
            )
        ]
    )
    # the value farthest from the mean is the largest or the smallest
    first = first.withColumns(
        {
            f"_far_{v}": F.when(F.col(f"_top_{v}") - F.col(f"_m_{v}") >= F.col(f"_m_{v}") - F.col(f"_low_{v}"), F.col(f"_who_{v}")).otherwise(F.col(f"_least_{v}"))
            for v in values
        }
    )
    first = staged(first, "peers-first")
    marked = panel.join(first.select(*keys, *[f"_{m}_{v}" for v in values for m in ("who", "far")]), keys)
    rest = {v: F.when(F.col("entity_id") != F.col(f"_far_{v}"), F.col(v)) for v in values}
    second = marked.groupBy(*keys).agg(
        *[
            expr
            for v in values
            for expr in (
                F.max(F.when(F.col("entity_id") != F.col(f"_who_{v}"), F.col(v))).alias(f"_second_{v}"),
                F.sum(rest[v]).alias(f"_rs_{v}"),
                F.avg(rest[v]).alias(f"_rm_{v}"),
                F.stddev_samp(rest[v]).alias(f"_rd_{v}"),
            )
        ]
    )
    joined = panel.join(first.join(second, keys), keys, "left")
    out = {f"{v}_peer_{s}": _without_self(v, s) for v, stats in wanted.items() for s in stats}
    return joined.select(*panel.columns, *[c.alias(name) for name, c in out.items()])


def _without_self(v: str, stat: str) -> Column:
    """A statistic of the others. For the farthest member it was taken from them alone; for any other the farthest
    is among them, so that taking one value out of the totals loses no digits."""
    own = F.col(v)
    here = own.isNotNull()
    far = here & (F.col("entity_id") == F.col(f"_far_{v}"))
    n = F.col(f"_n_{v}") - here.cast("bigint")
    total = F.col(f"_s_{v}") - F.coalesce(own, F.lit(0.0))
    if stat == "count":
        return n
    if stat == "sum":
        return F.when(n > 0, F.when(far, F.col(f"_rs_{v}")).otherwise(total))
    if stat == "mean":
        return F.when(n > 0, F.when(far, F.col(f"_rm_{v}")).otherwise(total / n))
    if stat == "max":
        mine = F.col(f"_who_{v}") == F.col("entity_id")
        return F.when(n > 0, F.when(here & mine, F.col(f"_second_{v}")).otherwise(F.col(f"_top_{v}")))
    # taking one value out of a sum of squared deviations from the group mean
    removed = F.when(here, F.pow(own - F.col(f"_m_{v}"), 2) * F.col(f"_n_{v}") / n).otherwise(F.lit(0.0))
    left = F.greatest(F.col(f"_q_{v}") - removed, F.lit(0.0))
    return F.when(n > 1, F.when(far, F.col(f"_rd_{v}")).otherwise(F.sqrt(left / (n - 1))))


def nearby_agg(df: DataFrame, value: str, aggs: tuple[str, ...] = ("mean", "sum", "max", "std"), prefix: str = "nearby") -> DataFrame:
    """Aggregates of a side table per ``(entity_id, t)``."""
    functions = {"mean": F.avg, "sum": F.sum, "max": F.max, "std": F.stddev_samp}
    return df.groupBy("entity_id", "t").agg(*[functions[a](value).alias(f"{prefix}_{a}") for a in aggs])
