"""The library's input tables, derived from star-schema parquet files.

``t`` counts months from January 1995, up to the newest line item. Forecasts take periods
up to 66 as history and 67 to 78 as the horizon; the rest of the library uses all periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import keys as K
from ..operators.grid import densify, grid
from ..session import staged

BASE_YEAR = 1995
LAST = 66
STEPS = 12
END = LAST + STEPS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def facts(spark: SparkSession, folder: str, flag: str | None = "R", hi: int | None = None) -> DataFrame:
    """Raw line items as ``(entity_id, t, flag, quantity, amount, part)``, of all periods or up to ``hi``; flag and date reach the scan."""
    rows = lines = table(spark, folder, "lineitem")
    if hi is not None:
        year, month = divmod(hi + 1, 12)
        cut = F.lit(f"{BASE_YEAR + year}-{month + 1:02d}-01").cast(lines.schema["l_shipdate"].dataType)
        rows = lines.where(F.col("l_shipdate") < cut)
    if flag is not None:
        rows = rows.where(F.col("l_returnflag") == flag)
    return rows.select(
        F.col("l_suppkey").cast("bigint").alias("entity_id"),
        K.date_index("l_shipdate", BASE_YEAR).alias("t"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_partkey").alias("part"),
    )


def _present(rows: DataFrame, *cols) -> DataFrame:
    return rows.groupBy("entity_id", "t").agg(*cols)


def last_period(spark: SparkSession, folder: str) -> Column:
    """The newest period of the line items, a scalar from a scan of one column."""
    newest = table(spark, folder, "lineitem").agg(F.max("l_shipdate").alias("d"))
    return newest.select(K.date_index("d", BASE_YEAR)).scalar()


def all_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Target, second-hand and land sums per cell from one scan, written once: ``amount``, ``pht`` and ``lt``, null where a cell has no such line."""
    per = _present(
        facts(spark, folder, None),
        *[F.round(F.sum(F.when(F.col("flag") == flag, F.col("amount"))), 2).alias(name) for flag, name in (("R", "amount"), ("A", "pht"), ("N", "lt"))],
    )
    return staged(per, "cells")


def obs(spark: SparkSession, folder: str, hi: int | None = None) -> DataFrame:
    """Present rows of the target."""
    sums = _present(
        facts(spark, folder, "R", hi),
        F.count(F.lit(1)).alias("num"),
        F.round(F.sum("quantity"), 2).alias("area"),
        F.round(F.sum("amount"), 2).alias("amount"),
    )
    return sums.withColumns(
        {
            "price": F.col("amount") / F.col("area"),
            "area_per_unit": F.col("area") / F.col("num"),
            "total_price_per_unit": F.col("amount") / F.col("num"),
        }
    )


def second_hand(spark: SparkSession, folder: str, hi: int | None = None) -> DataFrame:
    sums = _present(
        facts(spark, folder, "A", hi),
        F.count(F.lit(1)).alias("num"),
        F.round(F.sum("quantity"), 2).alias("area"),
        F.round(F.sum("amount"), 2).alias("amount"),
    )
    return sums.withColumn("price", F.col("amount") / F.col("area"))


def land(spark: SparkSession, folder: str, hi: int | None = None) -> DataFrame:
    return _present(
        facts(spark, folder, "N", hi),
        F.count(F.lit(1)).alias("num"),
        F.round(F.sum("quantity"), 2).alias("area"),
        F.round(F.sum("amount"), 2).alias("transaction_amount"),
    )


def entities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(F.col("s_suppkey").cast("bigint").alias("entity_id"))


def panel(spark: SparkSession, folder: str, hi: int | None = None) -> DataFrame:
    """The dense panel, straight from the raw rows: one scan, one shuffle. Without ``hi`` it ends at the newest line item."""
    end = last_period(spark, folder) if hi is None else hi
    return densify(facts(spark, folder, "R", hi), entities(spark, folder), 0, end, digits=2)


def nation_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("entity_id"), F.col("s_nationkey").alias("n_nationkey")
    )


def entity_static(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, folder, "region").select("r_regionkey")
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("entity_id"), "s_acctbal", F.col("s_nationkey").alias("n_nationkey")
    )
    parts = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").cast("bigint").alias("entity_id"))
        .agg(F.count_distinct("l_partkey").alias("n_parts"))
    )
    return supplier.join(nation, "n_nationkey").join(region, "r_regionkey").join(parts, "entity_id", "left").select(
        "entity_id", "s_acctbal", "n_nationkey", "r_regionkey", F.coalesce("n_parts", F.lit(0)).alias("n_parts")
    )


def yearly(spark: SparkSession, folder: str) -> DataFrame:
    """One row per year, written once so that its size is known when it is joined."""
    orders = table(spark, folder, "orders")
    per = orders.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.round(F.avg("o_totalprice"), 2).alias("avg_price"),
    )
    return staged(per, "yearly")


def raw_text(spark: SparkSession, folder: str, sep: str = "-") -> DataFrame:
    """The target with its keys as text."""
    return obs(spark, folder).select(
        K.month_label(F.col("t") + BASE_YEAR * 12 + 1, sep).alias("month"),
        F.concat(F.lit("sector "), F.col("entity_id").cast("string")).alias("sector"),
        "amount",
    )


def horizon_entities(spark: SparkSession, folder: str) -> DataFrame:
    """All known entities and one that has no history."""
    known = entities(spark, folder)
    unseen = known.agg((F.max("entity_id") + 1).alias("entity_id"))
    return known.union(unseen)


def horizon(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_no, id, entity_id, t)``, period by period as in a template file."""
    known = horizon_entities(spark, folder)
    width = known.agg(F.max("entity_id") + 1).scalar()
    rows = grid(known, LAST + 1, END).withColumn("row_no", (F.col("t") - LAST - 1) * width + F.col("entity_id"))
    return rows.select("row_no", K.horizon_id("t", "entity_id", BASE_YEAR).alias("id"), "entity_id", "t")


def events_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Users by day, from the first event to the last: another step size."""
    events = table(spark, folder, "events")
    span = events.agg(F.min("ts").cast("date").alias("start"), F.max("ts").cast("date").alias("end"))
    start = span.select("start").scalar()
    rows = events.select(
        F.col("user_id").cast("bigint").alias("entity_id"),
        F.datediff(F.col("ts").cast("date"), start).alias("t"),
        F.col("value").alias("amount"),
    )
    return densify(rows, rows.select("entity_id").distinct(), 0, span.select(F.datediff("end", "start")).scalar(), digits=2)
