"""Registry of queries and the base views their SQL twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.keys import MONTHS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BASE = """
WITH facts AS (
  SELECT CAST(l_suppkey AS BIGINT) AS entity_id,
         CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t,
         l_returnflag AS flag, l_quantity AS quantity, l_extendedprice AS amount
  FROM lineitem),
obs AS (
  SELECT entity_id, t, count(*) AS num, round(sum(quantity), 2) AS area, round(sum(amount), 2) AS amount
  FROM facts WHERE flag = 'R' GROUP BY entity_id, t),
second_hand AS (
  SELECT entity_id, t, count(*) AS num, round(sum(quantity), 2) AS area, round(sum(amount), 2) AS amount
  FROM facts WHERE flag = 'A' GROUP BY entity_id, t),
land AS (
  SELECT entity_id, t, count(*) AS num, round(sum(quantity), 2) AS area, round(sum(amount), 2) AS transaction_amount
  FROM facts WHERE flag = 'N' GROUP BY entity_id, t),
entities AS (SELECT CAST(s_suppkey AS BIGINT) AS entity_id, s_nationkey AS n_nationkey FROM supplier),
periods AS (SELECT CAST(unnest(range(0, (SELECT max(t) + 1 FROM facts))) AS INTEGER) AS t),
ahead AS (SELECT CAST(unnest(range(67, 79)) AS INTEGER) AS t),
panel AS (
  SELECT e.entity_id, p.t, coalesce(o.amount, 0.0) AS amount
  FROM entities e CROSS JOIN periods p LEFT JOIN obs o ON o.entity_id = e.entity_id AND o.t = p.t),
train AS (SELECT entity_id, t, amount FROM panel WHERE t <= 66),
horizon_entities AS (
  SELECT entity_id FROM entities UNION ALL SELECT max(entity_id) + 1 FROM entities),
horizon AS (
  SELECT (a.t - 67) * (SELECT max(entity_id) + 1 FROM horizon_entities) + h.entity_id AS row_no,
         CAST(1995 + a.t // 12 AS VARCHAR) || ' ' || {months}[a.t % 12 + 1]
           || '_sector ' || CAST(h.entity_id AS VARCHAR) AS id,
         h.entity_id, a.t
  FROM horizon_entities h CROSS JOIN ahead a)
"""

MONTH_NAME = str(list(MONTHS)).replace(" ", "")


def query(key: str, sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    """Register a query; ``sql`` continues the base views, or stands alone with ``base=False``."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            text = sql.strip()
            if base and text.startswith("RECURSIVE "):
                text = "WITH RECURSIVE" + BASE.strip().replace("{months}", MONTH_NAME).removeprefix("WITH") + ",\n" + text.removeprefix("RECURSIVE ")
            elif base:
                text = BASE.strip().replace("{months}", MONTH_NAME) + (" " if text.upper().startswith("SELECT") else ",\n") + text
            ORACLES[key] = text
        return fn

    return register


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round the double columns; adding 0 turns a negative zero into zero."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c), special.get(c, digits)) + F.lit(0.0) for c in doubles}) if doubles else df


def half_up(x: Column | str, digits: int = 4) -> Column:
    """Round half up. What lies within a ten-thousandth of the last digit below a tie counts as the tie: there only the last bit of a sum decides."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 10**digits + 0.5001) / 10**digits


def half_up_sql(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10**digits} + 0.5001) / {10**digits}"


def geo_sql(lookback: int = 6, guard: int = 6, last: str = "66", x: str = "amount") -> str:
    return (
        f"CASE WHEN min(CASE WHEN t > {last} - {guard} AND t <= {last} THEN {x} END) = 0 THEN 0.0 "
        f"ELSE coalesce(exp(avg(CASE WHEN t > {last} - {lookback} AND t <= {last} THEN ln(nullif({x}, 0)) END)), 0.0) END"
    )


def boost_sql(cap: float | None = 2.0, default: float = 1.3, last: str = "66") -> str:
    ratio = (
        f"avg(CASE WHEN t <= {last} AND t % 12 = 11 AND amount > 0 THEN amount END)"
        f" / avg(CASE WHEN t <= {last} AND t % 12 <> 11 AND amount > 0 THEN amount END)"
    )
    capped = ratio if cap is None else f"CASE WHEN {ratio} > {cap} THEN {cap} ELSE {ratio} END"
    return f"coalesce({capped}, {default})"


def score_sql(y: str = "y", p: str = "p", threshold: float = 0.7, fails: str = "<=") -> tuple[str, str]:
    ape = f"abs(({y} - {p}) / greatest({y}, 1e-12))"
    rate = f"avg(CASE WHEN {ape} <= 1 THEN 1.0 ELSE 0.0 END)"
    score = f"CASE WHEN {rate} {fails} {threshold} THEN 0.0 ELSE 1 - avg(CASE WHEN {ape} <= 1 THEN {ape} END) / {rate} END"
    return score, rate
