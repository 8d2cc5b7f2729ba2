"""Scans, sinks, keys and calendar."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import keys as K
from ..operators import forecast as FC, joins as J, validation as V
from ..session import scratch_path
from ..sources import fixtures as X, sinks, tables
from .registry import MONTH_NAME, geo_sql, query, rounded, score_sql

# The given parquet tables.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query("scan_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLES), base=False)
def scan_tables(spark, d):
    from ..operators.profile import row_counts

    return row_counts(tables.read_parquet_tables(spark, d, TABLES))


@query(
    "csv_tables",
    """
SELECT 'pre_owned_house_transactions' AS name, count(*) AS n_rows, round(sum(num), 2) AS num, round(sum(amount), 1) AS total FROM second_hand
UNION ALL SELECT 'land_transactions', count(*), CAST(sum(num) AS DOUBLE), round(sum(transaction_amount), 1) FROM land
""",
)
def csv_tables(spark, d):
    """The side tables written as CSV files under the files' own column names, and loaded by name."""
    folder = scratch_path(spark, "csv")
    month, sector = K.month_label(F.col("t") + X.BASE_YEAR * 12 + 1), F.concat(F.lit("sector "), F.col("entity_id").cast("string"))
    for name, df, columns in (
        ("pre_owned_house_transactions", X.second_hand(spark, d), ("area", "amount", "num", "price")),
        ("land_transactions", X.land(spark, d), ("num", "area", "area", "transaction_amount")),
    ):
        wanted = tables.SCHEMAS[name].names[2:]
        rows = df.select(month.alias("month"), sector.alias("sector"), *[F.col(c).alias(w) for c, w in zip(columns, wanted)])
        sinks.write_report(rows, f"{folder}/{name}.csv")
    loaded = tables.load_tables(spark, folder, ("pre_owned_house_transactions", "land_transactions"))
    parts = []
    for name, num, total in (
        ("pre_owned_house_transactions", "num_pre_owned_house_transactions", "amount_pre_owned_house_transactions"),
        ("land_transactions", "num_land_transactions", "transaction_amount"),
    ):
        parts.append(loaded[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(num), 2).alias("num"), F.round(F.sum(total), 1).alias("total")))
    return parts[0].union(parts[1])


@query("scan_horizon", "SELECT id FROM horizon")
def scan_horizon(spark, d):
    path = scratch_path(spark, "horizon")
    sinks.write_report(X.horizon(spark, d).orderBy("row_no").select("id"), path)
    return tables.load_test(spark, path)


_SEASONAL_IDS = f"""
per AS (SELECT entity_id, {geo_sql()} AS base FROM train GROUP BY entity_id)
SELECT h.id, round(coalesce(p.base, 0.0), 4) AS new_house_transaction_amount
FROM horizon h LEFT JOIN per p ON p.entity_id = h.entity_id
"""


@query("sink_csv_roundtrip", _SEASONAL_IDS)
def sink_csv_roundtrip(spark, d):
    path = scratch_path(spark, "submission")
    forecasts = FC.forecast_geo(X.panel(spark, d, X.LAST))
    sinks.write_submission(J.align_to_horizon(X.horizon(spark, d), forecasts), path)
    return rounded(tables.read_forecasts(spark, [path])[0])


@query(
    "params_json_roundtrip",
    f"""
pairs AS (SELECT n.lookback, g.guard FROM (SELECT unnest([3, 6, 9, 12, 18, 24]) AS lookback) n CROSS JOIN (SELECT unnest([3, 6, 9, 12]) AS guard) g),
per AS (
  SELECT q.lookback, q.guard, entity_id, {geo_sql("q.lookback", "q.guard", "54")} AS p
  FROM panel CROSS JOIN pairs q GROUP BY q.lookback, q.guard, entity_id),
scored AS (
  SELECT per.lookback, per.guard, {score_sql('a.amount', 'per.p')[0]} AS score
  FROM per JOIN panel a ON a.entity_id = per.entity_id AND a.t BETWEEN 55 AND 66 GROUP BY per.lookback, per.guard)
SELECT CAST(lookback AS INTEGER) AS lookback, CAST(guard AS INTEGER) AS guard, round(score, 6) AS score
FROM scored ORDER BY scored.score DESC, lookback, guard LIMIT 1
""",
)
def params_json_roundtrip(spark, d):
    grid = V.grid_geo(X.panel(spark, d), [3, 6, 9, 12, 18, 24], [3, 6, 9, 12], last=54)
    path = scratch_path(spark, "params")
    sinks.save_params(V.best(grid, ["lookback", "guard"]).drop("good_rate"), path)
    schema = T.StructType(
        [T.StructField("lookback", T.IntegerType()), T.StructField("guard", T.IntegerType()), T.StructField("score", T.DoubleType())]
    )
    return rounded(sinks.load_params(spark, path, schema, {"lookback": 6, "guard": 6}), 6)


@query(
    "fill_template",
    f"""
per AS (SELECT entity_id, {geo_sql()} AS base FROM train GROUP BY entity_id)
SELECT h.entity_id, h.t, round(coalesce(p.base, 0.0), 4) AS forecast FROM horizon h LEFT JOIN per p ON p.entity_id = h.entity_id
""",
)
def fill_template(spark, d):
    one = FC.forecast_geo(X.panel(spark, d, X.LAST), steps=1).select("entity_id", "forecast")
    template = X.horizon(spark, d).select("entity_id", "t", F.lit(0.0).alias("forecast"))
    return rounded(sinks.fill_template(template, one))


# ---- keys and calendar ----

_TEXT = f"""
texts AS (SELECT CAST(1995 + t // 12 AS VARCHAR) || '-' || {MONTH_NAME}[t % 12 + 1] AS month,
          'sector ' || CAST(entity_id AS VARCHAR) AS sector, amount FROM obs)
"""


@query(
    "parse_month",
    _TEXT + f"""
SELECT month, sector, CAST(substr(month, 1, 4) AS INTEGER) AS year,
       CAST(list_position({MONTH_NAME}, substr(month, 6)) AS INTEGER) AS month_num,
       CAST((CAST(substr(month, 1, 4) AS INTEGER) - 1995) * 12 + list_position({MONTH_NAME}, substr(month, 6)) - 1 AS INTEGER) AS t
FROM texts
""",
)
def parse_month(spark, d):
    return K.parse_month(X.raw_text(spark, d), base_year=X.BASE_YEAR).select("month", "sector", "year", "month_num", "t")


@query("parse_entity", _TEXT + "SELECT month, sector, CAST(regexp_extract(sector, '[0-9]+') AS BIGINT) AS entity_id FROM texts")
def parse_entity(spark, d):
    return K.parse_entity(X.raw_text(spark, d)).select("month", "sector", "entity_id")


@query(
    "explode_id",
    "SELECT row_no, id, split_part(id, '_', 1) AS month, split_part(id, '_', 2) AS sector, CAST(1995 + t // 12 AS INTEGER) AS year, "
    "CAST(t % 12 + 1 AS INTEGER) AS month_num, t, entity_id FROM horizon",
)
def explode_id(spark, d):
    ids = X.horizon(spark, d).select("row_no", "id")
    return K.explode_id(ids, base_year=X.BASE_YEAR, default_t=X.LAST + 1)


@query(
    "calendar_features",
    "SELECT entity_id, t, CAST(t % 12 + 1 AS INTEGER) AS month_num, CAST(1995 + t // 12 AS INTEGER) AS year, "
    "CAST((t % 12) // 3 + 1 AS INTEGER) AS quarter, CAST(t % 12 = 11 AS INTEGER) AS is_december FROM panel",
)
def calendar_features(spark, d):
    return K.calendar_features(X.panel(spark, d), X.BASE_YEAR).drop("amount")


@query(
    "season_code",
    "SELECT entity_id, t, CAST(CASE WHEN t % 12 IN (11, 0, 1) THEN 0 WHEN t % 12 < 5 THEN 1 WHEN t % 12 < 8 THEN 2 ELSE 3 END AS INTEGER) AS season FROM panel",
)
def season_code(spark, d):
    return X.panel(spark, d).select("entity_id", "t", K.season_code().alias("season"))


def _wave(f: str, phase: str, period: int) -> str:
    return f"round({f}(2 * pi() * ({phase}) / {period}), 4) + 0.0 AS {f}_{period}"


@query("fourier_annual", f"SELECT entity_id, t, {_wave('sin', 't % 12', 12)}, {_wave('cos', 't % 12', 12)} FROM panel")
def fourier_annual(spark, d):
    return rounded(K.fourier(X.panel(spark, d).drop("amount"), [12]))


@query(
    "fourier_harmonics",
    "SELECT entity_id, t, " + ", ".join(_wave(f, "t % 12", p) for p in (12, 6, 3) for f in ("sin", "cos")) + " FROM panel",
)
def fourier_harmonics(spark, d):
    return rounded(K.fourier(X.panel(spark, d).drop("amount"), [12, 6, 3], K.month_of("t") - 1))


@query("year_progress", "SELECT entity_id, t, round(t / (SELECT max(t) FROM panel), 6) AS year_progress FROM panel")
def year_progress(spark, d):
    return rounded(K.year_progress(X.panel(spark, d)).drop("amount"), 6)


@query(
    "month_label_roundtrip",
    f"""SELECT entity_id, t, CAST((1995 + t // 12) * 12 + t % 12 + 1 AS INTEGER) AS abs_month,
CAST(1995 + t // 12 AS VARCHAR) || '-' || {MONTH_NAME}[t % 12 + 1] AS label FROM obs""",
)
def month_label_roundtrip(spark, d):
    rows = K.calendar_features(X.obs(spark, d), X.BASE_YEAR)
    rows = rows.withColumn("abs_month", K.abs_month(F.col("year"), F.col("month_num")))
    return rows.select("entity_id", "t", "abs_month", K.month_label(F.col("abs_month")).alias("label"))
