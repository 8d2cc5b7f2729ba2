"""Forecast, report and parameter files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .tables import path_exists


def write_submission(df: DataFrame, path: str, value: str = "forecast", name: str = "new_house_transaction_amount") -> None:
    """``id,value`` rows in the order of ``row_no``: a range-partitioned sort, one file per range."""
    rows = df.orderBy("row_no").select("id", F.col(value).alias(name))
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


write_importance = write_report


def save_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").json(path)


def load_params(spark: SparkSession, path: str, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """Saved parameters with defaults for absent fields, or the defaults when nothing was saved."""
    if not path_exists(spark, path):
        return spark.createDataFrame([tuple(defaults.get(n) for n in schema.names)], schema)
    df = spark.read.schema(schema).json(path)
    filled = [F.coalesce(F.col(f.name), F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in schema.fields]
    return df.select(*filled)


def fill_template(template: DataFrame, values: DataFrame, value: str = "forecast") -> DataFrame:
    """Overwrite the template's value where one is given, for each of its periods."""
    keys = [c for c in ("entity_id", "t") if c in values.columns]
    new = values.select(*keys, F.col(value).alias("_new"))
    out = template.join(new, keys, "left")
    return out.withColumn(value, F.coalesce("_new", value)).drop("_new")
