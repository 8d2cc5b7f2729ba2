"""Named source tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

# File stems of the nine training tables.
TRAIN_TABLES = (
    "new_house_transactions",
    "new_house_transactions_nearby_sectors",
    "pre_owned_house_transactions",
    "pre_owned_house_transactions_nearby_sectors",
    "land_transactions",
    "land_transactions_nearby_sectors",
    "sector_POI",
    "city_search_index",
    "city_indexes",
)


def _typed(texts: str, doubles: str = "", longs: str = "") -> T.StructType:
    """A schema of the listed text, double and long columns."""
    kinds = ((texts, T.StringType()), (doubles, T.DoubleType()), (longs, T.LongType()))
    return T.StructType([T.StructField(n, kind) for names, kind in kinds for n in names.split()])


_KEYS = "month sector"

# The column names of the files. Tables that are not listed have many or varying
# attribute columns; their types are inferred from all rows.
SCHEMAS: dict[str, T.StructType] = {
    "new_house_transactions": _typed(_KEYS, """
        num_new_house_transactions area_new_house_transactions price_new_house_transactions amount_new_house_transactions
        area_per_unit_new_house_transactions total_price_per_unit_new_house_transactions
        num_new_house_available_for_sale area_new_house_available_for_sale period_new_house_sell_through"""),
    "new_house_transactions_nearby_sectors": _typed(_KEYS, """
        num_new_house_transactions_nearby_sectors area_new_house_transactions_nearby_sectors price_new_house_transactions_nearby_sectors
        amount_new_house_transactions_nearby_sectors area_per_unit_new_house_transactions_nearby_sectors
        total_price_per_unit_new_house_transactions_nearby_sectors num_new_house_available_for_sale_nearby_sectors
        area_new_house_available_for_sale_nearby_sectors period_new_house_sell_through_nearby_sectors"""),
    "pre_owned_house_transactions": _typed(_KEYS, """
        area_pre_owned_house_transactions amount_pre_owned_house_transactions num_pre_owned_house_transactions price_pre_owned_house_transactions"""),
    "pre_owned_house_transactions_nearby_sectors": _typed(_KEYS, """
        area_pre_owned_house_transactions_nearby_sectors amount_pre_owned_house_transactions_nearby_sectors
        num_pre_owned_house_transactions_nearby_sectors price_pre_owned_house_transactions_nearby_sectors"""),
    "land_transactions": _typed(_KEYS, "num_land_transactions construction_area planned_building_area transaction_amount"),
    "land_transactions_nearby_sectors": _typed(_KEYS, """
        num_land_transactions_nearby_sectors construction_area_nearby_sectors planned_building_area_nearby_sectors
        transaction_amount_nearby_sectors"""),
    "city_search_index": _typed("month keyword source", longs="search_volume"),
}

FORECAST_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("new_house_transaction_amount", T.DoubleType())]
)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV table with a header. Without a schema the types come from all rows; a value that does not fit is an error."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).option("enforceSchema", False).csv(path)


def load_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = TRAIN_TABLES) -> dict[str, DataFrame]:
    """CSV tables of a folder by name; a missing file is an error that names its path."""
    files = {name: f"{folder}/{name}.csv" for name in names}
    for path in files.values():
        if not path_exists(spark, path):
            raise FileNotFoundError(path)
    return {name: read_csv(spark, path, SCHEMAS.get(name)) for name, path in files.items()}


def load_test(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return read_csv(spark, path, T.StructType([T.StructField("id", T.StringType())]))


def read_forecasts(spark: SparkSession, paths: list[str], schema: T.StructType = FORECAST_SCHEMA) -> list[DataFrame]:
    return [read_csv(spark, p, schema) for p in paths]


def read_parquet_tables(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}
