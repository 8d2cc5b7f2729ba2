import pytest
from pyspark.sql import types as T

from tidepanel.session import scratch_path, shared_folder, staged
from tidepanel.sources import sinks, tables


def test_missing_table_names_its_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="new_house_transactions.csv"):
        tables.load_tables(spark, str(tmp_path))


def test_load_tables(spark, tmp_path):
    folder = tmp_path
    for name in tables.TRAIN_TABLES:
        schema = tables.SCHEMAS.get(name)
        header = schema.names if schema else ["sector", "a"]
        (folder / f"{name}.csv").write_text(",".join(header) + "\n" + ",".join(["1"] * len(header)) + "\n")
    loaded = tables.load_tables(spark, str(folder))
    assert set(loaded) == set(tables.TRAIN_TABLES)
    assert loaded["new_house_transactions"].schema == tables.SCHEMAS["new_house_transactions"]
    assert all(df.count() == 1 for df in loaded.values())


def test_types_come_from_all_rows_and_misfits_fail(spark, tmp_path):
    (tmp_path / "t.csv").write_text("sector,a\n" + "".join(f"{i},{i}\n" for i in range(3000)) + "x,3.75\n")
    loaded = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(loaded.dtypes)["a"] == "double" and loaded.where("sector = 'x'").first()["a"] == 3.75
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "t.csv"), T.StructType([T.StructField("sector", T.LongType()), T.StructField("a", T.LongType())])).collect()


def test_submission_keeps_order(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 2.0), (1, "a", 1.0), (3, "c", 3.0)], "row_no long, id string, forecast double")
    path = str(tmp_path / "out")
    sinks.write_submission(df, path)
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines() if not line.startswith("id,")]
    assert lines == ["a,1.0", "b,2.0", "c,3.0"]
    assert tables.read_forecasts(spark, [path])[0].columns == ["id", "new_house_transaction_amount"]


def test_params_default(spark, tmp_path):
    schema = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("rate", T.DoubleType())])
    path = str(tmp_path / "params")
    assert sinks.load_params(spark, path, schema, {"depth": 6, "rate": 0.1}).first().asDict() == {"depth": 6, "rate": 0.1}
    sinks.save_params(spark.createDataFrame([(8,)], "depth int"), path)
    assert sinks.load_params(spark, path, schema, {"depth": 6, "rate": 0.1}).first().asDict() == {"depth": 8, "rate": 0.1}


def test_staged_lands_in_the_shared_folder(spark):
    df = staged(spark.range(5), "x")
    assert df.count() == 5
    assert df.inputFiles()[0].startswith("file:" + shared_folder(spark)) or shared_folder(spark) in df.inputFiles()[0]
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
