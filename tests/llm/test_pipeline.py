"""SQL twins of the text queries, and the stages against brute-force versions."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from check_oracle import normal
from tests.llm.test_brute import brute_components, plain_spans
from tidepanel.llm import lines as LN
from tidepanel.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_twin(spark, sf, key):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    df = QUERIES[key](spark, sf)
    got = df.collect()
    result = con.execute(ORACLES[key])
    names = [c[0] for c in result.description]
    want = result.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert sorted(tuple(normal(r[c]) for c in order) for r in got) == sorted(tuple(normal(r[names.index(c)]) for c in order) for r in want)


def test_stages_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def written(stage):
        def run(spark, docs, sf):
            stage(spark, docs, sf).write.mode("overwrite").parquet(path := f"file://{tmp_path}/{stage.__name__}")
            return spark.read.parquet(path)

        return run

    stages = {name: written(stage) for name, stage in CP.STAGES}
    judged = {r["doc_id"] for r in QUERIES["op1_quality_rules"](spark, sf).where("kept").collect()}
    good = stages["quality_rules"](spark, docs, sf)
    assert {r["doc_id"] for r in good.collect()} == judged
    fewer = stages["line_dedup"](spark, good, sf)
    assert fewer.columns == docs.columns
    report = {r["doc_id"]: r["n_dropped"] < r["n_lines"] for r in LN.line_report(good).collect()}
    assert {r["doc_id"] for r in fewer.collect()} == {d for d in judged if report[d]}
    lines = [x for r in fewer.select("text").collect() for x in r["text"].split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    assert fewer.where(F.length("text") != F.col("n_chars")).count() == 0
    single = stages["ngram_join"](spark, docs, sf)
    groups = brute_components({r["doc_id"]: r["text"] for r in docs.collect()}, 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {d for d, (_, top, _) in groups.items() if top == d}
    private = stages["pii"](spark, docs, sf)
    assert private.columns == docs.columns and private.count() == docs.count()
    assert not [r for r in private.collect() if plain_spans(r["text"])]


def test_run(spark, sf):
    rows = CP.run(spark, sf).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_bound_the_bytes_of_a_batch(spark):
    """Rows alone do not bound the memory of a worker: 800 texts of 16 KB are one batch of 10,000 rows at most."""
    docs = spark.range(800).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a word "), 2300).alias("text")).coalesce(1)

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    rows = CP._step(lambda spark, docs, sf_dir: docs.mapInArrow(held, "n long, size long"))(spark, docs, "").collect()
    assert sum(r["n"] for r in rows) == 800
    assert max(r["size"] for r in rows) < 6 << 20


def test_equal_lines_of_a_task_give_one_row_of_segments(spark):
    """However its texts are dealt into batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(40).select(F.lit("one line that stands in every text of the task\nand a second one, as long as it has to be").alias("text")).coalesce(1)
    spark.conf.set(name, "2")
    try:
        assert LN._segment_keys(docs, 2, 24).count() == 2
    finally:
        spark.conf.set(name, before)
