import pytest
from pyspark.sql import functions as F

from quillon import col, lit
from quillon.streaming.batches import Pipeline, drop_stage, file_stream, filter_stage, map_stage, project_stage, rename_stage, session_stage, window_stage, with_columns_stage


@pytest.fixture
def stream(spark, tmp_path):
    spark.range(0, 100, 1, 5).select("id", (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts")).write.parquet(str(tmp_path / "in"))
    return file_stream(spark, str(tmp_path / "in"), "id long, k long, ts timestamp_ntz", files_per_batch=1)


def test_row_local_stages(stream):
    p = Pipeline(stream, filter_stage(col("id") >= 90), with_columns_stage((col("id") * 2).alias("d")), rename_stage("d", "twice"), drop_stage("ts"), map_stage(lambda b: b, "id long, k long, twice long"), project_stage(col("id"), col("twice")))
    assert sorted(tuple(r) for r in p.collect("stages").collect()) == [(i, 2 * i) for i in range(90, 100)]
    with pytest.raises(ValueError):
        filter_stage(col("id").cum_sum() > 3)


def test_windows_equal_the_bounded_result(spark, stream, tmp_path):
    stage = window_stage("ts", "30 minutes", ["k"], {"n": F.count(F.lit(1))}, late="1 day")
    got = {tuple(r) for r in Pipeline(stream, stage).collect("windows", "complete").collect()}
    assert got == {tuple(r) for r in stage(spark.read.parquet(str(tmp_path / "in"))).collect()} and len(got) == 12
    one = session_stage("ts", "5 minutes", [], {"n": F.count(F.lit(1))})(spark.read.parquet(str(tmp_path / "in"))).collect()
    assert [r["n"] for r in one] == [100]


def test_parquet_sink_and_slice(spark, stream, tmp_path):
    Pipeline(stream, filter_stage(col("k") == 0)).start(str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 34
    Pipeline(stream).slice(str(tmp_path / "cut"), str(tmp_path / "cp2"), 30, 25).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "cut")).count() == 25


def test_collected_rows_stay_out_of_the_driver(spark, stream):
    rows = Pipeline(stream, with_columns_stage(lit(None).alias("none"))).collect("landed")
    assert "MemoryPlan" not in rows._jdf.queryExecution().optimizedPlan().toString() and len(rows.inputFiles()) >= 5
    assert rows.count() == 100 and dict(rows.dtypes)["none"] == "void"
    per_key = window_stage("ts", "1 hour", ["k"], {"n": F.count(F.lit(1))})
    got = Pipeline(stream, per_key).collect("landed_complete", "complete")
    assert "MemoryPlan" not in got._jdf.queryExecution().optimizedPlan().toString() and got.agg(F.sum("n")).first()[0] == 100
    assert Pipeline(stream, filter_stage(col("id") < 0)).collect("landed").count() == 0


def test_host_functions_in_collected_stages(spark, stream):
    p = Pipeline(stream, filter_stage(col("id") > 10), map_stage(lambda b: b, "id long, k long, ts timestamp_ntz"), rename_stage("k", "key"))
    rows = p.collect("mapped")
    assert "MemoryPlan" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["id"] for r in rows.collect()) == list(range(11, 100)) and rows.columns == ["id", "key", "ts"]


def test_streamed_sessions_equal_the_bounded_result(spark, stream, tmp_path):
    stage = session_stage("ts", "2 minutes", ["k"], {"n": F.count(F.lit(1))}, late="1 day")
    rows = Pipeline(stream, stage).collect("sessions", "complete")
    assert "MemoryPlan" not in rows._jdf.queryExecution().optimizedPlan().toString()
    # a key has a row every three minutes
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, stage(spark.read.parquet(str(tmp_path / "in"))).collect())) and rows.count() == 100
