"""Streams cut into micro-batches give the rows of the batch operators, the last windows and parts included."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clipgraph.streaming import stream as T

SCHEMA = "event_id long, rec int, ts timestamp, label int, x double"


@pytest.fixture(scope="module")
def rows(spark):
    # five files of ten minutes each, one row every twenty seconds; nothing comes late
    return [(i, i % 2, 20 * i, i % 3, float((i * 37) % 11)) for i in range(150)]


def feed(spark, rows, folder, files):
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], "event_id long, rec int, s long, label int, x double")
        part.select("event_id", "rec", F.timestamp_seconds("s").alias("ts"), "label", "x").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def listed(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("files", [1, 5])
def test_windows_and_sessions_end_with_the_stream(spark, rows, tmp_path, files):
    df = feed(spark, rows, f"{tmp_path}/in", files)
    still = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for name, make in {"w": lambda s: T.stream_windows(s, "7 minutes", None, "1 minute"), "s": lambda s: T.stream_sessions(s, "50 seconds", "1 minute")}.items():
        got = T.run_to_end(make, df, f"{tmp_path}/{name}")
        assert listed(got) == listed(make(still)) and got.count() > 1


@pytest.mark.parametrize("files", [1, 5])
def test_parts_do_not_depend_on_batches(spark, rows, tmp_path, files):
    seen = []

    def refine(done):
        seen.append(done.select("part").distinct().count())
        return done.groupBy("rec", "part").agg(F.count("*").alias("n"), F.sum("x").alias("x"))

    got = T.stream_refine(feed(spark, rows, f"{tmp_path}/in", files), T.PartRefiner(refine, f"{tmp_path}/work", 300 * 10 ** 6, 60 * 10 ** 6))
    still = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in").withColumn("part", F.floor(F.unix_micros("ts") / (300 * 10 ** 6)))
    assert listed(got.select("rec", "part", "n", "x")) == listed(refine(still).select("rec", "part", "n", "x"))
    assert len([s for s in seen[:-1] if s]) > 1 or files == 1


def test_a_retried_batch_changes_nothing(spark, rows, tmp_path):
    refiner = T.PartRefiner(lambda done: done.groupBy("part").agg(F.count("*").alias("n")), f"{tmp_path}/work", 300 * 10 ** 6, 0)
    frame = spark.createDataFrame(rows, "event_id long, rec int, s long, label int, x double").select("rec", F.timestamp_seconds("s").alias("ts"), "x")
    for epoch, part in ((0, frame.where("x < 6")), (1, frame.where("x >= 6 AND ts >= timestamp_seconds(2900)")), (1, frame.where("x >= 6 AND ts >= timestamp_seconds(2900)"))):
        refiner(part, epoch)
    refiner.finish(spark)
    out = spark.read.parquet(f"{tmp_path}/work/refined")
    assert out.groupBy("part").count().where("count > 1").count() == 0
    assert out.agg(F.sum("n")).head()[0] == frame.where("x < 6 OR ts >= timestamp_seconds(2900)").count()


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_is_streamed_from_a_file_or_a_folder(spark, tmp_path, files):
    from clipgraph.registry.core import table_stream

    made = f"{tmp_path}/made"
    spark.range(90).selectExpr("id AS vec_id").repartition(files).write.parquet(made)
    if files == 1:
        part = next(tmp_path.joinpath("made").glob("*.parquet"))
        tmp_path.joinpath("t.parquet").write_bytes(part.read_bytes())
    else:
        spark.read.parquet(made).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(5).selectExpr("id AS vec_id").write.parquet(f"{tmp_path}/other.parquet")
    rows = table_stream(spark, str(tmp_path), "t", "vec_id long").withColumn("ts", F.timestamp_seconds("vec_id"))
    got = T.stream_refine(rows, T.PartRefiner(lambda done: done.select("vec_id", "part"), f"{tmp_path}/work", 10 * 10 ** 6, 0))
    assert sorted(r["vec_id"] for r in got.collect()) == list(range(90))


def test_a_stream_without_rows_has_no_parts(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    assert T.stream_refine(rows, T.PartRefiner(lambda done: done.select("rec", "part"), f"{tmp_path}/work", 10 * 10 ** 6, 0)).count() == 0
