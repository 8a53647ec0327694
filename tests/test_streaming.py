"""Streams over files give what the batch operators give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantwatch.operators.rolling import frame
from plantwatch.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "equip_id int, ts timestamp_ntz, value double"


@pytest.fixture
def files(spark, tmp_path):
    path = str(tmp_path / "in")
    for k in range(3):
        rows = [(i % 2, T0 + timedelta(minutes=100 * k + i), float(i + k)) for i in range(100)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(spark, stream, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_tick_windows(spark, files, tmp_path):
    got = drain(spark, jobs.tick_windows(spark.readStream.schema(SCHEMA).parquet(files), 30, "0 minutes"), "ticks", tmp_path)
    whole = spark.read.schema(SCHEMA).parquet(files).count()
    n = got.agg(F.sum("n")).first()[0]
    assert 0 < n <= whole and got.where("n > 15").count() == 0


def test_sessions_and_gate(spark, files, tmp_path):
    flagged = spark.readStream.schema(SCHEMA).parquet(files).withColumn("flag", F.col("value") > 50)
    got = drain(spark, jobs.sessions(flagged, "5 minutes", "0 minutes"), "sess", tmp_path)
    assert got.count() >= 2
    gate = drain(spark, jobs.coldstart_gate(spark.readStream.schema(SCHEMA).parquet(files), 150), "gate", tmp_path, "update")
    assert {r.equip_id: r.n for r in gate.groupBy("equip_id").agg(F.max("rows").alias("n")).collect()} == {0: 150, 1: 150}
    assert gate.where("ready").count() >= 2


def test_running_cusum(spark, tmp_path):
    path = str(tmp_path / "x")
    x = [0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0]
    for k in range(3):  # three files in order, so that state is carried over
        rows = [(0, T0 + timedelta(minutes=3 * k + i), x[3 * k + i]) for i in range(3)]
        spark.createDataFrame(rows, "equip_id int, ts timestamp_ntz, x double").coalesce(1).write.mode("append").parquet(path)
    stream = jobs.read_files(spark, path, "equip_id int, ts timestamp_ntz, x double")
    got = [(r.start_ts, r.end_ts) for r in drain(spark, jobs.running_cusum(stream, 0.5, 1.2), "cus", tmp_path).orderBy("end_ts").collect()]
    assert got[0] == (T0 + timedelta(minutes=1), T0 + timedelta(minutes=3))


def test_batches_with_a_tail_equal_one_batch(spark, files, tmp_path):
    def feature(df):
        return df.select("equip_id", "ts", F.avg("value").over(frame(5)).alias("m"))

    out, buffer = str(tmp_path / "out"), str(tmp_path / "buf")
    writer = jobs.read_files(spark, files, SCHEMA).withColumn("seq", F.lit(0)).writeStream.foreachBatch(jobs.with_tail(feature, buffer, out))
    jobs.run_available(writer, str(tmp_path / "check"))
    got = sorted((r.equip_id, r.ts, round(r.m, 9)) for r in spark.read.parquet(out).collect())
    want = sorted((r.equip_id, r.ts, round(r.m, 9)) for r in feature(spark.read.schema(SCHEMA).parquet(files)).collect())
    assert got == want
