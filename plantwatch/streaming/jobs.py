"""The same operators over streams.

Row-frame windows, exact percentiles and joins with the future don't run on an
unbounded table, so features work in micro-batches on the new rows and a kept
tail, and whatever needs the past keeps state by equipment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plantwatch.operators.history import tail_buffer


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Replay of files in order of arrival, so many for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tick_windows(stream: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Tumbling windows by equipment; rows later than the watermark are dropped."""
    at = F.col("ts").cast("timestamp")
    return stream.withColumn("ts", at).withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "equip_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")).select("equip_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "mean", "low", "high")


def sessions(stream: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of rows that are flagged, merged over gaps."""
    at = F.col("ts").cast("timestamp")
    got = stream.where("flag").withColumn("ts", at).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "equip_id").agg(F.count("*").alias("n"))
    return got.select("equip_id", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n")


def drop_late_duplicates(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([*keys, "ts"])


def running_cusum(stream: DataFrame, k: float, h: float) -> DataFrame:
    """Closings of a CUSUM that starts over, with the sum kept as state by equipment.

    The mean that a batch takes from its data is a parameter here: x is expected
    to be standardised.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, start = state.get if state.exists else (0.0, None)
        rows = []
        for frame in frames:
            for ts, x in frame.sort_values("ts")[["ts", "x"]].itertuples(index=False):
                s = max(0.0, s + x - k)
                if start is None and s > 0:
                    start = ts.value // 1000
                if start is not None and s > h:
                    rows.append((key[0], pd.Timestamp(start * 1000), ts, s))
                    s, start = 0.0, None
        state.update((s, start))
        yield pd.DataFrame(rows, columns=["equip_id", "start_ts", "end_ts", "cusum"])

    return stream.select("equip_id", F.col("ts").cast("timestamp").alias("ts"), "x").groupBy("equip_id").applyInPandasWithState(
        step, "equip_id int, start_ts timestamp, end_ts timestamp, cusum double", "s double, start long", "append", GroupStateTimeout.NoTimeout
    )


def coldstart_gate(stream: DataFrame, required: int = 500) -> DataFrame:
    """Rows gathered by equipment and whether there are enough to train on."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({"equip_id": [key[0]], "rows": [n], "ready": [n >= required]})

    return stream.select("equip_id", "ts").groupBy("equip_id").applyInPandasWithState(step, "equip_id int, rows long, ready boolean", "n long", "update", GroupStateTimeout.NoTimeout)


def with_tail(process: Callable[[DataFrame], DataFrame], buffer: str, out: str, hours: float = 72, most: int = 100_000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the kept tail and the new rows are processed together, results of new rows written, the tail kept on.

    Buffer and results are written by batch number, so a batch that runs again
    writes the same files.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if number == 0 else batch.unionByName(spark.read.parquet(f"{buffer}/batch={number - 1}"))
        first = batch.groupBy("equip_id").agg(F.min("ts").alias("_first"))
        got = process(rows).join(first, "equip_id").where("ts >= _first").drop("_first")
        got.write.mode("overwrite").parquet(f"{out}/batch={number}")
        tail_buffer(rows, hours, most).write.mode("overwrite").parquet(f"{buffer}/batch={number}")

    return run


def run_available(query_writer, checkpoint: str):
    """Everything that is there, then stop; the checkpoint says where to go on."""
    query = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
