"""Gaps and islands, as-of joins and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plantwatch.functions.scalar import seconds, seconds_between


def islands(df: DataFrame, value: str, by: str = "equip_id", ts: str = "ts") -> DataFrame:
    """A row for each run of an equal value: start, end, rows, the next run's start; nulls make runs of their own."""
    order = W.partitionBy(by).orderBy(ts)
    change = ~F.col(value).eqNullSafe(F.lag(value).over(order)) | F.lag(ts).over(order).isNull()
    numbered = df.withColumn("run", F.sum(change.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = numbered.groupBy(by, "run").agg(F.first(value).alias(value), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_rows"))
    return runs.withColumn("next_ts", F.lead("start_ts").over(W.partitionBy(by).orderBy("run")))


def asof(left: DataFrame, right: DataFrame, value: str, by: str = "equip_id", ts: str = "ts", direction: str = "backward") -> DataFrame:
    """The right side's last row at or before each left row (or first at or after), without a range join.

    Both sides are put together and sorted once; each left row takes the nearest
    right row that the sort has passed.
    """
    r = right.where(F.col(ts).isNotNull()).select(by, F.col(ts).alias("_t"), F.lit(0 if direction == "backward" else 1).alias("_side"), F.struct(F.col(ts).alias("right_ts"), F.col(value)).alias("_r"))
    cols = left.columns
    l = left.select(by, F.col(ts).alias("_t"), F.lit(1 if direction == "backward" else 0).alias("_side"), F.struct(*cols).alias("_l"))
    both = l.unionByName(r, allowMissingColumns=True)
    # forward is the same in the other order: a frame that only grows costs one step a row
    order = ["_t", "_side"] if direction == "backward" else [F.desc("_t"), F.desc("_side")]
    got = F.last("_r", True).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    met = both.withColumn("_r", got).where("_l is not null")
    return met.select("_l.*", F.col("_r.right_ts").alias("right_ts"), F.col(f"_r.{value}").alias(value))


def nearest(left: DataFrame, right: DataFrame, value: str, by: str = "equip_id", ts: str = "ts") -> DataFrame:
    """The right row nearest in time; of two equally near the later."""
    cols = [x for x in left.columns]
    back = asof(left, right.withColumnRenamed(value, "_b"), "_b", by, ts, "backward").withColumnRenamed("right_ts", "_bt")
    both = asof(back, right.withColumnRenamed(value, "_f"), "_f", by, ts, "forward").withColumnRenamed("right_ts", "_ft")
    down, up = seconds_between("_bt", ts), seconds_between(ts, "_ft")
    after = F.col("_bt").isNull() | (up <= down)
    return both.select(*cols, F.when(after, F.col("_ft")).otherwise(F.col("_bt")).alias("right_ts"), F.when(after, F.col("_f")).otherwise(F.col("_b")).alias(value))


def inside(points: DataFrame, intervals: DataFrame, by: str = "equip_id", ts: str = "ts", bucket_seconds: int = 86_400) -> DataFrame:
    """Points with every interval [start_ts, end_ts] that holds them.

    An equality join on a time bucket: intervals are listed once for each bucket
    they touch, so neither side is compared with all of the other.
    """
    at = lambda x: F.floor(seconds(x) / bucket_seconds).cast("long")
    spans = intervals.where(F.col("end_ts") >= F.col("start_ts")).withColumn("_b", F.explode(F.sequence(at("start_ts"), at("end_ts"))))
    return points.withColumn("_b", at(ts)).join(spans, [by, "_b"]).where(F.col(ts).between(F.col("start_ts"), F.col("end_ts"))).drop("_b")


def micros(x: Column | str) -> Column:
    """Microseconds of a timestamp without zone, as a whole number."""
    return F.unix_micros((F.col(x) if isinstance(x, str) else x).cast("timestamp"))


def grid_last(samples: DataFrame, grid_start: Column, step_seconds: float) -> DataFrame:
    """Each sample with the grid point at or after it: (previous point, point], an equality key in place of a range."""
    return samples.withColumn("cell", F.ceil((micros("ts") - micros(grid_start)) / F.lit(round(step_seconds * 1e6))).cast("long"))
