"""Projections, filters and cleaning of sensor histories.

Wide frames are keyed by ``equip_id`` and ``ts``; long ones by ``equip_id``,
``tag`` and ``ts``. Every window is partitioned by those keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from plantwatch.functions.scalar import finite, seconds_between


def numeric_columns(df: DataFrame, leave: tuple[str, ...] = ("equip_id",)) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in leave]


def parse_ts(df: DataFrame, column: str, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd")) -> DataFrame:
    """The first format that reads; what none reads is null."""
    return df.withColumn(column, F.coalesce(*[F.try_to_timestamp(F.col(column).cast("string"), F.lit(f)) for f in formats]).cast("timestamp_ntz"))


def drop_future(df: DataFrame, as_of: Column, ts: str = "ts", grace_minutes: int = 0) -> DataFrame:
    """Rows with a time, up to ``as_of`` and a grace; the cutoff is an argument so that results don't depend on the clock."""
    return df.where(F.col(ts).isNotNull() & (F.col(ts) <= as_of + F.make_dt_interval(mins=F.lit(grace_minutes))))


def future_report(df: DataFrame, as_of: Column, ts: str = "ts", grace_minutes: int = 0) -> DataFrame:
    late = F.col(ts) > as_of + F.make_dt_interval(mins=F.lit(grace_minutes))
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(ts).isNull()).alias("n_no_time"), F.count_if(late).alias("n_future"))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the one with the greatest ``order``."""
    rows = W.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(rows)).where("_n = 1").drop("_n")


def train_statistics(df: DataFrame, columns: list[str], by: str = "equip_id") -> DataFrame:
    """Median, mean and deviation of every column on the training rows, a row for each key."""
    aggs = [f(F.col(x)).alias(f"{x}_{n}") for x in columns for n, f in (("med", lambda v: F.percentile(v, 0.5)), ("mean", F.avg), ("std", F.stddev_samp))]
    return df.where("split = 'train'").groupBy(by).agg(*aggs)


def fill(df: DataFrame, columns: list[str], method: str, values: DataFrame | None = None, by: str = "equip_id", ts: str = "ts") -> DataFrame:
    """Nulls by median (of ``values`` or of the frame), the value before, the value after, or not at all."""
    if method == "none":
        return df
    if method == "median":
        found = values.select(by, *[F.col(f"{x}_med").alias(f"_{x}") for x in columns]) if values is not None else df.groupBy(by).agg(*[F.percentile(F.col(x), 0.5).alias(f"_{x}") for x in columns])
        met = df.join(found, by, "left")
        return met.withColumns({x: F.coalesce(F.col(x), F.col(f"_{x}")) for x in columns}).drop(*[f"_{x}" for x in columns])
    if method in ("ffill", "bfill"):
        # what comes after is what came before in the other order, in a frame that only grows
        passed = W.partitionBy(by).orderBy(ts if method == "ffill" else F.desc(ts)).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({x: F.last(x, True).over(passed) for x in columns})
    if method == "interpolate":
        return interpolate(df, columns, by, ts)
    raise ValueError(method)


def interpolate(df: DataFrame, columns: list[str], by: str = "equip_id", ts: str = "ts", limit: int | None = None) -> DataFrame:
    """Linear between the neighbours by position, held at both ends; at most ``limit`` rows from a known one."""
    df = df.withColumn("_i", F.row_number().over(W.partitionBy(by).orderBy(ts)))
    before, after = (W.partitionBy(by).orderBy(x).rowsBetween(W.unboundedPreceding, 0) for x in ("_i", F.desc("_i")))
    out = {}
    for x in columns:
        known = F.when(F.col(x).isNotNull(), F.struct("_i", F.col(x).alias("v")))
        a, b = F.last(known, True).over(before), F.last(known, True).over(after)
        between = a["v"] + (b["v"] - a["v"]) * (F.col("_i") - a["_i"]) / (b["_i"] - a["_i"])
        value = F.coalesce(F.col(x), between, a["v"], b["v"])
        if limit is not None:
            near = F.least(F.coalesce(F.col("_i") - a["_i"], F.lit(1 << 30)), F.coalesce(b["_i"] - F.col("_i"), F.lit(1 << 30))) <= limit
            value = F.when(F.col(x).isNotNull() | near, value)
        out[x] = value
    return df.withColumns(out).drop("_i")


def impute_finite(df: DataFrame, columns: list[str], how: str = "median", by: str = "equip_id") -> DataFrame:
    """NaN, infinities and nulls by the column's median or mean over the key."""
    clean = df.withColumns({x: finite(x) for x in columns})
    of = (lambda x: F.percentile(F.col(x), 0.5)) if how == "median" else F.avg
    found = clean.groupBy(by).agg(*[of(x).alias(f"_{x}") for x in columns])
    return clean.join(found, by, "left").withColumns({x: F.coalesce(F.col(x), F.col(f"_{x}")) for x in columns}).drop(*[f"_{x}" for x in columns])


def time_grid(bounds: DataFrame, step_seconds: int, start: str = "t0", end: str = "t1") -> DataFrame:
    """Every step from start to end of each row, both included."""
    return bounds.withColumn("ts", F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"INTERVAL {step_seconds} SECONDS")))).drop(start, end)


def resample(df: DataFrame, columns: list[str], step_seconds: int, max_gap_seconds: int = 300, max_fill_ratio: float | None = None, by: str = "equip_id") -> DataFrame:
    """A regular grid holding what lies exactly on it, interpolated up to the greatest gap; too many fills are an error when a ratio is given."""
    bounds = df.groupBy(by).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    met = time_grid(bounds, step_seconds).join(df.select(by, "ts", *columns), [by, "ts"], "left")
    out = interpolate(met, columns, by, limit=max(1, max_gap_seconds // step_seconds))
    if max_fill_ratio is None:
        return out
    share = met.groupBy(by).agg(*[F.avg(F.col(x).isNull().cast("int")).alias(f"_{x}") for x in columns]).select(by, F.greatest(*[F.col(f"_{x}") for x in columns], F.lit(0.0)).alias("_share"))
    checked = F.when(F.col("_share") > max_fill_ratio, F.raise_error(F.lit("too many values would be filled"))).otherwise(F.lit(True))
    return out.join(share, by).where(checked).drop("_share")


def gaps(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    order = W.partitionBy(*keys).orderBy(ts)
    return df.withColumn("gap_s", seconds_between(F.lag(ts).over(order), F.col(ts)))


def cadence(df: DataFrame, keys: list[str], expected: float | None = None, jitter: float = 0.05) -> DataFrame:
    """Median step, most common step and whether nine tenths of the steps are as expected (the median by default)."""
    steps = gaps(df, keys).where("gap_s is not null")
    mid = steps.groupBy(*keys).agg(F.percentile("gap_s", 0.5).alias("cadence_s"))
    met = steps.join(mid, keys).withColumn("want", F.lit(expected).cast("double") if expected else F.col("cadence_s"))
    near = F.abs(F.col("gap_s") - F.col("want")) <= jitter * F.col("want")
    return met.groupBy(*keys).agg(F.first("cadence_s").alias("cadence_s"), (F.avg(near.cast("int")) >= 0.9).alias("regular"), F.avg(near.cast("int")).alias("share_regular"))


def common_step(df: DataFrame, keys: list[str], first: int = 100) -> DataFrame:
    """The most common positive step, in whole seconds, of the first rows; the smaller of equals."""
    order = W.partitionBy(*keys).orderBy("ts")
    head = gaps(df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first), keys).where("gap_s > 0")
    counted = head.groupBy(*keys, F.round("gap_s").cast("long").alias("step_s")).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.max_by("step_s", F.struct("n", -F.col("step_s"))).alias("step_s"))


def runs_of(df: DataFrame, flag: Column, keys: list[str], ts: str = "ts") -> DataFrame:
    """Islands: rows where the flag holds, with the number of the run they belong to."""
    order = W.partitionBy(*keys).orderBy(ts)
    df = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    return df.withColumn("run", F.sum((~F.col("_f")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where("_f").drop("_f")


def quality_report(long: DataFrame) -> DataFrame:
    """By equipment and tag: rows, nulls, deviation, longest run of nulls and of equal values, time range, verdict."""
    keys = ["equip_id", "tag"]
    order = W.partitionBy(*keys).orderBy("ts")
    marked = long.withColumn("flat", F.col("value") == F.lag("value").over(order))
    base = marked.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"), F.stddev_samp("value").alias("std"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")
    )
    longest = lambda flag, name, extra: runs_of(marked, flag, keys).groupBy(*keys, "run").agg(F.count("*").alias("n")).groupBy(*keys).agg((F.max("n") + extra).alias(name))
    out = base.join(longest(F.col("value").isNull(), "longest_null_run", 0), keys, "left").join(longest(F.col("flat"), "longest_flat_run", 1), keys, "left")
    pct = F.col("n_null") * 100.0 / F.col("n_rows")
    verdict = F.when(pct >= 80, "FAIL").when(pct >= 10, "WARN").otherwise("OK")
    return out.select(*keys, "n_rows", "n_null", pct.alias("null_pct"), "std", F.coalesce("longest_null_run", F.lit(0)).alias("longest_null_run"), F.coalesce("longest_flat_run", F.lit(1)).alias("longest_flat_run"), "min_ts", "max_ts", verdict.alias("verdict"))


def low_variance(df: DataFrame, columns: list[str], least: float = 1e-6) -> list[str]:
    """Columns whose deviation is below the least; one aggregation, one row to the driver."""
    row = df.agg(*[F.stddev_samp(x).alias(x) for x in columns]).first()
    return [x for x in columns if row[x] is None or row[x] < least]


def scale_clip(df: DataFrame, columns: list[str], clip_pct: float = 99.9, by: str = "equip_id") -> DataFrame:
    """Clipped to the outer percentiles, then (x - median) / (IQR / 1.349); a zero spread scales by 1."""
    low = 1 - clip_pct / 100
    found = df.groupBy(by).agg(*[F.percentile(F.col(x), F.array(F.lit(low), F.lit(1 - low), F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_{x}") for x in columns])
    met = df.join(found, by, "left")
    q = lambda x, i: F.col(f"_{x}")[i]
    spread = lambda x: F.when(q(x, 4) > q(x, 2), (q(x, 4) - q(x, 2)) / 1.349).otherwise(F.lit(1.0))
    return met.withColumns({x: (F.greatest(q(x, 0), F.least(q(x, 1), F.col(x))) - q(x, 3)) / spread(x) for x in columns}).drop(*[f"_{x}" for x in columns])


def context_z(long: DataFrame) -> DataFrame:
    """(value - train mean) / train deviation for the score rows; tags without spread are left out."""
    stats = long.where("split = 'train'").groupBy("equip_id", "tag").agg(F.avg("value").alias("train_mean"), F.stddev_samp("value").alias("train_std")).where("train_std > 0")
    return long.where("split = 'score'").join(stats, ["equip_id", "tag"]).withColumn("z", (F.col("value") - F.col("train_mean")) / F.col("train_std"))


def for_sink(df: DataFrame, limit: float = 1e100) -> DataFrame:
    """Doubles that no table takes (NaN, infinities, beyond the limit) as null, booleans as 0/1, empty marks as null."""
    out = {}
    for f in df.schema:
        x = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.when(F.abs(finite(x)) <= limit, finite(x))
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = x.cast("int")
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = F.when(~F.trim(x).isin("", "N/A", "NA", "nan", "NaN", "None", "null"), x)
    return df.withColumns(out)


def downcast(df: DataFrame) -> DataFrame:
    """Doubles as floats and longs as ints where a column is meant for display; longs beyond an int become null."""
    return df.withColumns({f.name: F.col(f.name).cast("float") if isinstance(f.dataType, T.DoubleType) else F.col(f.name).try_cast("int") for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.LongType))})


def every_nth(df: DataFrame, target: int, by: str = "equip_id", ts: str = "ts") -> DataFrame:
    """Every ⌊n / target⌋-th row of each key, the first included."""
    n = F.count("*").over(W.partitionBy(by))
    step = F.greatest(F.lit(1), F.floor(n / target)).cast("int")
    rows = df.withColumn("_i", F.row_number().over(W.partitionBy(by).orderBy(ts)) - 1).withColumn("_s", step)
    return rows.where("_i % _s = 0").drop("_i", "_s")
