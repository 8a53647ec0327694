"""Reading sensor files and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantwatch.operators.cleaning import drop_future, numeric_columns, parse_ts, resample
from plantwatch.operators.history import safe_names, split_ratio

# Names that mark a time column, in order.
TIME_NAMES = ("timestamp", "time", "datetime", "date", "entrydatetime", "ts")


def time_column(df: DataFrame, hint: str | None = None) -> str:
    """The hinted column, else a well-known name, else the first text column whose first ten values read as times."""
    names = {c.lower(): c for c in df.columns}
    for n in ([hint.lower()] if hint else []) + list(TIME_NAMES):
        if n in names:
            return names[n]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    head = df.select(*[f"`{t}`" for t in texts]).limit(10)
    ok = head.agg(*[(F.count_if(F.try_to_timestamp(F.col(f"`{t}`")).isNotNull()) == F.count("*")).alias(str(i)) for i, t in enumerate(texts)]).first() if texts else ()
    for t, good in zip(texts, ok, strict=False):
        if good:
            return t
    raise ValueError("no time column found")


def read_csv(spark: SparkSession, path: str, ts: str | None = None, equip_id: int = 0) -> DataFrame:
    """A sensor file: ``ts``, then sensors under safe names, all doubles. An empty file is an error."""
    raw = spark.read.option("header", True).csv(path)
    if not raw.columns or raw.isEmpty():
        raise ValueError(f"{path} is empty")
    at = time_column(raw, ts)
    sensors = [c for c in raw.columns if c != at]
    names = safe_names(sensors)
    got = raw.select(F.lit(equip_id).cast("int").alias("equip_id"), F.col(f"`{at}`").alias("ts"), *[F.col(f"`{c}`").try_cast("double").alias(names[c]) for c in sensors])
    return parse_ts(got, "ts").where("ts is not null")


def load(train: DataFrame, score: DataFrame | None = None, ratio: float = 0.6, least: int = 10, as_of: Column | None = None, step_seconds: int | None = None) -> DataFrame:
    """Both parts with their common numeric columns and a ``split``; with one frame alone it is cut by ratio.

    Rows after ``as_of`` are dropped; with a step the result is put on a regular grid.
    """
    if score is None:
        cols = sorted(numeric_columns(train))
        got = split_ratio(train.select("equip_id", "ts", *cols))
    else:
        cols = sorted(set(numeric_columns(train)) & set(numeric_columns(score)))
        part = lambda df, name: df.select("equip_id", "ts", *cols, F.lit(name).alias("split"))
        got = part(train, "train").unionByName(part(score, "score"))
    if not cols:
        raise ValueError("no common numeric columns")
    if as_of is not None:
        got = drop_future(got, as_of)
    if got.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows")
    if step_seconds:
        parts = [resample(got.where(F.col("split") == s), cols, step_seconds).withColumn("split", F.lit(s)) for s in ("train", "score")]
        got = parts[0].unionByName(parts[1])
    return got


def load_meta(df: DataFrame) -> DataFrame:
    return df.groupBy("equip_id", "split").agg(F.count("*").alias("n_rows"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))


def table_ranges(tables: dict[str, DataFrame], ts: str = "ts") -> DataFrame:
    """Rows, first and last time of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
        out = one if out is None else out.unionByName(one)
    return out


def tick_minutes(history: DataFrame, rows_per_batch: int = 5000) -> DataFrame:
    """Minutes of a batch that holds about so many rows, within [1, 1440]."""
    got = history.groupBy("equip_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("n"))
    minutes = F.timestamp_diff("SECOND", F.col("t0"), F.col("t1")) / 60.0
    return got.withColumn("tick_minutes", F.greatest(F.lit(1), F.least(F.lit(1440), F.ceil(minutes * rows_per_batch / F.col("n")))).cast("long"))
