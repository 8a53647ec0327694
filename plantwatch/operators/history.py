"""Historian queries over the long history (equip_id, tag, ts, seq, quality, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plantwatch.functions.scalar import seconds, seconds_between
from plantwatch.operators.islands import grid_last, micros

KEYS = ["equip_id", "tag"]
#: Grid cells that one row is dealt out to at a time.
CELLS = 10_000
# Seconds of each named frequency.
FREQUENCIES = {"Millisecond": 0.001, "Second": 1, "Minute": 60, "Hour": 3600, "Day": 86_400, "Week": 604_800, "Cyclic": 1}


def span(history: DataFrame, start: str, end: str, tags: list[str] | None = None) -> DataFrame:
    """Samples from start to end, both included; an unknown tag is an error that names it."""
    got = history.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return got.where(F.col("tag").isin(tags)) if tags else got


def unknown_tags(asked: DataFrame, known: DataFrame) -> DataFrame:
    return asked.join(known, "tag", "left_anti")


def widen(history: DataFrame, tags: list[str], how: str = "max") -> DataFrame:
    """One column for each tag, of the given order; names are made safe for SQL."""
    of = {"max": F.max, "avg": F.avg, "first": F.first}[how]
    return history.groupBy("equip_id", "ts").pivot("tag", tags).agg(of("value"))


def cyclic(history: DataFrame, start: str, end: str, step: float, tags: list[str]) -> DataFrame:
    """A regular grid for every tag: the last sample in (previous point, point], carried forward within the tag.

    The range becomes a cell number, so the join is one of equality. Cells are dealt out in two steps, so that a long
    grid is neither one array nor broadcast. Steps may be fractions of a second.
    """
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    inside = history.where((F.col("ts") >= a) & (F.col("ts") <= b)).where(F.col("tag").isin(tags))
    last = grid_last(inside, a, step).groupBy(*KEYS, "cell").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
    cells = F.floor((micros(b) - micros(a)) / F.lit(round(step * 1e6))).cast("long")
    blocks = inside.select(*KEYS).distinct().select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(cells / CELLS).cast("long"))).alias("block"))
    first = F.col("block") * CELLS
    grid = blocks.select(*KEYS, F.explode(F.sequence(first, F.least(cells, first + (CELLS - 1)))).alias("cell"))
    met = grid.join(last, [*KEYS, "cell"], "left")
    w = W.partitionBy(*KEYS).orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    ts = a + F.make_dt_interval(secs=(F.col("cell") * F.lit(step).cast("decimal(18,6)")).cast("decimal(18,6)"))
    return met.select(*KEYS, ts.alias("ts"), F.last("value", True).over(w).alias("value"))


def between_samples(history: DataFrame, step: int, mode: str = "linear") -> DataFrame:
    """Grid points of whole steps in [sample, next sample), held flat or interpolated; no range join."""
    w = W.partitionBy(*KEYS).orderBy("ts", "seq")
    got = history.withColumns({"next_ts": F.lead("ts").over(w), "next_value": F.lead("value").over(w)})
    t, n = seconds("ts"), seconds("next_ts")
    first = (F.ceil(t / step) * step).cast("long")
    last = (F.ceil(n / step) * step - step).cast("long")
    got = got.withColumns({"_t": t, "_n": n, "_a": first, "_b": last}).where("next_ts is not null and _b >= _a")
    rows = got.withColumn("_g", F.explode(F.sequence("_a", "_b", F.lit(step).cast("long"))))
    share = (F.col("_g") - F.col("_t")) / (F.col("_n") - F.col("_t"))
    value = F.col("value") + share * (F.col("next_value") - F.col("value")) if mode == "linear" else F.col("value")
    return rows.select(*KEYS, F.timestamp_seconds("_g").cast("timestamp_ntz").alias("ts"), value.alias("value"))


def dead_band(history: DataFrame, pct: float) -> DataFrame:
    """The first sample of each tag, and each that differs from the last one kept by the percentage; nulls are kept.

    The comparison goes to the last kept sample, a fold in order of time, so it
    runs by tag, and a task holds one tag's time and value whole.
    """

    def run(key, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values(["ts", "seq"])
            keep, current = [], None
            for v in frame["value"]:
                if v is None or v != v or current is None:
                    keep.append(True)
                    current = v if v is not None and v == v else current
                    continue
                changed = 100.0 * abs((current - v) / (current or 1.0)) >= pct
                keep.append(changed)
                current = v if changed else current
            yield frame[keep]

    whole = history.select("equip_id", "tag", "ts", "seq", "value")
    return whole.groupBy(*KEYS).applyInPandas(lambda frame: next(run(None, iter([frame]))), whole.schema)


def tag_counts(history: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """Rows by tag, each tag under its own condition."""
    ok = F.lit(True)
    for tag, cond in (conditions or {}).items():
        ok = ok & (F.when(F.col("tag") == tag, cond).otherwise(F.lit(True)))
    return history.where(ok).groupBy(*KEYS).agg(F.count("value").alias("n"))


def last_values(history: DataFrame) -> DataFrame:
    """The latest samples of each tag, ties kept; a maximum and a join, so no tag is sorted whole."""
    top = history.groupBy(*KEYS).agg(F.max("ts").alias("ts"))
    return history.join(top, [*KEYS, "ts"])


def as_text(parts: list[DataFrame]) -> DataFrame:
    """Typed partitions as one, values as text."""
    cast = [p.withColumn("value", F.col("value").cast("string")) for p in parts]
    out = cast[0]
    for p in cast[1:]:
        out = out.unionByName(p)
    return out


def rename_signals(wide: DataFrame, names: dict[str, str]) -> DataFrame:
    return wide.withColumnsRenamed(names)


def safe_names(names: list[str]) -> dict[str, str]:
    """Sensor names as column names: letters, digits and underscores, made unique."""
    out: dict[str, str] = {}
    for n in names:
        base = "".join(x if x.isascii() and x.isalnum() else "_" for x in n).strip("_").lower() or "sensor"
        name, k = base, 2
        while name in out.values():
            name, k = f"{base}_{k}", k + 1
        out[n] = name
    return out


def tail_buffer(rows: DataFrame, hours: float, most: int, keys: list[str] | None = None, order: str = "seq") -> DataFrame:
    """A baseline buffer: the newest row for each time, the last hours, and at most so many rows of each key."""
    keys = keys or ["equip_id"]
    unique = W.partitionBy(*keys, "ts").orderBy(F.desc(order))
    kept = rows.withColumn("_n", F.row_number().over(unique)).where("_n = 1").drop("_n")
    newest = kept.groupBy(*keys).agg(F.max("ts").alias("_t1"))
    recent = kept.join(newest, keys).where(seconds_between("ts", "_t1") <= hours * 3600).drop("_t1")
    return recent.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("ts")))).where(F.col("_n") <= most).drop("_n")


def split_ratio(rows: DataFrame, ratio: float = 0.6) -> DataFrame:
    """The first ⌊ratio · n⌋ rows of each piece of equipment train, the rest are scored."""
    n = F.count("*").over(W.partitionBy("equip_id"))
    i = F.row_number().over(W.partitionBy("equip_id").orderBy("ts"))
    return rows.withColumn("split", F.when(i <= F.floor(n * ratio), "train").otherwise("score"))
