"""Runs, equipment, configuration and cold starts as tables."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plantwatch.functions.scalar import parse_value

# Rows and tries of a cold start.
COLD_ROWS, COLD_TRIES = 500, 3


def next_window(equipment: DataFrame, runs: DataFrame, history: DataFrame, tick_minutes: int, default_start: Column) -> DataFrame:
    """[start, end) of the next run: after the last finished one, or from the first sample, or from a default."""
    done = runs.where("outcome in ('OK', 'NOOP')").groupBy("equip_id").agg(F.max("window_end").alias("last_end"))
    first = history.groupBy("equip_id").agg(F.min("ts").alias("first_ts"))
    start = F.coalesce("last_end", "first_ts", default_start)
    met = equipment.select("equip_id").join(done, "equip_id", "left").join(first, "equip_id", "left")
    return met.select("equip_id", start.alias("window_start"), (start + F.make_dt_interval(mins=F.lit(tick_minutes))).alias("window_end"))


def finalise(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Outcome and counts put into runs; what the update lacks stays."""
    new = updates.select("run_id", *[F.col(c).alias(f"_{c}") for c in updates.columns if c != "run_id"])
    met = runs.join(new, "run_id", "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in met.columns else F.col(c) for c in runs.columns])


def register(equipment: DataFrame, new: DataFrame, key: str = "code") -> DataFrame:
    """Known codes are updated where the new value isn't null; unknown ones are added with the next ids."""
    news = new.select(key, *[F.col(c).alias(f"_{c}") for c in new.columns if c != key])
    met = equipment.join(news, key, "left")
    kept = met.select(*[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in met.columns else F.col(c) for c in equipment.columns])
    top = equipment.agg(F.coalesce(F.max("equip_id"), F.lit(0)).alias("_top"))
    # ids are given in order over what is new: a few rows of master data
    fresh = new.join(equipment, key, "left_anti").withColumn("_n", F.row_number().over(W.orderBy(key))).crossJoin(F.broadcast(top))
    return kept.unionByName(fresh.withColumn("equip_id", (F.col("_top") + F.col("_n")).cast("int")).drop("_n", "_top"), allowMissingColumns=True)


def effective_config(config: DataFrame, equip_id: int) -> DataFrame:
    """An equipment's own rows before the defaults (equipment 0), path by path."""
    rows = config.where(F.col("equip_id").isin(0, equip_id))
    w = W.partitionBy("param_path").orderBy(F.when(F.col("equip_id") == 0, 1).otherwise(0))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def typed_config(config: DataFrame) -> DataFrame:
    return config.withColumn("typed", parse_value("param_value", "value_type"))


def nested(rows: list[tuple[str, str, str]]) -> dict[str, Any]:
    """(path, value, type) rows as a nested dictionary; a path that runs into a value replaces it."""
    out: dict[str, Any] = {}
    for path, value, kind in rows:
        at = out
        *head, last = path.split(".")
        for p in head:
            at = at.setdefault(p, {}) if isinstance(at.get(p, {}), dict) else at.__setitem__(p, {}) or at[p]
        at[last] = typed(value, kind)
    return out


def typed(value: str | None, kind: str) -> Any:
    kind = (kind or "string").lower()
    if value is None:
        return None
    try:
        if kind == "int":
            return int(float(value))
        if kind == "float":
            return float(value)
        if kind in ("list", "dict", "json"):
            return json.loads(value)
    except ValueError:
        return value
    return value.strip().lower() in ("true", "1", "yes", "on") if kind == "bool" else value


def signature(config: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def data_signature(df: DataFrame) -> DataFrame:
    """One number for the content of a frame, whatever the order of its rows."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("content"))


def update_config(config: DataFrame, changes: DataFrame) -> DataFrame:
    """Append-only: a change is a row with a higher version, and the latest version counts."""
    top = config.agg(F.coalesce(F.max("version"), F.lit(0)).alias("_top"))
    return config.unionByName(changes.crossJoin(F.broadcast(top)).withColumn("version", F.col("_top") + 1).drop("_top"))


def parse_changes(actions: DataFrame) -> DataFrame:
    """Lines ``path: old->new`` as columns; others are dropped."""
    at = lambda i: F.regexp_extract("action", r"^\s*([\w.]+)\s*:\s*(\S+)\s*->\s*(\S+)\s*$", i)
    return actions.select("equip_id", at(1).alias("param_path"), at(2).alias("old_value"), at(3).alias("new_value")).where("param_path <> ''")


def coldstart(state: DataFrame, got: DataFrame, required: int = COLD_ROWS, tries: int = COLD_TRIES) -> DataFrame:
    """Rows gathered so far and a status: PENDING, IN_PROGRESS, COMPLETE, or FAILED after the last try."""
    met = state.join(got.groupBy("equip_id").agg(F.count("*").alias("new_rows")), "equip_id", "full").fillna(0, ["new_rows", "rows", "attempts"])
    rows, attempts = F.col("rows") + F.col("new_rows"), F.col("attempts") + 1
    status = F.when(rows >= required, "COMPLETE").when(attempts >= tries, "FAILED").when(rows > 0, "IN_PROGRESS").otherwise("PENDING")
    return met.select("equip_id", rows.cast("long").alias("rows"), attempts.cast("long").alias("attempts"), status.alias("status"))


def cold_window(history: DataFrame, required: int = COLD_ROWS, margin: float = 1.2) -> DataFrame:
    """A window from the first sample that should hold the rows required, by the median step."""
    d = history.withColumn("d", F.timestamp_diff("MICROSECOND", F.lag("ts").over(W.partitionBy("equip_id").orderBy("ts")), F.col("ts")) / 1e6)
    got = d.groupBy("equip_id").agg(F.min("ts").alias("window_start"), F.percentile("d", 0.5).alias("step_s"))
    return got.withColumn("minutes", F.ceil(F.col("step_s") * required * margin / 60).cast("long")).withColumn("window_end", F.col("window_start") + F.make_dt_interval(mins=F.col("minutes").cast("int")))


def register_views(tables: dict[str, DataFrame], equipment: DataFrame) -> list[str]:
    """A view of each table with the equipment's columns; the master data is small and broadcast by the optimizer."""
    names = []
    for name, df in tables.items():
        df.join(equipment, "equip_id").createOrReplaceTempView(f"v_{name}")
        names.append(f"v_{name}")
    return names


def latest_run(runs: DataFrame) -> DataFrame:
    """The latest run of each piece of equipment by time; ids say nothing about order."""
    return runs.groupBy("equip_id").agg(F.max_by("run_id", "started_at").alias("run_id"), F.max("started_at").alias("started_at"))


# runs' own rows


def run_stats(scores: DataFrame, episodes: DataFrame) -> DataFrame:
    """A row for each piece of equipment: rows, first and last time, mean and greatest fused score, episodes and their length."""
    s = scores.groupBy("equip_id").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("fused").alias("mean_fused"), F.max("fused").alias("max_fused"))
    e = episodes.groupBy("equip_id").agg(F.count("*").alias("n_episodes"), F.sum("duration_s").alias("episode_s"))
    return s.join(e, "equip_id", "left").fillna(0, ["n_episodes"]).fillna(0.0, ["episode_s"])


def run_metadata(split: DataFrame, stats: DataFrame, config_signature: str) -> DataFrame:
    """The summary row of a run: training and scored rows, what was found, and the signature of its settings."""
    n = split.groupBy("equip_id").agg(F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "score").alias("score_rows"))
    health = F.when(F.col("mean_fused") >= 3, "CRITICAL").when(F.col("n_episodes") > 0, "WARNING").otherwise("HEALTHY")
    return n.join(stats, "equip_id").select("equip_id", "train_rows", "score_rows", "n_episodes", health.alias("health_status"), F.lit(config_signature).alias("config_signature"))


def unfinished(windows: DataFrame, progress: DataFrame) -> DataFrame:
    """Windows that begin at or after the end of what an asset has finished; all of them where nothing is known."""
    return windows.join(progress, "equip_id", "left").where(F.col("last_end").isNull() | (F.col("window_start") >= F.col("last_end"))).drop("last_end")


def chunk_plan(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Each asset's chunks in order of their names; the first one bootstraps, and what is done is left out."""
    w = W.partitionBy("equip_id").orderBy("chunk")
    planned = chunks.withColumn("n", F.row_number().over(w).cast("long")).withColumn("step", F.when(F.col("n") == 1, "bootstrap").otherwise("replay"))
    return planned.join(done.select("equip_id", "chunk"), ["equip_id", "chunk"], "left_anti")


def accumulate(history: DataFrame, minutes: int, required: int = COLD_ROWS, tries: int = COLD_TRIES) -> DataFrame:
    """Cold start: windows from the first sample that double until one holds the rows required; the last try counts otherwise.

    All windows are counted in one aggregation, as there are only a few.
    """
    first = history.groupBy("equip_id").agg(F.min("ts").alias("t0"))
    within = lambda k: F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("ts")) < F.lit(minutes * 2**k * 60_000_000)
    sums = history.join(first, "equip_id").groupBy("equip_id", "t0").agg(*[F.count_if(within(k)).alias(f"n{k}") for k in range(tries)])
    attempt = F.coalesce(*[F.when(F.col(f"n{k}") >= required, k) for k in range(tries)], F.lit(tries - 1))
    got = sums.withColumn("k", attempt).withColumn("n_rows", F.get(F.array(*[F.col(f"n{k}") for k in range(tries)]), F.col("k")))
    status = F.when(F.col("n_rows") >= required, "COMPLETE").otherwise("FAILED")
    return got.select("equip_id", (F.col("k") + 1).cast("long").alias("attempts"), "n_rows", F.col("t0").alias("window_start"), (F.col("t0") + F.make_dt_interval(mins=(F.lit(minutes) * F.pow(F.lit(2.0), F.col("k"))).cast("int"))).alias("window_end"), status.alias("status"))


class Config:
    """Settings by dotted path; those who asked are told of each change."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.values = nested(rows)
        self.told: list[Callable[[str, Any, Any], None]] = []

    def on_update(self, callback: Callable[[str, Any, Any], None]) -> None:
        self.told.append(callback)

    def get(self, path: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def update(self, path: str, value: Any) -> None:
        *head, last = path.split(".")
        old, at = self.get(path), self.values
        for part in head:
            if not isinstance(at.get(part), dict):
                at[part] = {}
            at = at[part]
        at[last] = value
        for callback in self.told:
            callback(path, old, value)


class Timer:
    """Seconds spent by name; ``wrap`` makes a function's calls count."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    def wrap(self, name: str) -> Callable[[Callable], Callable]:
        def around(f: Callable) -> Callable:
            @wraps(f)
            def timed(*args: Any, **named: Any) -> Any:
                start = time.monotonic()
                try:
                    return f(*args, **named)
                finally:
                    self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - start
                    logging.getLogger("plantwatch").info("%s took %.3f s", name, self.seconds[name])

            return timed

        return around


# master data


def equipment_types(equipment: DataFrame) -> DataFrame:
    """(type, instances), by type."""
    return equipment.groupBy("type").agg(F.count("*").alias("instances"))


def equipment_of(equipment: DataFrame, kind: str | None = None, active: bool = True) -> DataFrame:
    """The instances of a type, or all."""
    found = equipment.where(F.col("type") == kind) if kind is not None else equipment
    return found.where("is_active") if active and "is_active" in equipment.columns else found


def tag_mappings(equipment: DataFrame, tags: DataFrame) -> DataFrame:
    """Equipment with its active tags; equipment without any has a row with a null tag."""
    return equipment.join(tags.where("is_active") if "is_active" in tags.columns else tags, "equip_id", "left")


def sync_equipment(equipment: DataFrame, seen: DataFrame) -> DataFrame:
    """Master data after a look at the source: new codes are registered, those no longer seen go inactive."""
    there = seen.select("code").distinct().withColumn("_seen", F.lit(True))
    known = register(equipment.drop("is_active"), seen)
    return known.join(there, "code", "left").select(*known.columns, F.coalesce("_seen", F.lit(False)).alias("is_active"))
