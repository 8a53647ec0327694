"""Derived tables over a score frame.

The wide frame ``scores`` has equip_id, ts, fused and a ``<detector>_z`` column
for each detector; ``long`` has equip_id, ts, detector, z. Builders make no
action, and no window goes over more than one piece of equipment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plantwatch.functions.scalar import SEVERITIES, Z_WARN, correlation, health, seconds_between, severity_of_share, status, trunc, zone
from plantwatch.operators.islands import inside, islands

E = "equip_id"
ZONES = ("GOOD", "WATCH", "ALERT")


def detectors(scores: DataFrame) -> list[str]:
    return [x for x in scores.columns if x.endswith("_z") and x != "fused_z"]


def melt(scores: DataFrame, columns: list[str] | None = None, strip: bool = True) -> DataFrame:
    """(equip_id, ts, detector, z), null scores dropped."""
    long = scores.unpivot([E, "ts"], columns or detectors(scores), "detector", "z").where("z is not null")
    return long.withColumn("detector", F.regexp_replace("detector", "_z$", "")) if strip else long


def health_timeline(scores: DataFrame) -> DataFrame:
    h = health("fused")
    return scores.select(E, "ts", F.bround(h, 2).alias("health_index"), zone(h).alias("health_zone"), F.bround("fused", 4).alias("fused_z"))


def regime_timeline(scores: DataFrame) -> DataFrame:
    return scores.select(E, "ts", F.col("regime_label").cast("int").alias("regime_label"), F.coalesce("regime_state", F.lit("unknown")).alias("regime_state"))


def drift_series(drift: DataFrame, column: str = "cusum_z") -> DataFrame:
    return drift.select(E, "ts", F.bround(column, 4).alias("drift_value"))


def latest(scores: DataFrame) -> DataFrame:
    """The last row of each piece of equipment, without a window over all rows."""
    rest = [x for x in scores.columns if x not in (E, "ts")]
    return scores.groupBy(E).agg(F.max_by(F.struct(*rest), "ts").alias("x"), F.max("ts").alias("ts")).select(E, "ts", "x.*")


def contributions_now(scores: DataFrame) -> DataFrame:
    """Shares of the latest scores with their ranks; equal shares if all are zero."""
    now = melt(latest(scores)).withColumn("z", F.abs("z"))
    each = W.partitionBy(E)
    total, n = F.sum("z").over(each), F.count("*").over(each)
    ranked = F.row_number().over(each.orderBy(F.desc("z"), "detector"))
    pct = F.when(total > 0, F.col("z") / total * 100).otherwise(F.lit(100.0) / n)
    return now.select(E, "detector", ranked.cast("long").alias("rank_position"), pct.alias("contribution_pct"), "z")


def contribution_timeline(scores: DataFrame, sampled: DataFrame | None = None) -> DataFrame:
    long = melt(sampled if sampled is not None else scores).withColumn("z", F.abs("z"))
    total = F.sum("z").over(W.partitionBy(E, "ts"))
    return long.withColumn("total", total).where("total > 0").select(E, "ts", "detector", (F.col("z") / F.col("total") * 100).alias("contribution_pct"))


def defect_summary(scores: DataFrame, episodes: DataFrame | None = None) -> DataFrame:
    h = health("fused")
    names = detectors(scores)
    last = F.max_by(F.struct(h.alias("h"), *names), "ts")
    counts = [F.count_if(zone(h) == z).alias(f"{z.lower()}_count") for z in ZONES]
    out = scores.groupBy(E).agg(last.alias("x"), F.avg(h).alias("avg_health"), F.min(h).alias("min_health"), *counts)
    # of equal scores the first column counts
    worst = F.array_max(F.array(*[F.struct(F.abs(F.col(f"x.{x}")).alias("z"), F.lit(-i).alias("i"), F.lit(x.removesuffix("_z")).alias("name")) for i, x in enumerate(names)]))["name"]
    state, severity = status("x.h")
    out = out.select(E, state.alias("status"), severity.alias("severity"), F.col("x.h").alias("current_health"), "avg_health", "min_health", worst.alias("worst_sensor"), *[f"{z.lower()}_count" for z in ZONES])
    if episodes is None:
        return out.withColumn("episode_count", F.lit(0).cast("long"))
    return out.join(episodes.groupBy(E).agg(F.count("*").alias("episode_count")), E, "left").fillna(0, ["episode_count"])


def sensor_defects(scores: DataFrame) -> DataFrame:
    a = F.abs("z")
    got = melt(scores).groupBy(E, "detector").agg(F.count_if(a > Z_WARN).alias("violation_count"), F.count("*").alias("n"), F.max(a).alias("max_z"), F.avg(a).alias("avg_z"), F.max_by(a, "ts").alias("current_z"))
    pct = F.col("violation_count") * 100.0 / F.col("n")
    return got.select(E, "detector", F.substring_index("detector", "_", 1).alias("family"), severity_of_share(pct).alias("severity"), "violation_count", pct.alias("violation_pct"), "max_z", "avg_z", "current_z", (F.col("current_z") > Z_WARN).alias("active"))


def zones_by_day(scores: DataFrame) -> DataFrame:
    """A row for each day and zone, zones without points too."""
    day = scores.select(E, trunc("DAY", "ts").alias("period_start"), zone(health("fused")).alias("zone")).groupBy(E, "period_start").agg(F.count("zone").alias("total_points"), *[F.count_if(F.col("zone") == z).alias(z) for z in ZONES])
    long = day.unpivot([E, "period_start", "total_points"], list(ZONES), "health_zone", "zone_count")
    pct = F.when(F.col("total_points") > 0, F.col("zone_count") * 100.0 / F.col("total_points")).otherwise(0.0)
    return long.select(E, "period_start", "health_zone", pct.alias("zone_pct"), "zone_count", "total_points")


def anomalies_by_day(scores: DataFrame) -> DataFrame:
    a = F.abs("z")
    return melt(scores).groupBy(E, trunc("DAY", "ts").alias("period_start"), "detector").agg((F.avg((a > Z_WARN).cast("int")) * 100).alias("anomaly_rate_pct"), F.max(a).alias("max_z"), F.avg(a).alias("avg_z"), F.count("*").alias("points"))


def calibration_summary(scores: DataFrame, clip_z: float = 30.0) -> DataFrame:
    a = F.abs("z")
    q = F.percentile(a, F.array(F.lit(0.95), F.lit(0.99)))
    got = melt(scores).groupBy(E, "detector").agg(F.avg(a).alias("mean_z"), F.stddev_samp(a).alias("std_z"), q.alias("q"), (F.avg((a >= clip_z).cast("int")) * 100).alias("saturation_pct"))
    return got.select(E, "detector", "mean_z", "std_z", F.col("q")[0].alias("p95_z"), F.col("q")[1].alias("p99_z"), F.lit(clip_z).alias("clip_z"), "saturation_pct")


def detector_correlation(scores: DataFrame) -> DataFrame:
    """Upper triangle of Pearson correlations in one pass; 0 where a score doesn't vary."""
    names = detectors(scores)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    flat = lambda x: F.coalesce(F.stddev_samp(x), F.lit(0.0)) == 0
    row = scores.groupBy(E).agg(*[F.when(flat(a) | flat(b), 0.0).otherwise(correlation(a, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("detector_a"), F.lit(b).alias("detector_b"), F.coalesce(F.col(f"r{i}"), F.lit(0.0)).alias("pearson_r")) for i, (a, b) in enumerate(pairs)])
    return row.select(E, F.inline(items))


def fusion_quality(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Statistics of present detectors, full outer joined to (detector, weight)."""
    got = melt(scores).groupBy(E, "detector").agg(F.avg("z").alias("mean_z"), F.max("z").alias("max_z"), F.count("*").alias("points"))
    wanted = got.select(E).distinct().crossJoin(F.broadcast(weights))
    out = got.join(wanted, [E, "detector"], "full")
    return out.select(E, "detector", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.col("points").isNotNull().alias("present"), "mean_z", "max_z", F.coalesce("points", F.lit(0)).alias("points"))


def health_histogram(scores: DataFrame) -> DataFrame:
    """Ten bins of ten, the last one closed, empty ones too."""
    h = health("fused")
    b = F.least(F.width_bucket(h, F.lit(0.0), F.lit(100.0), F.lit(10)), F.lit(10))
    got = scores.groupBy(E, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    dense = scores.groupBy(E).agg(F.count("*").alias("total")).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(10))))
    met = dense.join(got, [E, "bin"], "left")
    n = F.coalesce("n", F.lit(0))
    label = F.concat((F.col("bin") * 10 - 10).cast("string"), F.lit("-"), (F.col("bin") * 10).cast("string"))
    return met.select(E, label.alias("health_bin"), n.alias("record_count"), (n * 100.0 / F.col("total")).alias("percentage"))


def weekly_profile(scores: DataFrame) -> DataFrame:
    q = F.percentile("fused", F.array(F.lit(0.9), F.lit(0.95)))
    got = scores.where("fused is not null").groupBy(E, F.weekday("ts").alias("day_of_week"), F.hour("ts").alias("hour")).agg(F.avg("fused").alias("fused_mean"), q.alias("q"), F.count("*").alias("n"))
    return got.select(E, "day_of_week", "hour", "fused_mean", F.col("q")[0].alias("fused_p90"), F.col("q")[1].alias("fused_p95"), "n")


def health_by_hour(scores: DataFrame, unit: str = "HOUR") -> DataFrame:
    q = lambda *p: F.array(*[F.lit(x) for x in p])
    got = scores.groupBy(E, trunc(unit, "ts").alias("bucket_start")).agg(F.percentile("fused", q(0.5, 0.75, 0.9, 0.95)).alias("f"), F.percentile(health("fused"), q(0.5, 0.1)).alias("h"), F.count("*").alias("n"))
    return got.select(E, "bucket_start", *[F.col("f")[i].alias(f"fused_p{p}") for i, p in enumerate((50, 75, 90, 95))], F.col("h")[0].alias("health_p50"), F.col("h")[1].alias("health_p10"), "n")


def date_hour_map(scores: DataFrame) -> DataFrame:
    return scores.groupBy(E, trunc("DAY", "ts").alias("day")).pivot("_hour", list(range(24))).agg(F.avg("fused")) if "_hour" in scores.columns else date_hour_map(scores.withColumn("_hour", F.hour("ts")))


def since_when(scores: DataFrame) -> DataFrame:
    hot = F.col("fused") > Z_WARN
    got = scores.groupBy(E).agg(F.min(F.when(hot, F.col("ts"))).alias("start_ts"), F.max("ts").alias("t1"), F.count_if(hot).alias("record_count"))
    return got.select(E, F.when(F.col("start_ts").isNull(), "GOOD").otherwise("ALERT").alias("alert_zone"), "start_ts", F.coalesce(seconds_between("start_ts", "t1") / 3600, F.lit(0.0)).alias("duration_hours"), "record_count")


def regime_occupancy(scores: DataFrame) -> DataFrame:
    got = scores.where("regime_label is not null").groupBy(E, "regime_label").agg(F.count("*").alias("record_count"))
    return got.withColumn("percentage", F.col("record_count") * 100.0 / F.sum("record_count").over(W.partitionBy(E)))


def regime_transitions(scores: DataFrame) -> DataFrame:
    """Counts of changes; the probability is the share of all changes."""
    order = W.partitionBy(E).orderBy("ts")
    moved = scores.select(E, F.lag("regime_label").over(order).alias("from_label"), F.col("regime_label").alias("to_label")).where("from_label <> to_label")
    got = moved.groupBy(E, "from_label", "to_label").agg(F.count("*").alias("n"))
    return got.withColumn("prob", F.col("n") / F.sum("n").over(W.partitionBy(E)))


def regime_dwell(scores: DataFrame) -> DataFrame:
    """A run lasts from its first to its last row, so a single row lasts nothing."""
    s = seconds_between("start_ts", "end_ts")
    return islands(scores, "regime_label").groupBy(E, "regime_label").agg(F.count("*").alias("runs"), F.avg(s).alias("mean_seconds"), F.percentile(s, 0.5).alias("median_seconds"), F.min(s).alias("min_seconds"), F.max(s).alias("max_seconds"))


def regime_stats(scores: DataFrame) -> DataFrame:
    """A run lasts until the next one starts, the last one to its last row."""
    dwell = islands(scores.where("regime_label is not null"), "regime_label").groupBy(E, "regime_label").agg(F.avg(seconds_between("start_ts", F.coalesce("next_ts", "end_ts"))).alias("avg_dwell_seconds"))
    got = scores.groupBy(E, "regime_label").agg(F.count("*").alias("n"), F.avg("fused").alias("fused_mean"), F.percentile("fused", 0.9).alias("fused_p90"))
    share = F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(E))
    return got.withColumn("occupancy_pct", share).drop("n").join(dwell, [E, "regime_label"])


def regime_stability(scores: DataFrame) -> DataFrame:
    """The first row counts as a change."""
    got = islands(scores, "regime_label").groupBy(E).agg(F.count("*").alias("changes"), F.sum("n_rows").alias("n"), F.avg("n_rows").alias("avg_dwell_periods"), F.percentile("n_rows", 0.5).alias("median_dwell_periods"))
    values = {"churn_rate": F.col("changes") * 100.0 / F.col("n"), "total_transitions": F.col("changes").cast("double"), "avg_dwell_periods": F.col("avg_dwell_periods"), "median_dwell_periods": F.col("median_dwell_periods")}
    return got.select(E, *[v.alias(k) for k, v in values.items()]).unpivot([E], list(values), "metric_name", "metric_value")


def zone_changes(scores: DataFrame) -> DataFrame:
    """Rows whose zone differs from the one before; the first row comes from START."""
    h = health("fused")
    order = W.partitionBy(E).orderBy("ts")
    got = scores.select(E, "ts", zone(h).alias("to_zone"), h.alias("health_index"), F.col("fused").alias("fused_z")).withColumn("from_zone", F.lag("to_zone").over(order))
    return got.where(~F.col("to_zone").eqNullSafe(F.col("from_zone"))).withColumn("from_zone", F.coalesce("from_zone", F.lit("START")))


def threshold_crossings(scores: DataFrame, threshold: float = Z_WARN) -> DataFrame:
    """Rows where the fused score changes sides; the first row is always given."""
    order = W.partitionBy(E).orderBy("ts")
    got = scores.select(E, "ts", F.col("fused").alias("z"), (F.col("fused") > threshold).alias("up")).withColumn("was", F.lag("up").over(order))
    return got.where("was is null or was <> up").select(E, "ts", F.lit(threshold).alias("threshold"), "z", F.when(F.col("up"), "up").otherwise("down").alias("direction"))


def drift_events(drift: DataFrame, threshold: float = 3.0, column: str = "cusum_z") -> DataFrame:
    """Segments above the threshold; they end at the first row after, whose value counts too."""
    order = W.partitionBy(E).orderBy("ts")
    a = F.abs(column)
    marked = drift.select(E, "ts", a.alias("a"), (a > threshold).alias("hot")).withColumns({"next_ts": F.lead("ts").over(order), "next_a": F.lead("a").over(order)})
    runs = marked.withColumn("run", F.sum((~F.col("hot")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where("hot")
    got = runs.groupBy(E, "run").agg(F.min("ts").alias("segment_start"), F.max("ts").alias("last_ts"), F.max("next_ts").alias("after"), F.max("a").alias("peak"), F.max_by("next_a", "ts").alias("next_a"))
    return got.select(E, "segment_start", F.coalesce("after", "last_ts").alias("segment_end"), F.greatest("peak", "next_a").alias("value"))


def alert_age(scores: DataFrame) -> DataFrame:
    """By zone: first start, hours and rows over all its runs."""
    runs = islands(scores.withColumn("zone", zone(health("fused"))), "zone").where("zone is not null")
    return runs.groupBy(E, F.col("zone").alias("alert_zone")).agg(F.min("start_ts").alias("start_ts"), F.sum(seconds_between("start_ts", "end_ts") / 3600).alias("duration_hours"), F.sum("n_rows").alias("record_count"))


def tail_trend(series: DataFrame, column: str, rows: int = 20) -> DataFrame:
    """Least-squares slope of the last rows."""
    last = series.withColumn("_n", F.row_number().over(W.partitionBy(E).orderBy(F.desc("ts")))).where(F.col("_n") <= rows)
    return last.groupBy(E).agg(F.regr_slope(F.col(column), -F.col("_n").cast("double")).alias("slope"))


def tail_volatility(scores: DataFrame, rows: int = 20) -> DataFrame:
    """Share of regime changes between the last rows."""
    last = scores.withColumn("_n", F.row_number().over(W.partitionBy(E).orderBy(F.desc("ts")))).where(F.col("_n") <= rows)
    moved = last.withColumn("moved", F.col("regime_label") != F.lag("regime_label").over(W.partitionBy(E).orderBy("ts")))
    return moved.groupBy(E).agg((F.sum(F.coalesce(F.col("moved").cast("int"), F.lit(0))) / F.greatest(F.count("*") - 1, F.lit(1))).alias("volatility"))


def rolling_share(scores: DataFrame, rows: int = 24) -> DataFrame:
    w = W.partitionBy(E).orderBy("ts").rowsBetween(-(rows - 1), 0)
    return scores.select(E, "ts", F.avg((F.col("fused") > Z_WARN).cast("int")).over(w).alias("share"))


def stationarity(series: DataFrame, column: str, width: int = 50) -> DataFrame:
    """Variance of the full rolling means over the variance; below 0.1 counts as stationary."""
    order = W.partitionBy(E).orderBy("ts")
    w = order.rowsBetween(-(width - 1), 0)
    got = series.withColumn("_m", F.when(F.count(column).over(w) == width, F.avg(column).over(w))).groupBy(E).agg(F.var_samp("_m").alias("a"), F.var_samp(column).alias("b"))
    ratio = F.when(F.col("b") > 0, F.col("a") / F.col("b"))
    return got.select(E, ratio.alias("ratio"), F.coalesce(ratio < 0.1, F.lit(True)).alias("stationary"))


def hotspots(context: DataFrame, warn: float = 1.5, alert: float = 3.0, top: int = 10) -> DataFrame:
    """Tags by peak |z| over (equip_id, tag, ts, value, z, train_mean, train_std); of equal peaks the earliest."""
    a = F.abs("z")
    peak = F.max_by(F.struct("ts", "z", "value"), F.struct(a, -F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))))
    last = F.max_by(F.struct("ts", "z", "value"), "ts")
    got = context.where("z is not null").groupBy(E, "tag").agg(peak.alias("p"), last.alias("l"), F.first("train_mean").alias("train_mean"), F.first("train_std").alias("train_std"), F.count_if(a >= warn).alias("above_warn"), F.count_if(a >= alert).alias("above_alert"))
    out = got.select(E, "tag", F.col("p.ts").alias("max_ts"), F.col("l.ts").alias("latest_ts"), F.abs("p.z").alias("max_abs_z"), F.col("p.z").alias("max_signed_z"), F.abs("l.z").alias("latest_abs_z"), F.col("p.value").alias("value_at_peak"), F.col("l.value").alias("latest_value"), "train_mean", "train_std", "above_warn", "above_alert").where(F.col("max_abs_z") >= warn)
    ranked = out.withColumn("_n", F.row_number().over(W.partitionBy(E).orderBy(F.desc("max_abs_z"), "tag")))
    return ranked.where(F.col("_n") <= top).drop("_n")


def hotspot_timeline(context: DataFrame, warn: float = 1.5, alert: float = 3.0, k: int = 3) -> DataFrame:
    a = F.abs("z")
    ranked = context.where("z is not null").withColumn("rank", F.row_number().over(W.partitionBy(E, "ts").orderBy(F.desc(a), "tag")))
    return ranked.where((F.col("rank") <= k) & (a >= warn)).select(E, "ts", "tag", F.col("rank").cast("long").alias("rank"), a.alias("abs_z"), F.col("z").alias("signed_z"), "value", F.when(a >= alert, "ALERT").otherwise("WARN").alias("level"))


def worst_tags(context: DataFrame, n: int = 5) -> DataFrame:
    """The tags with the greatest |z| over all rows."""
    return context.groupBy("tag").agg(F.max(F.abs("z")).alias("max_abs_z")).orderBy(F.desc("max_abs_z"), "tag").limit(n)


def zone_medians(long: DataFrame, scores: DataFrame) -> DataFrame:
    """Median of each tag while GOOD and while ALERT, by the size of the difference."""
    zones = scores.select(E, "ts", zone(health("fused")).alias("zone"))
    got = long.join(zones, [E, "ts"]).groupBy(E, "tag").agg(*[F.percentile(F.when(F.col("zone") == z, F.col("value")), 0.5).alias(z.lower()) for z in ZONES])
    return got.withColumn("delta", F.col("alert") - F.col("good"))


# episodes: equip_id, episode_id, start_ts, end_ts, duration_s, len, culprits, severity


def duration_hours() -> Column:
    s = seconds_between("start_ts", "end_ts")
    return F.coalesce(F.when(s > 0, s), F.col("duration_s"), F.lit(0.0)) / 3600


def episode_metrics(episodes: DataFrame) -> DataFrame:
    """The observation lasts thirty days at least; the interarrival time is the total duration over n - 1."""
    h = F.when(duration_hours() > 0, duration_hours())
    got = episodes.groupBy(E).agg(F.count("*").alias("total_episodes"), F.coalesce(F.sum(h), F.lit(0.0)).alias("total_hours"), F.avg(h).alias("avg_hours"), F.percentile(h, 0.5).alias("median_hours"), F.max(h).alias("max_hours"), F.min(h).alias("min_hours"))
    days = F.greatest(F.lit(30.0), F.col("total_hours") / 24)
    many = F.col("total_episodes") > 1
    return got.withColumns({"rate_per_day": F.col("total_episodes") / days, "mean_interarrival_hours": F.when(many, F.col("total_hours") / (F.col("total_episodes") - 1)).otherwise(0.0)})


def episodes_qc(scores: DataFrame, episodes: DataFrame) -> DataFrame:
    bounds = scores.groupBy(E).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), (F.avg((F.col("fused") > Z_WARN).cast("int")) * 100).alias("time_in_alert_pct"), F.max("fused").alias("max_fused"), F.avg("fused").alias("avg_fused"))
    met = episodes.join(bounds.select(E, "t0", "t1"), E)
    cover = F.greatest(F.lit(0.0), seconds_between(F.greatest("start_ts", "t0"), F.least("end_ts", "t1")))
    eps = met.groupBy(E).agg(F.count("*").alias("episode_count"), (F.percentile(duration_hours(), 0.5) * 60).alias("median_minutes"), F.sum(cover).alias("covered"))
    total = F.greatest(F.lit(1.0), seconds_between("t0", "t1"))
    return bounds.join(eps, E, "left").select(E, F.coalesce("episode_count", F.lit(0)).alias("episode_count"), F.coalesce("median_minutes", F.lit(0.0)).alias("median_minutes"), F.coalesce(F.col("covered") / total * 100, F.lit(0.0)).alias("coverage_pct"), "time_in_alert_pct", "max_fused", "avg_fused")


def severity_mapping(episodes: DataFrame) -> DataFrame:
    counts = [F.count_if(F.upper("severity") == s).alias(s.lower()) for s in SEVERITIES]
    got = episodes.groupBy(E).agg(F.count("*").alias("total_episodes"), *counts)
    total = reduce(lambda a, b: a + b, [F.col(s.lower()) for s in SEVERITIES])
    return got.withColumn("validation_status", F.when(total == F.col("total_episodes"), "VALID").otherwise("MISMATCH")).withColumn("counts_json", F.to_json(F.struct(*[F.col(s.lower()).alias(s) for s in SEVERITIES])))


def episode_contributions(scores: DataFrame, episodes: DataFrame, least_pct: float = 1.0) -> DataFrame:
    """Share of each detector's mean |z| within an episode, ranked; small shares left out before ranking."""
    met = inside(melt(scores), episodes.select(E, "episode_id", "start_ts", "end_ts"))
    got = met.groupBy(E, "episode_id", "detector").agg(F.avg(F.abs("z")).alias("mean_z"))
    each = W.partitionBy(E, "episode_id")
    got = got.withColumn("contribution_pct", F.try_divide(F.col("mean_z"), F.sum("mean_z").over(each)) * 100).where(F.col("contribution_pct") >= least_pct)
    return got.withColumn("rank", F.row_number().over(each.orderBy(F.desc("contribution_pct"), "detector")).cast("long"))


def episode_diagnostics(scores: DataFrame, episodes: DataFrame) -> DataFrame:
    met = inside(scores.select(E, "ts", "fused"), episodes)
    got = met.groupBy(E, "episode_id").agg(F.max("fused").alias("peak_z"), F.max_by("ts", F.struct("fused", -F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")))).alias("peak_ts"), F.avg("fused").alias("avg_z"), F.min(health("fused")).alias("min_health"))
    out = episodes.join(got, [E, "episode_id"]).withColumn("duration_h", duration_hours())
    first = F.trim(F.substring_index(F.coalesce("culprits", F.lit("")), ",", 1))
    sensor = F.when(first == "", "Unknown").otherwise(F.trim(F.substring_index(first, "(", 1)))
    p, d = F.col("peak_z"), F.col("duration_h")
    reason = F.when(p >= 3, "Extreme anomaly").when(p >= 2.5, "High anomaly").when(d >= 24, "Extended duration").when(d >= 4, "Moderate duration").otherwise("Brief anomaly")
    return out.select(E, "episode_id", "peak_z", "peak_ts", "duration_h", sensor.alias("dominant_sensor"), "severity", reason.alias("severity_reason"), "avg_z", "min_health")


def majority_regime(scores: DataFrame, episodes: DataFrame) -> DataFrame:
    """The most common regime within an episode; the smallest of equals."""
    met = inside(scores.select(E, "ts", "regime_label"), episodes.select(E, "episode_id", "start_ts", "end_ts")).groupBy(E, "episode_id", "regime_label").agg(F.count("*").alias("n"))
    return met.groupBy(E, "episode_id").agg(F.max_by("regime_label", F.struct("n", -F.col("regime_label"))).alias("regime"))


def culprit_history(scores: DataFrame, episodes: DataFrame, weights: dict[str, float], around: int = 10) -> DataFrame:
    """The detector of the greatest weighted mean in an episode, with its means over the rows before and after."""
    pos = scores.withColumn("pos", F.row_number().over(W.partitionBy(E).orderBy("ts")))
    spans = inside(pos.select(E, "ts", "pos"), episodes.select(E, "episode_id", "start_ts", "end_ts")).groupBy(E, "episode_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    long = pos.unpivot([E, "ts", "pos"], detectors(scores), "detector", "z")
    near = spans.withColumn("pos", F.explode(F.sequence(F.col("a") - around, F.col("b") + around)))
    met = long.join(near, [E, "pos"])
    mean = lambda cond: F.avg(F.when(cond, F.col("z")))
    got = met.groupBy(E, "episode_id", "detector").agg(mean(F.col("pos") < F.col("a")).alias("lead_mean_z"), mean(F.col("pos").between(F.col("a"), F.col("b"))).alias("during_mean_z"), mean(F.col("pos") > F.col("b")).alias("lag_mean_z"))
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), F.col("detector")), F.lit(1.0))
    got = got.withColumn("weighted", F.col("during_mean_z") * w)
    ranked = got.withColumn("_n", F.row_number().over(W.partitionBy(E, "episode_id").orderBy(F.desc("weighted"), "detector"))).where("_n = 1").drop("_n")
    return episodes.join(ranked, [E, "episode_id"]).select(E, "episode_id", "start_ts", "end_ts", duration_hours().alias("duration_hours"), F.regexp_replace("detector", "_z$", "").alias("primary_detector"), F.col("weighted").alias("weighted_contribution"), "lead_mean_z", "during_mean_z", "lag_mean_z")


def parse_culprits(episodes: DataFrame) -> DataFrame:
    """One row for each name of a comma list ``detector(sensor)``, in order."""
    got = episodes.select(E, "episode_id", F.posexplode(F.split("culprits", ",")).alias("i", "part")).withColumn("part", F.trim("part")).where("part <> ''")
    return got.select(E, "episode_id", (F.col("i") + 1).cast("long").alias("rank"), F.trim(F.substring_index("part", "(", 1)).alias("detector"), F.nullif(F.regexp_extract("part", r"\(([^)]*)\)", 1), F.lit("")).alias("sensor"))


def culprits_by_severity(episodes: DataFrame) -> DataFrame:
    parts = parse_culprits(episodes).select(E, "episode_id", "detector").join(episodes.select(E, "episode_id", F.upper("severity").alias("severity")), [E, "episode_id"])
    return parts.groupBy("detector").pivot("severity", list(SEVERITIES)).count().na.fill(0)


def contributions_long(contrib: DataFrame) -> DataFrame:
    """(equip_id, ts, sensor, score) with the share of its row; 0 where the row's total is."""
    total = F.sum("score").over(W.partitionBy(E, "ts"))
    return contrib.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("contribution_pct", F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score") / total * 100))).otherwise(0.0))


def build_all(scores: DataFrame, episodes: DataFrame, context: DataFrame, drift: DataFrame) -> dict[str, DataFrame]:
    """Every table by name; nothing runs until one is asked for."""
    return {
        "health_timeline": health_timeline(scores), "contributions_now": contributions_now(scores), "contribution_timeline": contribution_timeline(scores), "defect_summary": defect_summary(scores, episodes), "sensor_defects": sensor_defects(scores),
        "zones_by_day": zones_by_day(scores), "anomalies_by_day": anomalies_by_day(scores), "calibration_summary": calibration_summary(scores), "detector_correlation": detector_correlation(scores), "health_histogram": health_histogram(scores),
        "weekly_profile": weekly_profile(scores), "health_by_hour": health_by_hour(scores), "since_when": since_when(scores), "regime_timeline": regime_timeline(scores), "regime_occupancy": regime_occupancy(scores), "regime_transitions": regime_transitions(scores),
        "regime_dwell": regime_dwell(scores), "regime_stats": regime_stats(scores), "regime_stability": regime_stability(scores), "zone_changes": zone_changes(scores), "threshold_crossings": threshold_crossings(scores), "drift_events": drift_events(drift), "drift_series": drift_series(drift),
        "alert_age": alert_age(scores), "hotspots": hotspots(context), "hotspot_timeline": hotspot_timeline(context), "episode_metrics": episode_metrics(episodes), "episodes_qc": episodes_qc(scores, episodes), "severity_mapping": severity_mapping(episodes), "episode_contributions": episode_contributions(scores, episodes),
        "episode_diagnostics": episode_diagnostics(scores, episodes), "parse_culprits": parse_culprits(episodes),
    }


def culprit_basics(episodes: DataFrame) -> DataFrame:
    """What an episode says of itself where scores hold no detector columns."""
    return episodes.select("equip_id", "episode_id", "start_ts", "end_ts", (F.col("duration_s") / 3600).alias("duration_hours"), F.coalesce("culprits", F.lit("unknown")).alias("culprits"))
