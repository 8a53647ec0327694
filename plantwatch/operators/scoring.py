"""Calibration, fusion, drift, episodes and alert modes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plantwatch.functions.scalar import clip, seconds, seconds_between
from plantwatch.operators.islands import inside, nearest
from plantwatch.operators.tables import majority_regime

E = "equip_id"


def _fit(rows: DataFrame, keys: list[str], value: str, q: float, least: float) -> DataFrame:
    x = F.col(value)
    mid = rows.where(x.isNotNull()).groupBy(*keys).agg(F.percentile(x, 0.5).alias("median"), F.stddev_pop(x).alias("sd"), F.percentile(x, q).alias("q_raw"), F.count("*").alias("n"))
    # what was found goes along, so nothing is joined again
    both = rows.select(*keys, value).join(mid, keys).groupBy(*keys).agg(F.percentile(F.abs(x - F.col("median")), 0.5).alias("mad"), *[F.first(c).alias(c) for c in ("median", "sd", "q_raw", "n")])
    scale = F.when(F.col("mad") * 1.4826 >= least, F.col("mad") * 1.4826).when(F.col("sd") > least, F.col("sd")).otherwise(F.lit(1.0))
    return both.select(*keys, "median", scale.alias("scale"), "q_raw", "n").withColumn("q_z", (F.col("q_raw") - F.col("median")) / F.col("scale"))


def calibrate(train: DataFrame, keys: tuple[str, ...] = (E, "detector"), value: str = "score", q: float = 0.98, fp_rate: float | None = None) -> DataFrame:
    """Median, robust scale and threshold by key; with a target false-positive rate the quantile is 1 - rate, within [0.9, 0.995]."""
    return _fit(train, list(keys), value, min(0.995, max(0.9, 1 - fp_rate)) if fp_rate is not None else q, 1e-3)


def calibrate_by_regime(train: DataFrame, keys: tuple[str, ...] = (E, "detector"), value: str = "score", q: float = 0.98) -> DataFrame:
    """The same for each regime; regimes of ten points or fewer take the whole's parameters."""
    whole = calibrate(train, keys, value, q)
    part = _fit(train.where("regime_label is not null"), [*keys, "regime_label"], value, q, 1e-9)
    met = part.join(whole.select(*keys, *[F.col(x).alias(f"_{x}") for x in ("median", "scale", "q_raw", "q_z")]), list(keys))
    return met.select(*keys, "regime_label", "n", *[F.when(F.col("n") > 10, F.col(x)).otherwise(F.col(f"_{x}")).alias(x) for x in ("median", "scale", "q_raw", "q_z")])


def apply_calibration(rows: DataFrame, params: DataFrame, keys: tuple[str, ...] = (E, "detector"), value: str = "score", clip_z: float = 8.0, hard: bool = True, sensitivity: dict[int, float] | None = None) -> DataFrame:
    """z = (x - median) / scale, clipped; null is 0. Only the global form also has the hard limit of 10."""
    scale = F.col("scale")
    if sensitivity:
        factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in sensitivity.items() for v in kv]), F.col("regime_label")), F.lit(1.0))
        scale = F.when(factor > 0, scale / factor).otherwise(scale)
    z = clip((F.col(value) - F.col("median")) / F.greatest(scale, F.lit(1e-9)), -clip_z, clip_z)
    if hard:
        z = clip(z, -10, 10)
    return rows.join(params.select(*keys, "median", "scale"), list(keys), "left").withColumn("z", F.coalesce(z, F.lit(0.0))).drop("median", "scale")


def adaptive_clip(z: DataFrame, default: float = 8.0) -> DataFrame:
    """max(default, min(1.5 times the greatest P99 over detectors, 50)) by equipment."""
    p = z.groupBy(E, "detector").agg(F.percentile(F.abs("z"), 0.99).alias("p99"))
    return p.groupBy(E).agg(F.greatest(F.lit(default), F.least(F.lit(50.0), F.max("p99") * 1.5)).alias("clip_z"))


def threshold_table(whole: DataFrame, by_regime: DataFrame) -> DataFrame:
    cols = [E, "detector", "regime_label", "median", "scale", "q_raw", "q_z"]
    return whole.withColumn("regime_label", F.lit(None).cast("int")).select(*cols).unionByName(by_regime.select(*cols))


def fuse(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Every stream is standardised over its batch, and weights are shared out among the streams present."""
    names = [x for x in scores.columns if x.endswith("_z") and x != "fused_z"]
    total = sum(weights.get(n, 0.0) for n in names)
    share = {n: weights.get(n, 0.0) / total if total > 0 else 1 / len(names) for n in names}
    stats = scores.groupBy(E).agg(*[F.avg(n).alias(f"_m{i}") for i, n in enumerate(names)], *[F.stddev_pop(n).alias(f"_s{i}") for i, n in enumerate(names)])
    parts = [F.lit(share[n]) * F.coalesce((F.col(n) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 1e-9, F.col(f"_s{i}")).otherwise(F.lit(1.0)), F.lit(0.0)) for i, n in enumerate(names)]
    fused = parts[0]
    for p in parts[1:]:
        fused = fused + p
    return scores.join(stats, E).withColumn("fused", fused).select(*scores.columns, "fused")


def tuned_limits(scores: DataFrame, k_factor: float = 0.5, h_factor: float = 3.0, k: tuple[float, float] = (0.25, 4.0), h: tuple[float, float] = (2.0, 12.0)) -> DataFrame:
    """k and h from the fused score's deviation and its P95 - P50."""
    q = F.percentile("fused", F.array(F.lit(0.5), F.lit(0.95)))
    got = scores.groupBy(E).agg(F.greatest(F.stddev_pop("fused"), F.lit(1e-3)).alias("sd"), q.alias("q"))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1e-3))
    return got.select(E, clip(F.col("sd") * k_factor, *k).alias("k_sigma"), clip(spread * h_factor, *h).alias("h_sigma"))


def cusum(series: DataFrame, value: str = "x", k: float = 0.5) -> DataFrame:
    """Two-sided CUSUM without reset in closed form: the running sum less its least value so far."""
    order = W.partitionBy(E).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    out = series
    for side, sign in (("pos", 1.0), ("neg", -1.0)):
        out = out.withColumn(f"_c{side}", F.sum(F.lit(sign) * F.col(value) - k).over(order))
        out = out.withColumn(f"cusum_{side}", F.col(f"_c{side}") - F.least(F.lit(0.0), F.min(f"_c{side}").over(order))).drop(f"_c{side}")
    return out.withColumn("cusum", F.greatest("cusum_pos", "cusum_neg"))


def drift(scores: DataFrame, column: str = "fused", k: float = 0.5) -> DataFrame:
    """CUSUM of the standardised series, calibrated on itself."""
    stats = scores.groupBy(E).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    x = (F.col(column) - F.col("_m")) / F.when(F.col("_s") > 1e-9, F.col("_s")).otherwise(F.lit(1.0))
    raw = cusum(scores.join(stats, E).select(E, "ts", x.alias("x")), k=k).select(E, "ts", F.lit("drift").alias("detector"), F.col("cusum").alias("score"))
    z = apply_calibration(raw, calibrate(raw))
    return z.select(E, "ts", F.col("score").alias("drift"), F.col("z").alias("cusum_z"))


def _closings(x: np.ndarray, k: float, h: float, least: int) -> list[tuple[int, int]]:
    """Index pairs of episodes: a CUSUM that starts over whenever it passes h; the start stays at the first positive sum."""
    mu, s, start, out = float(np.mean(x)), 0.0, None, []
    for i, v in enumerate(x):
        s = max(0.0, s + (v - mu - k))
        if start is None and s > 0:
            start = i
        if start is not None and s > h:
            if i - start + 1 >= least:
                out.append((start, i))
            s, start = 0.0, None
    return out


def merge_near(spans: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a - out[-1][1] - 1 <= gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


EPISODES = "equip_id int, episode_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, duration_s double, len long"


def episodes(scores: DataFrame, k_sigma: float = 0.5, h_sigma: float = 5.0, min_len: int = 3, gap_merge: int = 5, min_duration_s: float = 60.0) -> DataFrame:
    """Episodes of the fused score by equipment.

    The sum starts over inside the series, so the fold is sequential by nature
    and runs once for each piece of equipment; only (ts, fused) goes to Python.
    """

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=["fused"]).sort_values("ts")
        x, ts = frame["fused"].to_numpy(float), frame["ts"].to_numpy()
        rows = []
        if len(x):
            sd = float(np.std(x))
            sd = sd if sd > 1e-9 else 1.0
            for a, b in merge_near(_closings(x, k_sigma * sd, h_sigma * sd, min_len), gap_merge):
                seconds_ = float((ts[b] - ts[a]) / np.timedelta64(1, "us")) / 1e6
                if seconds_ >= min_duration_s:
                    rows.append((int(frame["equip_id"].iloc[0]), len(rows) + 1, ts[a], ts[b], seconds_, b - a + 1))
        return pd.DataFrame(rows, columns=["equip_id", "episode_id", "start_ts", "end_ts", "duration_s", "len"])

    return scores.select(F.col(E).cast("int").alias(E), "ts", "fused").groupBy(E).applyInPandas(find, EPISODES)


def name_episodes(found: DataFrame, scores: DataFrame, multivariate: tuple[str, ...] = ("pca", "mhal")) -> DataFrame:
    """Culprit and severity of each episode: the detector of the greatest mean, info / warning / critical by the peak."""
    names = [x for x in scores.columns if x.endswith("_z") and x != "fused_z"]
    met = inside(scores, found.select(E, "episode_id", "start_ts", "end_ts"))
    got = met.groupBy(E, "episode_id").agg(F.array(*[F.struct(F.avg(n).alias("m"), F.lit(-i).alias("i"), F.lit(n.removesuffix("_z")).alias("name")) for i, n in enumerate(names)]).alias("a"), F.max("fused").alias("peak_fused_z"), F.avg("fused").alias("avg_fused_z"))
    severity = F.when(F.col("peak_fused_z") >= 4, "CRITICAL").when(F.col("peak_fused_z") >= 3, "HIGH").when(F.col("peak_fused_z") >= 2, "MEDIUM").otherwise("LOW")
    return found.join(got.select(E, "episode_id", F.array_max("a")["name"].alias("culprits"), "peak_fused_z", "avg_fused_z", severity.alias("severity")), [E, "episode_id"])


def normalise_episodes(found: DataFrame, scores: DataFrame) -> DataFrame:
    """Ends moved to the nearest scored times, hours, regime, ids in order of time."""
    known = scores.select(E, "ts", F.col("ts").alias("at"))
    for end in ("start_ts", "end_ts"):
        rest = found.drop(end)
        found = nearest(found.withColumnRenamed(end, "ts"), known, "at").drop("ts", "right_ts").withColumnRenamed("at", end).select(*rest.columns, end)
    found = found.withColumn("duration_s", F.greatest(F.lit(0.0), seconds_between("start_ts", "end_ts"))).withColumn("duration_hours", F.col("duration_s") / 3600)
    found = found.join(majority_regime(scores, found), [E, "episode_id"], "left") if "regime_label" in scores.columns else found
    return found.withColumn("episode_id", F.row_number().over(W.partitionBy(E).orderBy("start_ts", "end_ts")).cast("long"))


def tune_weights(long: DataFrame, labels: DataFrame, current: dict[str, float], temperature: float = 2.0, learn: float = 0.3, floor: float = 0.05) -> DataFrame:
    """New weights by average precision of each detector against labelled rows, softmax, a moving average and a floor.

    ``labels`` has equip_id, ts and label (0/1). Average precision needs only
    ranks and running sums, a window for each detector.
    """
    met = long.join(labels, [E, "ts"])
    order = W.partitionBy("detector").orderBy(F.desc("z"), E, "ts").rowsBetween(W.unboundedPreceding, 0)
    ranked = met.withColumns({"tp": F.sum("label").over(order), "rank": F.row_number().over(W.partitionBy("detector").orderBy(F.desc("z"), E, "ts"))})
    ap = ranked.groupBy("detector").agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("label") == 1, F.col("tp") / F.col("rank"))), F.sum("label")), F.lit(0.0)).alias("average_precision"))
    every = W.partitionBy(F.lit(0))  # a row for each detector
    e = F.exp(F.col("average_precision") * temperature)
    was = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in current.items() for v in kv]), F.col("detector")), F.lit(0.0))
    mixed = F.greatest(F.lit(floor), (1 - learn) * was + learn * e / F.sum(e).over(every))
    return ap.withColumn("_w", mixed).select("detector", "average_precision", (F.col("_w") / F.sum("_w").over(every)).alias("weight"))


def episode_labels(scores: DataFrame, found: DataFrame) -> DataFrame:
    hit = inside(scores.select(E, "ts"), found.select(E, "start_ts", "end_ts")).select(E, "ts").distinct().withColumn("label", F.lit(1))
    return scores.select(E, "ts").join(hit, [E, "ts"], "left").fillna(0, ["label"])


def alert_mode(stats: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """FAULT or DRIFT by slope, P95 and volatility, with hysteresis 3.0 / 1.5 around the mode before.

    ``stats`` has equip_id, slope, p95, volatility; ``previous`` equip_id, mode.
    """
    met = stats.join(previous.select(E, F.col("mode").alias("was")), E, "left") if previous is not None else stats.withColumn("was", F.lit("FAULT"))
    band = F.col("p95").between(2.0, 5.0)
    drifting = band & (F.abs("slope") > 0.05) & (F.col("volatility") < 0.3)
    stays = (F.col("was") == "DRIFT") & (F.col("p95") > 1.5)
    starts = (F.coalesce("was", F.lit("FAULT")) != "DRIFT") & (F.col("p95") > 3.0)
    return met.withColumn("mode", F.when(drifting & (stays | starts), "DRIFT").otherwise("FAULT"))


def sample_durations(df: DataFrame) -> DataFrame:
    """Seconds until the next row; the last row gets the median."""
    got = df.withColumn("_d", seconds_between("ts", F.lead("ts").over(W.partitionBy(E).orderBy("ts"))))
    mid = got.groupBy(E).agg(F.percentile("_d", 0.5).alias("_m"))
    return got.join(mid, E).withColumn("duration_s", F.coalesce("_d", "_m", F.lit(0.0))).drop("_d", "_m")


def saturation(long: DataFrame, clip_z: float = 12.0) -> DataFrame:
    return long.groupBy(E, "detector").agg((F.avg((F.abs("z") >= 0.95 * clip_z).cast("int")) * 100).alias("saturation_pct"), F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("std_z"))


def anomaly_rate(scores: DataFrame) -> DataFrame:
    return scores.groupBy(E).agg(F.avg((F.col("fused") > 1.0).cast("int")).alias("anomaly_rate"), F.max("fused").alias("max_score"), F.avg("fused").alias("mean_score"))


def episode_quality(found: DataFrame, scores: DataFrame) -> DataFrame:
    """Coverage up to 80 % and no episode over thirty days."""
    rows = scores.groupBy(E).agg(F.count("*").alias("n_rows"))
    got = found.groupBy(E).agg(F.count("*").alias("n_episodes"), F.sum("len").alias("covered"), F.max("duration_s").alias("longest_s"))
    cover = F.coalesce(F.col("covered") * 100.0 / F.col("n_rows"), F.lit(0.0))
    return rows.join(got, E, "left").select(E, F.coalesce("n_episodes", F.lit(0)).alias("n_episodes"), cover.alias("coverage_pct"), F.coalesce(F.col("longest_s") / 3600, F.lit(0.0)).alias("longest_hours"), ((cover <= 80) & (F.coalesce("longest_s", F.lit(0.0)) <= 30 * 86400)).alias("ok"))


def retrain_reasons(quality: DataFrame) -> DataFrame:
    """Reasons by gate over equip_id, silhouette, anomaly_rate, saturation_pct, episodes_ok, config_changed."""
    gates = {"config changed": F.col("config_changed"), "poor regimes": F.col("silhouette") < 0.15, "anomaly rate": F.col("anomaly_rate") > 0.25, "saturated detectors": F.col("saturation_pct") > 5, "episodes": ~F.col("episodes_ok")}
    why = F.array_compact(F.array(*[F.when(g, F.lit(n)) for n, g in gates.items()]))
    return quality.select(E, (F.size(why) > 0).alias("retrain"), F.array_join(why, "; ").alias("reasons"))


def run_health(scores: DataFrame) -> DataFrame:
    from plantwatch.functions.scalar import health

    h = health("fused")
    got = scores.groupBy(E).agg(F.count("*").alias("n_rows"), F.avg(h).alias("avg_health"), F.min(h).alias("min_health"), F.max(F.abs("fused")).alias("max_fused"))
    return got.withColumn("status", F.when((F.col("avg_health") >= 85) & (F.col("max_fused") < 3), "HEALTHY").when((F.col("avg_health") >= 70) & (F.col("max_fused") < 5), "CAUTION").otherwise("ALERT"))


def auto_tune(quality: DataFrame, config: DataFrame) -> DataFrame:
    """New values for (equip_id, param_path, value): clip x 1.2 on saturation, k_sigma x 1.1 up to 4 on too many anomalies, k_max + 2 up to 12 on poor regimes."""
    met = config.join(quality, E)
    v = F.col("value")
    new = (
        F.when((F.col("param_path") == "thresholds.clip_z") & (F.col("saturation_pct") > 5), v * 1.2)
        .when((F.col("param_path") == "episodes.k_sigma") & (F.col("anomaly_rate") > 0.25), F.least(F.lit(4.0), v * 1.1))
        .when((F.col("param_path") == "regimes.k_max") & (F.col("silhouette") < 0.15), F.least(F.lit(12.0), v + 2))
    )
    return met.select(E, "param_path", v.alias("old_value"), new.alias("new_value")).where("new_value is not null and new_value <> old_value")
