"""Forecasts of health, time to failure and maintenance windows.

A series has equip_id, ts and y. Parameters are aggregates, horizons are rows
made by ``sequence``, and the forecast itself is a closed form in each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plantwatch.functions.scalar import clip, correlation, norm_cdf_sql, seconds, seconds_between
from plantwatch.operators.detectors import lag_moments

E = "equip_id"
Z95 = 1.96


def suitability(series: DataFrame, keys: tuple[str, ...] = (E,)) -> DataFrame:
    """Lower is better: 2 x share of nulls + 1.5 x (1 - |autocorrelation|) + trend, at least twenty values."""
    w = W.partitionBy(*keys).orderBy("ts")
    n = F.count("*").over(W.partitionBy(*keys))
    x = series.withColumns({"p": F.lag("y").over(w), "half": F.when(F.row_number().over(w) <= n / 2, 0).otherwise(1)})
    got = x.groupBy(*keys).agg(F.count("y").alias("n"), F.avg(F.col("y").isNull().cast("int")).alias("missing"), correlation("y", "p").alias("acf"), F.stddev_samp("y").alias("sd"), F.avg(F.when(F.col("half") == 0, F.col("y"))).alias("a"), F.avg(F.when(F.col("half") == 1, F.col("y"))).alias("b"))
    trend = F.least(F.lit(1.0), F.coalesce(F.abs(F.col("b") - F.col("a")) / F.when(F.col("sd") > 1e-9, F.col("sd")), F.lit(0.0)))
    score = 2 * F.col("missing") + 1.5 * (1 - F.abs(F.coalesce("acf", F.lit(0.0)))) + trend
    return got.select(*keys, "n", F.when(F.col("n") >= 20, score).otherwise(F.lit(float("inf"))).alias("score"))


def best_series(scored: DataFrame, preferred: str, name: str = "series") -> DataFrame:
    """The preferred series if it scores below 3, else the lowest."""
    first = F.when((F.col(name) == preferred) & (F.col("score") < 3), 0).otherwise(1)
    return scored.withColumn("_n", F.row_number().over(W.partitionBy(E).orderBy(first, "score", name))).where("_n = 1").drop("_n")


def step_seconds(series: DataFrame) -> DataFrame:
    d = series.withColumn("d", seconds_between(F.lag("ts").over(W.partitionBy(E).orderBy("ts")), "ts")).where("d > 0")
    return d.groupBy(E).agg(F.percentile("d", 0.5).alias("step_s"))


def fit(series: DataFrame, keys: tuple[str, ...] = (E,), cap: float = 0.999) -> DataFrame:
    """AR(1) about the mean: mu, phi, residual deviation, last value and time, step; one exchange by key."""
    key, w = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("ts")
    x = series.where("y is not null").withColumn("mu", F.avg("y").over(key)).withColumn("x", F.col("y") - F.col("mu"))
    x = x.withColumns({"p": F.lag("x").over(w), "d": seconds_between(F.lag("ts").over(w), "ts")})
    more = (F.count("*").alias("n"), F.max_by("y", "ts").alias("last_y"), F.max("ts").alias("last_ts"), F.percentile("d", 0.5).alias("step_s"), F.regr_slope(F.col("y"), seconds("ts")).alias("slope"))
    # a single value has no residual
    return lag_moments(x, list(keys), cap, *more).where("n > 1").select(*keys, "mu", "n", "phi", "last_y", "last_ts", "step_s", "slope", "sd")


def forecast(params: DataFrame, horizon: int, trend: float = 0.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """mu + (last - mu) phi^h, plus a share of the slope, with a band whose variance ratio lies within [1, 100]."""
    rows = params.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    decay = F.pow("phi", F.col("h").cast("double"))
    y = F.col("mu") + (F.col("last_y") - F.col("mu")) * decay + F.lit(trend) * F.coalesce("slope", F.lit(0.0)) * F.col("h") * F.col("step_s")
    ratio = F.when(F.abs("phi") < 0.9999, (1 - F.pow("phi", 2.0 * F.col("h"))) / (1 - F.col("phi") * F.col("phi"))).otherwise(F.col("h").cast("double"))
    sd = F.col("sd") * F.sqrt(clip(ratio, 1, 100))
    bound = (lambda v: clip(v, low, high)) if low is not None else (lambda v: v)
    at = F.timestamp_micros(F.round((seconds("last_ts") + F.col("h") * F.col("step_s")) * 1e6).cast("long")).cast("timestamp_ntz")
    keep = [c for c in params.columns if c in (E, "tag", "series")]
    return rows.select(*keep, "h", at.alias("ts"), bound(y).alias("forecast"), bound(y - Z95 * sd).alias("low"), bound(y + Z95 * sd).alias("high"), sd.alias("sd"))


def holdout(series: DataFrame, share: float = 0.2) -> DataFrame:
    """Errors of the closed form on the last part of each series."""
    w = W.partitionBy(E).orderBy("ts")
    n = F.count("*").over(W.partitionBy(E))
    x = series.where("y is not null").withColumns({"i": F.row_number().over(w), "n": n}).withColumn("cut", F.floor(F.col("n") * (1 - share)))
    params = fit(x.where("i <= cut").select(E, "ts", "y"))
    test = x.where("i > cut").join(params.select(E, "mu", "phi", "last_y"), E).withColumn("f", F.col("mu") + (F.col("last_y") - F.col("mu")) * F.pow("phi", (F.col("i") - F.col("cut")).cast("double")))
    e = F.col("y") - F.col("f")
    return test.groupBy(E).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.when(F.abs("y") > 1e-9, F.abs(e / F.col("y")))) * 100).alias("mape"), F.count("*").alias("n_test"))


def failure(points: DataFrame, threshold: float = 70.0) -> DataFrame:
    """First steps at which the forecast, and its band, cross the threshold; confidence falls with the band's width."""
    first = lambda c: F.min(F.when(F.col(c) <= threshold, F.struct("h", "ts")))
    got = points.groupBy(E).agg(first("forecast").alias("f"), first("low").alias("l"), first("high").alias("u"), F.max("h").alias("horizon"), F.avg(F.col("high") - F.col("low")).alias("width"))
    return got.select(E, F.coalesce("f.h", "horizon").cast("double").alias("rul_steps"), F.coalesce("l.h", "horizon").cast("double").alias("rul_low"), F.coalesce("u.h", "horizon").cast("double").alias("rul_high"), F.col("f.ts").alias("failure_ts"), F.col("f.h").isNotNull().alias("crossed"), clip(1 - F.col("width") / 100, 0.1, 1.0).alias("confidence"))


def failure_probability(points: DataFrame, threshold: float = 70.0) -> DataFrame:
    """P(health <= threshold) at each step, widened by the horizon, with five levels of risk."""
    p = norm_cdf_sql((F.lit(threshold) - F.col("forecast")) / F.greatest(F.col("sd"), F.lit(1e-6)))
    risk = F.when(p >= 0.8, "CRITICAL").when(p >= 0.6, "HIGH").when(p >= 0.4, "MEDIUM").when(p >= 0.2, "LOW").otherwise("MINIMAL")
    return points.select(E, "h", "ts", "forecast", p.alias("probability"), risk.alias("risk"))


def maintenance_window(probabilities: DataFrame, start: float = 0.2, end: float = 0.5, buffer_steps: int = 0) -> DataFrame:
    """From the first step at which failure is likely enough to plan for, to the first at which it must be done."""
    first = lambda p: F.min(F.when(F.col("probability") >= p, F.col("h")))
    got = probabilities.groupBy(E).agg(first(start).alias("window_start"), first(end).alias("window_end"), F.max("probability").alias("max_probability"))
    return got.withColumn("window_start", F.when(F.col("window_start").isNotNull(), F.greatest(F.lit(0), F.col("window_start") - buffer_steps)))


def exponential(series: DataFrame, horizon: int, last: int = 50, rate: tuple[float, float] = (0.001, 0.1)) -> DataFrame:
    """Decay by the slope of the logarithm over the last rows, the rate within bounds."""
    w = W.partitionBy(E).orderBy(F.desc("ts"))
    x = series.where("y > 0").withColumn("k", F.row_number().over(w)).where(F.col("k") <= last)
    got = x.groupBy(E).agg(F.regr_slope(F.ln("y"), -F.col("k").cast("double")).alias("s"), F.max_by("y", "ts").alias("y0"))
    lam = clip(-F.coalesce("s", F.lit(0.0)), *rate)
    return got.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(E, "h", lam.alias("rate"), (F.col("y0") * F.exp(-lam * F.col("h"))).alias("forecast"))


def quadratic(series: DataFrame, horizon: int) -> DataFrame:
    """Least-squares parabola by Cramer's rule on power sums, the time scaled to [0, 1]; everything stays in the JVM."""
    w = W.partitionBy(E).orderBy("ts")
    n_all = F.count("*").over(W.partitionBy(E))
    x = series.where("y is not null").withColumns({"i": F.row_number().over(w) - 1, "n": n_all}).withColumn("t", F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)))
    t = F.col("t")
    s = x.groupBy(E).agg(F.max("n").alias("n"), *[F.sum(F.pow(t, F.lit(float(k)))).alias(f"s{k}") for k in range(5)], *[F.sum(F.pow(t, F.lit(float(k))) * F.col("y")).alias(f"y{k}") for k in range(3)])
    m = [[F.col(f"s{i + j}") for j in range(3)] for i in range(3)]
    v = [F.col(f"y{i}") for i in range(3)]

    def det(a):
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    whole = det(m)
    coef = [F.when(F.abs(whole) > 1e-12, det([[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / whole).otherwise(F.lit(0.0)) for k in range(3)]
    got = s.select(E, "n", *[c.alias(f"c{k}") for k, c in enumerate(coef)]).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    at = (F.col("n") - 1 + F.col("h")) / F.greatest(F.col("n") - 1, F.lit(1))
    return got.select(E, "h", (F.col("c0") + F.col("c1") * at + F.col("c2") * at * at).alias("forecast"))


def ensemble(parts: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the models' forecasts and the variance between them; one model alone is taken as it is."""
    total = sum(weights.values()) or 1.0
    out = None
    for name, df in parts.items():
        one = df.select(E, "h", F.lit(name).alias("model"), "forecast", F.lit(weights.get(name, 0.0) / total).alias("w"))
        out = one if out is None else out.unionByName(one)
    mean = F.sum(F.col("w") * F.col("forecast"))
    return out.groupBy(E, "h").agg(mean.alias("forecast"), (F.sum(F.col("w") * F.col("forecast") * F.col("forecast")) - mean * mean).alias("between_variance"), F.count("*").alias("n_models"))


def causation(long: DataFrame, failures: DataFrame, hours: float = 6.0) -> DataFrame:
    """Detectors within hours of a failure: mean, max, spikes over 3, slope, and the share of mean |z|."""
    met = long.join(failures.where("failure_ts is not null").select(E, "failure_ts"), E).where(F.abs(seconds_between("ts", "failure_ts")) <= hours * 3600)
    a = F.abs("z")
    got = met.groupBy(E, "detector").agg(F.avg(a).alias("mean_z"), F.max(a).alias("max_z"), F.count_if(a > 3).alias("spikes"), F.coalesce(F.regr_slope(a, seconds("ts") / 3600), F.lit(0.0)).alias("slope"))
    total = F.sum("mean_z").over(W.partitionBy(E))
    return got.withColumn("weight", F.when(total > 0, F.col("mean_z") / total).otherwise(0.0))


def patterns(causes: DataFrame) -> DataFrame:
    """Names of what the window shows: spike, drift, correlation break, decay."""
    got = causes.groupBy(E).agg(F.max("max_z").alias("top"), F.max("slope").alias("up"), F.min("slope").alias("down"), F.sum("spikes").alias("spikes"), F.count_if(F.col("mean_z") > 2).alias("wide"))
    why = F.array_compact(F.array(F.when((F.col("top") > 5) | (F.col("spikes") >= 3), "spike"), F.when(F.col("up") > 0.1, "drift"), F.when(F.col("wide") >= 2, "correlation_break"), F.when(F.col("down") < -0.1, "decay")))
    return got.select(E, why.alias("patterns"))


def urgency(rows: DataFrame) -> DataFrame:
    """probability x 50 + a ladder on remaining hours + criticality, times confidence, 100 at most."""
    rul = F.col("rul_hours")
    ladder = F.when(rul < 24, 30).when(rul < 72, 20).when(rul < 168, 10).otherwise(0)
    return rows.withColumn("urgency", F.least(F.lit(100.0), (F.col("probability") * 50 + ladder + F.coalesce("criticality", F.lit(0.0))) * F.col("confidence")))


# What to do about each pattern.
ACTIONS = (("spike", "Inspect the sensor and its wiring", 1), ("drift", "Check calibration and wear", 2), ("correlation_break", "Inspect the coupled parts", 3), ("decay", "Plan a replacement", 4))


def actions(found: DataFrame) -> DataFrame:
    known = found.sparkSession.createDataFrame(list(ACTIONS), "pattern string, action string, priority int")
    return found.select(E, F.explode("patterns").alias("pattern")).join(F.broadcast(known), "pattern").select(E, "pattern", "action", "priority")


def attribution(long: DataFrame, n: int = 10) -> DataFrame:
    """Shares of the latest scores among the first n."""
    top = long.groupBy(E, "detector").agg(F.max_by(F.abs("z"), "ts").alias("z"))
    ranked = top.withColumn("rank", F.row_number().over(W.partitionBy(E).orderBy(F.desc("z"), "detector"))).where(F.col("rank") <= n)
    total = F.sum("z").over(W.partitionBy(E))
    return ranked.withColumn("contribution", F.when(total > 0, F.col("z") / total).otherwise(0.0))
