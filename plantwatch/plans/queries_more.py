"""Further operators: sinks, runs, pairs, bins, forecasts by tag."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plantwatch.functions import scalar
from plantwatch.operators import cleaning, detectors, forecasting, history, regimes, rolling, runs, scoring, tables
from plantwatch.plans import frames as f
from plantwatch.plans.catalog import query
from plantwatch.plans.queries_models import _PAR
from plantwatch.sources import sinks

E = "equip_id"
COLS = list(f.TAGS)
_Z = [f"{t}_z" for t in COLS]


@query("j05_left_join", "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey", base=False)
def _(s, d):
    c = f.table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return f.table(s, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", "c_name")


@query("n02_full_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS n_a, b.n AS n_b FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 3 GROUP BY 1) b ON a.k = b.k", base=False)
def _(s, d):
    a = f.table(s, d, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_a"))
    b = f.table(s, d, "supplier").where("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_b"))
    return a.join(b, "k", "full")


@query("j14_side_by_side", "SELECT equip_id, ts, click + view AS total, click - view AS gap FROM wide WHERE click IS NOT NULL AND view IS NOT NULL", "total gap")
def _(s, d):
    return f.wide(s, d).where("click is not null and view is not null").select(E, "ts", (F.col("click") + F.col("view")).alias("total"), (F.col("click") - F.col("view")).alias("gap"))


@query("s24_melted", "SELECT equip_id, ts, detector, z FROM melted", "z")
def _(s, d):
    return tables.melt(f.scores(s, d))


@query("s27_regime_episodes", "SELECT equip_id, regime_label, start_ts, end_ts, n_rows FROM rruns")
def _(s, d):
    from plantwatch.operators.islands import islands

    return islands(f.scores(s, d), "regime_label").select(E, "regime_label", "start_ts", "end_ts", "n_rows")


@query("s29_pca_loadings")
def _(s, d):
    pca = detectors.Subspace(_Z, most=2).fit(f.scores(s, d))
    return sinks.pca_rows(s, pca, 0, "r1")[1]


@query("s30_pca_metrics")
def _(s, d):
    rows = f.scores(s, d).select(E, "ts", *_Z)
    pca = detectors.Subspace(_Z, most=2).fit(rows)
    return sinks.pca_metrics(pca.score(rows), pca.needed())


@query("s44_register", "SELECT CAST(n_nationkey AS INTEGER) AS equip_id, n_name AS code, CASE WHEN n_nationkey < 3 THEN 'new' ELSE 'old' END AS db FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 10, 'Z1', 'new'", base=False)
def _(s, d):
    old = f.table(s, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("int").alias(E), F.col("n_name").alias("code"), F.lit("old").alias("db"))
    new = f.table(s, d, "nation").where("n_nationkey < 3").select(F.col("n_name").alias("code"), F.lit("new").alias("db")).unionByName(s.sql("SELECT 'Z1' AS code, 'new' AS db"))
    return runs.register(old, new)


@query("s46_finalise", "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'OK' ELSE o_orderstatus END AS outcome FROM orders", base=False)
def _(s, d):
    old = f.table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("outcome"))
    return runs.finalise(old, old.where("run_id % 2 = 0").select("run_id", F.lit("OK").alias("outcome")))


@query("p07_impute_median", "SELECT w.equip_id, ts, coalesce(view, m) AS view FROM wide w JOIN (SELECT equip_id, quantile_cont(view, 0.5) AS m FROM wide GROUP BY 1) USING (equip_id)", "view")
def _(s, d):
    return cleaning.impute_finite(f.wide(s, d).select(E, "ts", "view"), ["view"])


@query("p15_train_statistics", "SELECT equip_id, quantile_cont(click, 0.5) AS click_med, avg(click) AS click_mean, stddev_samp(click) AS click_std FROM wide WHERE split = 'train' GROUP BY 1", "click_med click_mean click_std")
def _(s, d):
    return cleaning.train_statistics(f.wide(s, d), ["click"])


@query("p20_downcast", "SELECT CAST(event_id AS INTEGER) AS event_id FROM events", base=False)
def _(s, d):
    return cleaning.downcast(f.table(s, d, "events").select("event_id"))


def _lagged(a: str, b: str, k: int) -> str:
    """Pearson's r of a with b, k rows earlier, over the last eight rows, as the definition has it."""
    pair = f"l{k}_{b}"
    x, y = f"CASE WHEN {pair} IS NOT NULL THEN {a} END", pair
    cov, sx, sy = f"covar_pop({x}, {y}) OVER w", f"stddev_pop({x}) OVER w", f"stddev_pop({y}) OVER w"
    return f"CASE WHEN {sx} > 1e-12 AND {sy} > 1e-12 THEN greatest(-1.0, least(1.0, ({cov}) / (({sx}) * ({sy})))) END AS {a}_{b}_lag{k}"


_PAIRS = [("click", "view"), ("click", "error"), ("view", "error")]
_LAGS = ", ".join(f"lag({b}, {k}) OVER (PARTITION BY equip_id ORDER BY ts) AS l{k}_{b}" for b in ("view", "error") for k in (0, 1))


@query("w13_unique_lag_pairs", f"SELECT equip_id, ts, {', '.join(_lagged(a, b, k) for a, b in _PAIRS for k in (0, 1))} FROM (SELECT *, {_LAGS} FROM (SELECT equip_id, ts, {', '.join(f'coalesce({t}, 0.0) AS {t}' for t in COLS)} FROM wide)) WINDOW w AS (PARTITION BY equip_id ORDER BY ts ROWS 7 PRECEDING)", " ".join(f"{a}_{b}_lag{k}" for a, b in _PAIRS for k in (0, 1)))
def _(s, d):
    got = f.wide(s, d).fillna(0.0, COLS)
    pairs = rolling.lag_pairs(got, ["click", "view", "error"], 1, 8, unique=True)
    return pairs


@query("x03_bins", "SELECT equip_id, zone, count(*) AS n FROM health GROUP BY 1, 2")
def _(s, d):
    return f.scores(s, d).groupBy(E, scalar.zone(scalar.health("fused")).alias("zone")).agg(F.count("*").alias("n"))


@query("x13_map_lookup", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS code FROM events", base=False)
def _(s, d):
    codes = F.create_map(F.lit("click"), F.lit(1), F.lit("view"), F.lit(2))
    return f.table(s, d, "events").select("event_id", F.try_element_at(codes, F.col("event_type")).alias("code"))


@query("x01_maths", "SELECT equip_id, ts, sqrt(abs(fused)) AS a, exp(fused) AS b, ln(1 + abs(fused)) AS c, fused ^ 2 AS d, CAST(sign(fused) AS DOUBLE) AS e, greatest(-0.5, least(0.5, fused)) AS f, round_even(fused, 2) AS g FROM scores", "a b c d e f g")
def _(s, d):
    x = F.col("fused")
    return f.scores(s, d).select(E, "ts", F.sqrt(F.abs(x)).alias("a"), F.exp(x).alias("b"), F.log1p(F.abs(x)).alias("c"), F.pow(x, F.lit(2.0)).alias("d"), F.signum(x).alias("e"), scalar.clip(x, -0.5, 0.5).alias("f"), F.bround(x, 2).alias("g"))


@query("a22_regime_summary", "SELECT equip_id, count(DISTINCT regime_label) AS n_regimes, min(regime_label) AS first_label, max(regime_label) AS last_label FROM scores GROUP BY 1")
def _(s, d):
    return regimes.regime_health(f.scores(s, d)).groupBy(E).agg(F.count_distinct("regime_label").alias("n_regimes"), F.min("regime_label").alias("first_label"), F.max("regime_label").alias("last_label"))


@query("a31_before_after", "SELECT tag, avg(value) FILTER (split = 'score') - avg(value) FILTER (split = 'train') AS change, count(*) AS n FROM long GROUP BY 1", "change")
def _(s, d):
    v = lambda x: F.avg(F.when(F.col("split") == x, F.col("value")))
    return f.long(s, d).groupBy("tag").agg((v("score") - v("train")).alias("change"), F.count("*").alias("n"))


@query("m14_weighted_timeline", "SELECT equip_id, ts, round_even(click_z, 4) AS omr_z, 0.1 AS weight FROM scores", "omr_z weight")
def _(s, d):
    return f.scores(s, d).select(E, "ts", F.bround("click_z", 4).alias("omr_z"), F.lit(0.1).alias("weight"))


@query("k06_top_contributors")
def _(s, d):
    rows = f.scores(s, d).select(E, "ts", *_Z)
    ts = rows.agg(F.max("ts")).first()[0]
    return detectors.top_contributors(detectors.Reconstruction(_Z).fit(rows).contributions(rows), str(ts), 3)


@query("f12_basis")
def _(s, d):
    rows = f.scores(s, d).select(E, "ts", *_Z)
    return regimes.basis(rows, _Z, detectors.Subspace(_Z).fit(rows), ["click_z"])


@query("r10_trend_forecast", f"""SELECT equip_id, CAST(r.h AS INTEGER) AS h, mu + (last_y - mu) * phi ^ r.h + 0.1 * slope * r.h * step_s AS forecast FROM {_PAR} p JOIN (SELECT equip_id, regr_slope(h, epoch(ts)) AS slope FROM health GROUP BY 1) USING (equip_id), range(1, 13) r(h)""", "forecast")
def _(s, d):
    y = f.scores(s, d).select(E, "ts", scalar.health("fused").alias("y"))
    return forecasting.forecast(forecasting.fit(y), 12, trend=0.1).select(E, "h", "forecast")


@query("r22_forecast_by_tag")
def _(s, d):
    worst = tables.worst_tags(f.context(s, d), 3)
    y = f.long(s, d).join(F.broadcast(worst.select("tag")), "tag", "left_semi").select(E, "tag", "ts", F.col("value").alias("y"))
    return forecasting.forecast(forecasting.fit(y, (E, "tag")), 6)


@query("r19_maintenance_buffer")
def _(s, d):
    y = f.scores(s, d).select(E, "ts", scalar.health("fused").alias("y"))
    p = forecasting.failure_probability(forecasting.forecast(forecasting.fit(y), 24, low=0.0, high=100.0))
    return forecasting.maintenance_window(p, 0.1, 0.5, 4)


@query("r14_model_weights", "SELECT equip_id, 1 - sum((h - m) ^ 2) / sum((h - a) ^ 2) AS r2 FROM (SELECT equip_id, h, avg(h) OVER (PARTITION BY equip_id ORDER BY ts ROWS 4 PRECEDING) AS m, avg(h) OVER (PARTITION BY equip_id) AS a FROM health) GROUP BY 1", "r2")
def _(s, d):
    h = f.scores(s, d).select(E, "ts", scalar.health("fused").alias("h"))
    got = h.withColumns({"m": F.avg("h").over(rolling.frame(5)), "a": F.avg("h").over(W.partitionBy(E))})
    return got.groupBy(E).agg((1 - F.sum(F.pow(F.col("h") - F.col("m"), F.lit(2.0))) / F.sum(F.pow(F.col("h") - F.col("a"), F.lit(2.0)))).alias("r2"))


@query("f27_condition", None)
def _(s, d):
    rows = f.scores(s, d).select(E, "ts", *_Z)
    model = detectors.Mahalanobis(_Z).fit(rows)
    return s.createDataFrame([(float(math.log10(model.condition)), float(model.reg))], "log_condition double, reg double")


@query("t07_baseline_tail", "SELECT equip_id, ts, fused FROM (SELECT s.*, max(ts) OVER (PARTITION BY equip_id) AS t1, row_number() OVER (PARTITION BY equip_id ORDER BY ts DESC) AS n FROM scores s) WHERE ts >= t1 - INTERVAL 72 HOUR AND n <= 50", "fused")
def _(s, d):
    rows = f.scores(s, d).select(E, "ts", "fused").withColumn("seq", F.lit(0))
    return history.tail_buffer(rows, 72, 50).drop("seq")


@query("t10_sessions", "SELECT equip_id, min(ts) AS start_ts, max(ts) + INTERVAL 3 HOUR AS end_ts, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 3 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY equip_id ORDER BY ts) AS g FROM (SELECT equip_id, ts, lag(ts) OVER (PARTITION BY equip_id ORDER BY ts) AS p FROM scores WHERE fused > 0.3)) GROUP BY equip_id, g")
def _(s, d):
    rows = f.scores(s, d).where("fused > 0.3").select(E, F.col("ts").cast("timestamp").alias("ts"))
    got = rows.groupBy(E, F.session_window("ts", "3 hours").alias("w")).agg(F.count("*").alias("n"))
    return got.select(E, F.col("w.start").cast("timestamp_ntz").alias("start_ts"), F.col("w.end").cast("timestamp_ntz").alias("end_ts"), "n")


@query("d_episode_labels", "SELECT s.equip_id, s.ts, CAST(count(e.episode_id) > 0 AS INTEGER) AS label FROM scores s LEFT JOIN eps e ON s.equip_id = e.equip_id AND s.ts BETWEEN e.start_ts AND e.end_ts GROUP BY 1, 2")
def _(s, d):
    sc = f.scores(s, d)
    return scoring.episode_labels(sc, f.spans(s, d))
