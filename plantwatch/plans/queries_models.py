"""Calibration, drift, episodes, detectors, regimes, forecasts and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.functions import scalar
from plantwatch.operators import assets, detectors, forecasting, history, regimes, runs, scoring
from plantwatch.operators.tables import drift_events, drift_series, melt
from plantwatch.plans import frames as f
from plantwatch.plans.catalog import query

E = "equip_id"
COLS = list(f.TAGS)


# calibration, fusion, drift


@query("f01_calibration", "SELECT equip_id, tag AS detector, median, scale, q_raw, n, (q_raw - median) / scale AS q_z FROM calib", "median scale q_raw q_z")
def _(s, d):
    return scoring.calibrate(f.long(s, d).where("split = 'train'").withColumnsRenamed({"tag": "detector", "value": "score"}))


@query("f02_calibrated", "SELECT equip_id, ts, detector, z FROM zlong", "z")
def _(s, d):
    return f.z_long(s, d).select(E, "ts", "detector", "z")


_RZ = "(SELECT m.equip_id, m.detector, s.regime_label, m.z AS x FROM melted m JOIN scores s USING (equip_id, ts))"


def _by(keys, least):
    k = ", ".join(keys)
    return f"(SELECT a.*, CASE WHEN mad * 1.4826 >= {least} THEN mad * 1.4826 WHEN sd > {least} THEN sd ELSE 1.0 END AS scale FROM (SELECT {k}, quantile_cont(x, 0.5) AS median, stddev_pop(x) AS sd, quantile_cont(x, 0.98) AS q_raw, count(*) AS n FROM {_RZ} GROUP BY ALL) a JOIN (SELECT {k}, quantile_cont(abs(x - m), 0.5) AS mad FROM (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY {k}) AS m FROM {_RZ}) GROUP BY ALL) b USING ({k}))"


@query("f04_thresholds", f"""SELECT equip_id, detector, CAST(NULL AS INTEGER) AS regime_label, median, scale, q_raw, (q_raw - median) / scale AS q_z FROM {_by(["equip_id", "detector"], 1e-3)}
  UNION ALL SELECT r.equip_id, r.detector, r.regime_label, CASE WHEN r.n > 10 THEN r.median ELSE w.median END, CASE WHEN r.n > 10 THEN r.scale ELSE w.scale END, CASE WHEN r.n > 10 THEN r.q_raw ELSE w.q_raw END, CASE WHEN r.n > 10 THEN (r.q_raw - r.median) / r.scale ELSE (w.q_raw - w.median) / w.scale END FROM {_by(["equip_id", "detector", "regime_label"], 1e-9)} r JOIN {_by(["equip_id", "detector"], 1e-3)} w USING (equip_id, detector)""", "median scale q_raw q_z")  # fmt: skip
def _(s, d):
    sc = f.scores(s, d)
    m = melt(sc).join(sc.select(E, "ts", "regime_label"), [E, "ts"]).withColumnRenamed("z", "score")
    return scoring.threshold_table(scoring.calibrate(m), scoring.calibrate_by_regime(m))


@query("f03_adaptive_clip", "SELECT equip_id, greatest(2.0, least(50.0, max(p) * 1.5)) AS clip_z FROM (SELECT equip_id, detector, quantile_cont(abs(z), 0.99) AS p FROM melted GROUP BY 1, 2) GROUP BY 1", "clip_z")
def _(s, d):
    return scoring.adaptive_clip(melt(f.scores(s, d)), 2.0)


@query("f05_fused", "SELECT equip_id, ts, fused FROM scores", "fused")
def _(s, d):
    return f.scores(s, d).select(E, "ts", "fused")


@query("f07_tuned_limits", "SELECT equip_id, greatest(0.25, least(4.0, 0.5 * greatest(stddev_pop(fused), 1e-3))) AS k_sigma, greatest(2.0, least(12.0, 3.0 * greatest(quantile_cont(fused, 0.95) - quantile_cont(fused, 0.5), 1e-3))) AS h_sigma FROM scores GROUP BY 1", "k_sigma h_sigma")
def _(s, d):
    return scoring.tuned_limits(f.scores(s, d))


_C = """(SELECT equip_id, ts, greatest(p - least(0, min(p) OVER w), n - least(0, min(n) OVER w)) AS cusum, p - least(0, min(p) OVER w) AS cusum_pos, n - least(0, min(n) OVER w) AS cusum_neg FROM (SELECT equip_id, ts, sum(x - 0.5) OVER w AS p, sum(-x - 0.5) OVER w AS n FROM (SELECT equip_id, ts, (fused - avg(fused) OVER (PARTITION BY equip_id)) / stddev_pop(fused) OVER (PARTITION BY equip_id) AS x FROM scores) WINDOW w AS (PARTITION BY equip_id ORDER BY ts)) WINDOW w AS (PARTITION BY equip_id ORDER BY ts))"""
_D = f"""(SELECT c.equip_id, c.ts, cusum AS drift, greatest(-8.0, least(8.0, (cusum - m) / CASE WHEN mad * 1.4826 >= 1e-3 THEN mad * 1.4826 ELSE sd END)) AS cusum_z FROM {_C} c JOIN (SELECT equip_id, quantile_cont(cusum, 0.5) AS m, stddev_pop(cusum) AS sd FROM {_C} GROUP BY 1) a USING (equip_id) JOIN (SELECT equip_id, quantile_cont(abs(cusum - m), 0.5) AS mad FROM (SELECT *, quantile_cont(cusum, 0.5) OVER (PARTITION BY equip_id) AS m FROM {_C}) GROUP BY 1) b USING (equip_id))"""


@query("f09_cusum", f"SELECT equip_id, ts, cusum_pos, cusum_neg, cusum FROM {_C}", "cusum_pos cusum_neg cusum")
def _(s, d):
    sc = f.scores(s, d)
    st = sc.groupBy(E).agg(F.avg("fused").alias("m"), F.stddev_pop("fused").alias("sd"))
    return scoring.cusum(sc.join(st, E).select(E, "ts", ((F.col("fused") - F.col("m")) / F.col("sd")).alias("x"))).drop("x")


@query("f10_drift", f"SELECT equip_id, ts, drift, cusum_z FROM {_D}", "drift cusum_z")
def _(s, d):
    return scoring.drift(f.scores(s, d))


@query("f24_drift_series", f"SELECT equip_id, ts, round_even(cusum_z, 4) AS drift_value FROM {_D}", "drift_value")
def _(s, d):
    return drift_series(scoring.drift(f.scores(s, d)))


@query("w19_drift_events", f"""SELECT equip_id, a AS segment_start, coalesce(b, z) AS segment_end, greatest(v, nv) AS value FROM (SELECT equip_id, run, min(ts) AS a, max(ts) AS z, max(nts) AS b, max(x) AS v, max_by(nx, ts) AS nv FROM (SELECT *, sum(CASE WHEN x > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY equip_id ORDER BY ts) AS run FROM (SELECT equip_id, ts, abs(cusum_z) AS x, lead(ts) OVER (PARTITION BY equip_id ORDER BY ts) AS nts, lead(abs(cusum_z)) OVER (PARTITION BY equip_id ORDER BY ts) AS nx FROM {_D})) WHERE x > 1 GROUP BY 1, 2)""", "value")
def _(s, d):
    return drift_events(scoring.drift(f.scores(s, d)), 1.0)


@query("f06_episodes")
def _(s, d):
    return scoring.episodes(f.scores(s, d), h_sigma=3.0)


@query("f21_named_episodes")
def _(s, d):
    sc = f.scores(s, d)
    return scoring.normalise_episodes(scoring.name_episodes(scoring.episodes(sc, h_sigma=3.0), sc), sc)


_LAB = "(SELECT s.equip_id, s.ts, CAST(count(e.episode_id) > 0 AS INTEGER) AS label FROM scores s LEFT JOIN eps e ON s.equip_id = e.equip_id AND s.ts BETWEEN e.start_ts AND e.end_ts GROUP BY 1, 2)"


@query("f08_tuned_weights", f"""SELECT detector, ap AS average_precision, w / sum(w) OVER () AS weight FROM (SELECT *, greatest(0.05, 0.7 * 0.2 + 0.3 * exp(ap * 2) / sum(exp(ap * 2)) OVER ()) AS w FROM (SELECT detector, sum(CASE WHEN label = 1 THEN tp / rk ELSE 0 END) / sum(label) AS ap FROM (SELECT m.detector, l.label, sum(l.label) OVER w AS tp, row_number() OVER w AS rk FROM melted m JOIN {_LAB} l USING (equip_id, ts) WINDOW w AS (PARTITION BY m.detector ORDER BY m.z DESC, m.equip_id, m.ts)) GROUP BY 1))""", "average_precision weight")
def _(s, d):
    sc = f.scores(s, d)
    return scoring.tune_weights(melt(sc), scoring.episode_labels(sc, f.spans(s, d)), {t: 0.2 for t in COLS})


@query("f11_alert_mode", "SELECT equip_id, slope, p95, volatility, 'FAULT' AS was, CASE WHEN p95 BETWEEN 2.0 AND 5.0 AND abs(slope) > 0.05 AND volatility < 0.3 AND p95 > 3.0 THEN 'DRIFT' ELSE 'FAULT' END AS mode FROM (SELECT equip_id, regr_slope(fused, epoch(ts) / 3600) AS slope, quantile_cont(fused, 0.95) AS p95, 0.0 AS volatility FROM scores GROUP BY 1)", "slope p95 volatility")
def _(s, d):
    st = f.scores(s, d).groupBy(E).agg(F.regr_slope(F.col("fused"), scalar.seconds("ts") / 3600).alias("slope"), F.percentile("fused", 0.95).alias("p95")).withColumn("volatility", F.lit(0.0))
    return scoring.alert_mode(st)


@query("a28_retrain", "SELECT equip_id, r > 0.25 AS retrain, CASE WHEN r > 0.25 THEN 'anomaly rate' ELSE '' END AS reasons FROM (SELECT equip_id, avg(CASE WHEN fused > 0.2 THEN 1 ELSE 0 END) AS r FROM scores GROUP BY 1)")
def _(s, d):
    got = f.scores(s, d).groupBy(E).agg(F.avg((F.col("fused") > 0.2).cast("int")).alias("anomaly_rate"))
    return scoring.retrain_reasons(got.withColumns({"silhouette": F.lit(0.5), "saturation_pct": F.lit(0.0), "episodes_ok": F.lit(True), "config_changed": F.lit(False)}))


@query("f26_auto_tune", "SELECT * FROM (VALUES (0, 'thresholds.clip_z', 8.0, 9.6), (0, 'episodes.k_sigma', 0.5, 0.55)) v(equip_id, param_path, old_value, new_value)", "old_value new_value", base=False)
def _(s, d):
    cfg = s.sql("SELECT 0 AS equip_id, * FROM VALUES ('thresholds.clip_z', 8.0D), ('episodes.k_sigma', 0.5D), ('regimes.k_max', 6.0D) v(param_path, value)")
    return scoring.auto_tune(s.sql("SELECT 0 AS equip_id, 6.0D AS saturation_pct, 0.3D AS anomaly_rate, 0.4D AS silhouette"), cfg)


# detectors


def _ar(where):
    return f"(SELECT l.equip_id, l.tag, l.ts, l.value - m.mu AS x, m.mu FROM long l JOIN (SELECT equip_id, tag, avg(value) AS mu FROM long WHERE {where} GROUP BY 1, 2) m USING (equip_id, tag) WHERE {where})"


_P = f"""(SELECT equip_id, tag, mu, phi, greatest(stddev_pop(x - phi * p), 1e-6) AS sd FROM (SELECT *, greatest(-0.999, least(0.999, sum(x * p) OVER (PARTITION BY equip_id, tag) / sum(p * p) OVER (PARTITION BY equip_id, tag))) AS phi FROM (SELECT *, lag(x) OVER (PARTITION BY equip_id, tag ORDER BY ts) AS p FROM {_ar("split = 'train'")})) WHERE p IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@query("m02_ar1_fit", f"SELECT equip_id, tag, mu, phi, sd FROM {_P}", "mu phi sd")
def _(s, d):
    return detectors.fit_ar1(f.long(s, d).where("split = 'train'"))


_Z = f"(SELECT equip_id, tag, ts, abs(coalesce(x - phi * lag(x) OVER (PARTITION BY equip_id, tag ORDER BY ts), 0.0) / sd) AS z FROM (SELECT l.equip_id, l.tag, l.ts, l.value - p.mu AS x, phi, sd FROM long l JOIN {_P} p USING (equip_id, tag)))"


@query("m03_ar1_score", f"SELECT equip_id, tag, ts, z FROM {_Z}", "z")
def _(s, d):
    rows = f.long(s, d)
    return detectors.score_ar1(rows, detectors.fit_ar1(rows.where("split = 'train'")))


@query("m01_ar1_combined", f"SELECT equip_id, ts, avg(z) AS score FROM {_Z} GROUP BY 1, 2", "score")
def _(s, d):
    rows = f.long(s, d)
    return detectors.combine_tags(detectors.score_ar1(rows, detectors.fit_ar1(rows.where("split = 'train'"))))


def _zw(s, d):
    return f.scores(s, d).select(E, "ts", *[f"{t}_z" for t in COLS], "regime_label")


_ZC = [f"{t}_z" for t in COLS]


@query("m04_mahalanobis", """SELECT s.equip_id, s.ts, sqrt((x * x * (b + l) - 2 * x * y * c + y * y * (a + l)) / ((a + l) * (b + l) - c * c)) AS score FROM (SELECT *, click_z - avg(click_z) OVER () AS x, view_z - avg(view_z) OVER () AS y FROM scores) s, (SELECT var_samp(click_z) AS a, var_samp(view_z) AS b, covar_samp(click_z, view_z) AS c, 1e-3 AS l FROM scores)""", "score")
def _(s, d):
    rows = _zw(s, d)
    return detectors.Mahalanobis(["click_z", "view_z"]).fit(rows).score(rows).select(E, "ts", "score")


@query("m05_pca")
def _(s, d):
    rows = _zw(s, d).drop("regime_label")
    return detectors.Subspace(_ZC, most=2).fit(rows).score(rows).select(E, "ts", "pca_spe", "pca_t2")


# a model for each piece of equipment, fitted on its training rows

_PAIR = ["click", "view"]
_OWN = """(SELECT w.equip_id, w.ts, w.split, w.click - m.mx AS x, w.view - m.my AS y, n, a, b, c FROM (SELECT equip_id, ts, split, coalesce(click, fx) AS click, coalesce(view, fy) AS view FROM wide JOIN (SELECT equip_id, coalesce(quantile_cont(click, 0.5), 0.0) AS fx, coalesce(quantile_cont(view, 0.5), 0.0) AS fy FROM wide WHERE split = 'train' GROUP BY 1) USING (equip_id)) w
  JOIN (SELECT equip_id, count(*) AS n, avg(click) AS mx, avg(view) AS my, var_samp(click) AS a, var_samp(view) AS b, covar_samp(click, view) AS c FROM (SELECT equip_id, split, coalesce(click, fx) AS click, coalesce(view, fy) AS view FROM wide JOIN (SELECT equip_id, coalesce(quantile_cont(click, 0.5), 0.0) AS fx, coalesce(quantile_cont(view, 0.5), 0.0) AS fy FROM wide WHERE split = 'train' GROUP BY 1) USING (equip_id)) WHERE split = 'train' GROUP BY 1) m USING (equip_id) WHERE n >= 20)"""
# in population deviations, whose covariance (n - 1) has n / (n - 1) on its diagonal
_UNIT = f"(SELECT equip_id, ts, split, n, x / sqrt(a * (n - 1) / n) AS u, y / sqrt(b * (n - 1) / n) AS v, c / sqrt(a * b) AS r FROM {_OWN})"


def _own(s, d):
    rows = f.wide(s, d).select(E, "ts", "split", *_PAIR)
    return rows, rows.where("split = 'train'")


@query("m04_mahalanobis_by_equipment", f"SELECT equip_id, ts, sqrt((x * x * (b + 1e-3) - 2 * x * y * c + y * y * (a + 1e-3)) / ((a + 1e-3) * (b + 1e-3) - c * c)) AS score FROM {_OWN}", "score")
def _(s, d):
    rows, train = _own(s, d)
    return assets.score_mahalanobis(rows, assets.fit_mahalanobis(train, _PAIR), _PAIR).where("score is not null").select(E, "ts", "score")


@query("m05_pca_by_equipment", f"SELECT equip_id, ts, (u - sign(r) * v) ^ 2 / 2 AS pca_spe, (u + sign(r) * v) ^ 2 / 2 / (n / (n - 1) * (1 + abs(r))) AS pca_t2 FROM {_UNIT}", "pca_spe pca_t2")
def _(s, d):
    rows, train = _own(s, d)
    return assets.score_subspace(rows, assets.fit_subspace(train, _PAIR, 1), _PAIR, 1).where("pca_spe is not null").select(E, "ts", "pca_spe", "pca_t2")


@query("m08_omr_by_equipment", f"""SELECT equip_id, ts, least(10.0, norm / greatest(sd, 1e-6)) AS omr_z FROM (SELECT *, stddev_pop(norm) FILTER (split = 'train') OVER (PARTITION BY equip_id) AS sd
  FROM (SELECT *, sqrt((u - w * v) ^ 2 + (v - w * u) ^ 2) AS norm FROM (SELECT *, r * n / (n - 1) * n / (n / (n - 1) * n + 1.0) AS w FROM {_UNIT})))""", "omr_z")  # fmt: skip
def _(s, d):
    rows, train = _own(s, d)
    return assets.score_reconstruction(rows, assets.fit_reconstruction(train, _PAIR, "linear"), _PAIR).where("omr_z is not null").select(E, "ts", "omr_z")


@query("m06_iforest")
def _(s, d):
    rows = _zw(s, d)
    return detectors.IsolationForest(_ZC, trees=25).fit(rows).score(rows).select(E, "ts", "iforest")


@query("m07_gmm")
def _(s, d):
    rows = _zw(s, d)
    return detectors.DiagonalMixture(_ZC).fit(rows).score(rows).select(E, "ts", "gmm")


@query("m08_omr")
def _(s, d):
    rows = _zw(s, d)
    return detectors.Reconstruction(_ZC).fit(rows).score(rows).select(E, "ts", "omr_z")


@query("m13_omr_contributions")
def _(s, d):
    from plantwatch.operators.tables import contributions_long

    rows = _zw(s, d)
    return contributions_long(detectors.Reconstruction(_ZC).fit(rows).contributions(rows))


@query("m12_half_space")
def _(s, d):
    rows = _zw(s, d)
    return detectors.half_space_scores(rows, _ZC, [-8.0] * 5, [8.0] * 5, trees=5, height=5)


# regimes


@query("f13_regimes")
def _(s, d):
    rows = _zw(s, d).drop("regime_label")
    return regimes.fit_regimes(rows, _ZC, 2, 3).predict(rows).select(E, "ts", "regime_label")


@query("f16_predict", "SELECT equip_id, ts, CASE WHEN (click_z - 0) ^ 2 + (view_z - 0) ^ 2 <= (click_z - 3) ^ 2 + (view_z - 3) ^ 2 THEN 0 ELSE 1 END AS regime_label FROM scores")
def _(s, d):
    import numpy as np

    return regimes.Regimes(["click_z", "view_z"], np.array([[0.0, 0.0], [3.0, 3.0]]), 1.0, 2).predict(f.scores(s, d).select(E, "ts", "click_z", "view_z")).select(E, "ts", "regime_label")


@query("f17_smooth", """SELECT equip_id, ts, CAST(list_sort([lag(regime_label, 2, a) OVER w, lag(regime_label, 1, a) OVER w, regime_label, lead(regime_label, 1, b) OVER w, lead(regime_label, 2, b) OVER w])[3] AS INTEGER) AS regime_label FROM (SELECT *, first(regime_label) OVER (PARTITION BY equip_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a, last(regime_label) OVER (PARTITION BY equip_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM scores) WINDOW w AS (PARTITION BY equip_id ORDER BY ts)""")
def _(s, d):
    return regimes.smooth(f.scores(s, d).select(E, "ts", "regime_label"))


@query("f18_min_dwell")
def _(s, d):
    return regimes.min_dwell(f.scores(s, d).select(E, "ts", "regime_label"), 3).select(E, "ts", "regime_label")


@query("f19_transients")
def _(s, d):
    return regimes.transients(regimes.rate_of_change(f.scores(s, d), ["click_z", "view_z"]))


# forecasts; the health series of each piece of equipment


def _health(s, d):
    return f.scores(s, d).select(E, "ts", scalar.health("fused").alias("y"))


@query("r01_suitability", """SELECT equip_id, n, CASE WHEN n >= 20 THEN 0.0 + 1.5 * (1 - abs(acf)) + least(1.0, abs(b - a) / sd) ELSE 1e308 END AS score FROM (SELECT equip_id, count(h) AS n, corr(h, p) AS acf, stddev_samp(h) AS sd, avg(h) FILTER (i <= c / 2) AS a, avg(h) FILTER (i > c / 2) AS b FROM (SELECT *, lag(h) OVER (PARTITION BY equip_id ORDER BY ts) AS p, row_number() OVER (PARTITION BY equip_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY equip_id) AS c FROM health) GROUP BY 1)""", "score")
def _(s, d):
    return forecasting.suitability(_health(s, d))


@query("r02_best_series", """SELECT equip_id, n, score, tag AS series FROM (SELECT *, row_number() OVER (PARTITION BY equip_id ORDER BY score, tag) AS r FROM (SELECT equip_id, tag, n, 1.5 * (1 - abs(acf)) + least(1.0, abs(b - a) / sd) AS score FROM (SELECT equip_id, tag, count(value) AS n, corr(value, p) AS acf, stddev_samp(value) AS sd, avg(value) FILTER (i <= c / 2) AS a, avg(value) FILTER (i > c / 2) AS b FROM (SELECT *, lag(value) OVER w AS p, row_number() OVER w AS i, count(*) OVER (PARTITION BY equip_id, tag) AS c FROM long WINDOW w AS (PARTITION BY equip_id, tag ORDER BY ts)) GROUP BY 1, 2))) WHERE r = 1""", "score")
def _(s, d):
    x = f.long(s, d).select(E, F.col("tag").alias("series"), "ts", F.col("value").alias("y"))
    return forecasting.best_series(forecasting.suitability(x, (E, "series")), "none")


@query("r03_step", "SELECT equip_id, quantile_cont(g, 0.5) AS step_s FROM (SELECT equip_id, epoch(ts - lag(ts) OVER (PARTITION BY equip_id ORDER BY ts)) AS g FROM scores) WHERE g > 0 GROUP BY 1", "step_s")
def _(s, d):
    return forecasting.step_seconds(_health(s, d))


_PAR = """(SELECT equip_id, mu, phi, last_y, last_ts, step_s, greatest(stddev_pop(x - phi * p), 1e-6) AS sd FROM (SELECT *, greatest(-0.999, least(0.999, sum(x * p) OVER e / sum(p * p) OVER e)) AS phi, last_value(h) OVER f AS last_y, last_value(ts) OVER f AS last_ts, quantile_cont(g, 0.5) OVER e AS step_s FROM (SELECT equip_id, ts, h, mu, h - mu AS x, lag(h - mu) OVER (PARTITION BY equip_id ORDER BY ts) AS p, epoch(ts - lag(ts) OVER (PARTITION BY equip_id ORDER BY ts)) AS g FROM (SELECT *, avg(h) OVER (PARTITION BY equip_id) AS mu FROM health)) WINDOW e AS (PARTITION BY equip_id), f AS (PARTITION BY equip_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE p IS NOT NULL GROUP BY ALL)"""
_FC = f"""(SELECT equip_id, h, ts, greatest(0.0, least(100.0, y)) AS forecast, greatest(0.0, least(100.0, y - 1.96 * s)) AS low, greatest(0.0, least(100.0, y + 1.96 * s)) AS high, s AS sd FROM (SELECT equip_id, CAST(h AS INTEGER) AS h, last_ts + to_seconds(h * step_s) AS ts, mu + (last_y - mu) * phi ^ h AS y, sd * sqrt(greatest(1.0, least(100.0, (1 - phi ^ (2.0 * h)) / (1 - phi * phi)))) AS s FROM {_PAR}, range(1, 25) r(h)))"""


@query("r04_forecast", f"SELECT equip_id, h, CAST(ts AS TIMESTAMP) AS ts, forecast, low, high, sd FROM {_FC}", "forecast low high sd")
def _(s, d):
    return forecasting.forecast(forecasting.fit(_health(s, d)), 24, low=0.0, high=100.0)


@query("r05_holdout", """SELECT equip_id, avg(abs(h - f)) AS mae, sqrt(avg((h - f) ^ 2)) AS rmse, avg(abs((h - f) / h)) * 100 AS mape, count(*) AS n_test FROM (SELECT t.equip_id, t.h, p.mu + (p.ly - p.mu) * p.phi ^ (t.i - t.c) AS f FROM (SELECT *, row_number() OVER (PARTITION BY equip_id ORDER BY ts) AS i, floor(count(*) OVER (PARTITION BY equip_id) * 0.8) AS c FROM health) t
  JOIN (SELECT equip_id, mu, max_by(h, ts) AS ly, greatest(-0.999, least(0.999, sum(x * p) / sum(p * p))) AS phi FROM (SELECT *, lag(x) OVER (PARTITION BY equip_id ORDER BY ts) AS p FROM (SELECT *, h - avg(h) OVER (PARTITION BY equip_id) AS x, avg(h) OVER (PARTITION BY equip_id) AS mu FROM (SELECT *, row_number() OVER (PARTITION BY equip_id ORDER BY ts) AS i, floor(count(*) OVER (PARTITION BY equip_id) * 0.8) AS c FROM health) WHERE i <= c)) GROUP BY 1, 2) p USING (equip_id) WHERE t.i > t.c) GROUP BY 1""", "mae rmse mape")  # fmt: skip
def _(s, d):
    return forecasting.holdout(_health(s, d))


@query("r07_failure", f"""SELECT equip_id, CAST(coalesce(min(h) FILTER (forecast <= 82), 24) AS DOUBLE) AS rul_steps, CAST(coalesce(min(h) FILTER (low <= 82), 24) AS DOUBLE) AS rul_low, CAST(coalesce(min(h) FILTER (high <= 82), 24) AS DOUBLE) AS rul_high, CAST(arg_min(ts, h) FILTER (forecast <= 82) AS TIMESTAMP) AS failure_ts, count(*) FILTER (forecast <= 82) > 0 AS crossed, greatest(0.1, least(1.0, 1 - avg(high - low) / 100)) AS confidence FROM {_FC} GROUP BY 1""", "rul_steps rul_low rul_high confidence")
def _(s, d):
    return forecasting.failure(forecasting.forecast(forecasting.fit(_health(s, d)), 24, low=0.0, high=100.0), 82.0)


@query("r08_norm_cdf")
def _(s, d):
    return f.scores(s, d).select(E, "ts", scalar.norm_cdf("fused").alias("p"), scalar.norm_cdf_sql("fused").alias("p_sql"))


@query("r15_failure_probability")
def _(s, d):
    return forecasting.failure_probability(forecasting.forecast(forecasting.fit(_health(s, d)), 24, low=0.0, high=100.0))


@query("r09_maintenance_window")
def _(s, d):
    return forecasting.maintenance_window(forecasting.failure_probability(forecasting.forecast(forecasting.fit(_health(s, d)), 24, low=0.0, high=100.0)))


@query("r11_exponential", "SELECT equip_id, CAST(r.h AS INTEGER) AS h, lam AS rate, y0 * exp(-lam * r.h) AS forecast FROM (SELECT equip_id, greatest(0.001, least(0.1, -regr_slope(ln(h), -CAST(k AS DOUBLE)))) AS lam, max_by(h, ts) AS y0 FROM (SELECT *, row_number() OVER (PARTITION BY equip_id ORDER BY ts DESC) AS k FROM health) WHERE k <= 50 GROUP BY 1), range(1, 13) r(h)", "rate forecast")
def _(s, d):
    return forecasting.exponential(_health(s, d), 12)


# by orthogonal parts: the mean, the slope, and what the square of time has beyond them
@query("r12_quadratic", """SELECT equip_id, CAST(r.h AS INTEGER) AS h, my + sl * (u - mt) + cq * (u * u - mq - b * (u - mt)) AS forecast FROM (SELECT *, (n - 1 + h) / greatest(n - 1, 1) AS u FROM (SELECT equip_id, n, mt, my, mq, sl, b, sum((q - mq - b * (t - mt)) * y) / sum((q - mq - b * (t - mt)) ^ 2) AS cq
  FROM (SELECT *, avg(t) OVER e AS mt, avg(y) OVER e AS my, avg(q) OVER e AS mq, regr_slope(y, t) OVER e AS sl, regr_slope(q, t) OVER e AS b FROM (SELECT *, t * t AS q FROM (SELECT equip_id, h AS y, count(*) OVER (PARTITION BY equip_id) AS n, (row_number() OVER (PARTITION BY equip_id ORDER BY ts) - 1) / greatest(count(*) OVER (PARTITION BY equip_id) - 1, 1) AS t FROM health)) WINDOW e AS (PARTITION BY equip_id)) GROUP BY 1, 2, 3, 4, 5, 6, 7) CROSS JOIN (SELECT unnest(range(1, 13)) AS h)) r""", "forecast")  # fmt: skip
def _(s, d):
    return forecasting.quadratic(_health(s, d), 12)


@query("r13_ensemble")
def _(s, d):
    x = _health(s, d)
    return forecasting.ensemble({"ar1": forecasting.forecast(forecasting.fit(x), 12), "decay": forecasting.exponential(x, 12), "quadratic": forecasting.quadratic(x, 12)}, {"ar1": 0.5, "decay": 0.3, "quadratic": 0.2})


_CAUSE = "(SELECT m.equip_id, detector, avg(abs(z)) AS mean_z, max(abs(z)) AS max_z, count(*) FILTER (abs(z) > 3) AS spikes, coalesce(regr_slope(abs(z), epoch(m.ts) / 3600), 0.0) AS slope FROM melted m JOIN (SELECT equip_id, max(ts) AS ft FROM scores GROUP BY 1) t USING (equip_id) WHERE abs(epoch(m.ts - ft)) <= 21600 GROUP BY 1, 2)"


def _causes(s, d):
    sc = f.scores(s, d)
    return forecasting.causation(melt(sc), sc.groupBy(E).agg(F.max("ts").alias("failure_ts")))


@query("r16_causation", f"SELECT *, mean_z / sum(mean_z) OVER (PARTITION BY equip_id) AS weight FROM {_CAUSE}", "mean_z max_z slope weight")
def _(s, d):
    return _causes(s, d)


@query("r20_actions")
def _(s, d):
    return forecasting.actions(forecasting.patterns(_causes(s, d)))


@query("r18_urgency", "SELECT * FROM (VALUES (1, 0.5, 20.0, 10.0, 0.9, 58.5), (2, 0.9, 100.0, NULL, 1.0, 55.0), (3, 1.0, 1.0, 50.0, 1.0, 100.0)) v(equip_id, probability, rul_hours, criticality, confidence, urgency)", "probability rul_hours criticality confidence urgency", base=False)
def _(s, d):
    return forecasting.urgency(s.sql("SELECT * FROM VALUES (1, 0.5D, 20.0D, 10.0D, 0.9D), (2, 0.9D, 100.0D, CAST(null AS DOUBLE), 1.0D), (3, 1.0D, 1.0D, 50.0D, 1.0D) v(equip_id, probability, rul_hours, criticality, confidence)"))


# cold starts


@query("t06_cold_window", "SELECT equip_id, min(ts) AS window_start, quantile_cont(g, 0.5) AS step_s, CAST(ceil(quantile_cont(g, 0.5) * 500 * 1.2 / 60) AS BIGINT) AS minutes, min(ts) + to_minutes(CAST(ceil(quantile_cont(g, 0.5) * 500 * 1.2 / 60) AS BIGINT)) AS window_end FROM (SELECT equip_id, ts, epoch(ts - lag(ts) OVER (PARTITION BY equip_id ORDER BY ts)) AS g FROM scores) GROUP BY 1", "step_s")
def _(s, d):
    return runs.cold_window(f.scores(s, d).select(E, "ts"))


@query("t05_coldstart", "SELECT equip_id, count(*) + 10 AS rows, CAST(2 AS BIGINT) AS attempts, CASE WHEN count(*) + 10 >= 500 THEN 'COMPLETE' ELSE 'IN_PROGRESS' END AS status FROM scores GROUP BY 1")
def _(s, d):
    state = s.range(4).select(F.col("id").cast("int").alias(E), F.lit(10).cast("long").alias("rows"), F.lit(1).cast("long").alias("attempts"))
    return runs.coldstart(state, f.scores(s, d))


@query("x09_content", None)
def _(s, d):
    return runs.data_signature(f.table(s, d, "nation"))


@query("s02_split", "SELECT equip_id, split, count(*) AS n_rows, min(ts) AS t0, max(ts) AS t1 FROM split GROUP BY 1, 2")
def _(s, d):
    from plantwatch.sources.readers import load_meta

    return load_meta(history.split_ratio(f.scores(s, d).select(E, "ts")))
