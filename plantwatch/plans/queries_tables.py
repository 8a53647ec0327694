"""Derived tables over the score frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantwatch.functions.scalar import health, zone
from plantwatch.operators import cleaning, scoring
from plantwatch.operators import tables as T
from plantwatch.plans import frames as f
from plantwatch.plans.catalog import query

E = "equip_id"


@query("a06_zones_by_day", """SELECT d.equip_id, d.period_start, z.health_zone, coalesce(n.c, 0) * 100.0 / d.total_points AS zone_pct, coalesce(n.c, 0) AS zone_count, d.total_points
  FROM (SELECT equip_id, date_trunc('day', ts)::TIMESTAMP AS period_start, count(*) AS total_points FROM health GROUP BY 1, 2) d CROSS JOIN (VALUES ('GOOD'), ('WATCH'), ('ALERT')) z(health_zone)
  LEFT JOIN (SELECT equip_id, date_trunc('day', ts)::TIMESTAMP AS period_start, zone, count(*) AS c FROM health GROUP BY 1, 2, 3) n ON n.equip_id = d.equip_id AND n.period_start = d.period_start AND n.zone = z.health_zone""", "zone_pct")  # fmt: skip
def _(s, d):
    return T.zones_by_day(f.scores(s, d))


@query("w26_health_timeline", "SELECT equip_id, ts, round_even(h, 2) AS health_index, zone AS health_zone, round_even(fused, 4) AS fused_z FROM health", "health_index fused_z")
def _(s, d):
    return T.health_timeline(f.scores(s, d))


@query("f23_regime_timeline", "SELECT equip_id, ts, regime_label, regime_state FROM scores")
def _(s, d):
    return T.regime_timeline(f.scores(s, d))


_NOW = "(SELECT equip_id, detector, abs(z) AS z FROM melted JOIN (SELECT equip_id, max(ts) AS ts FROM scores GROUP BY 1) USING (equip_id, ts))"


@query("k04_contributions_now", f"SELECT equip_id, detector, row_number() OVER (PARTITION BY equip_id ORDER BY z DESC, detector) AS rank_position, z / sum(z) OVER (PARTITION BY equip_id) * 100 AS contribution_pct, z FROM {_NOW}", "contribution_pct z")
def _(s, d):
    return T.contributions_now(f.scores(s, d))


@query("k03_rank_now", f"SELECT equip_id, detector, row_number() OVER (PARTITION BY equip_id ORDER BY z DESC, detector) AS rank_position FROM {_NOW}")
def _(s, d):
    return T.contributions_now(f.scores(s, d)).select(E, "detector", "rank_position")


@query("k05_contribution_timeline", "SELECT equip_id, ts, detector, abs(z) / t * 100 AS contribution_pct FROM melted JOIN (SELECT equip_id, ts, sum(abs(z)) AS t FROM melted GROUP BY 1, 2) USING (equip_id, ts) WHERE t > 0", "contribution_pct")
def _(s, d):
    return T.contribution_timeline(f.scores(s, d))


@query("p21_every_nth", "SELECT equip_id, ts, fused FROM (SELECT equip_id, ts, fused, row_number() OVER (PARTITION BY equip_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY equip_id) AS n FROM scores) WHERE i % greatest(1, CAST(floor(n / 100.0) AS BIGINT)) = 0", "fused")
def _(s, d):
    return cleaning.every_nth(f.scores(s, d).select(E, "ts", "fused"), 100)


@query("a04_defect_summary", """SELECT a.equip_id, CASE WHEN c >= 85 THEN 'HEALTHY' WHEN c >= 70 THEN 'CAUTION' ELSE 'ALERT' END AS status, CASE WHEN c >= 85 THEN 'LOW' WHEN c >= 70 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, c AS current_health, avg_health, min_health, detector AS worst_sensor, good_count, watch_count, alert_count, coalesce(e.n, 0) AS episode_count
  FROM (SELECT equip_id, max_by(h, ts) AS c, avg(h) AS avg_health, min(h) AS min_health, count(*) FILTER (zone = 'GOOD') AS good_count, count(*) FILTER (zone = 'WATCH') AS watch_count, count(*) FILTER (zone = 'ALERT') AS alert_count FROM health GROUP BY 1) a
  JOIN (SELECT equip_id, detector FROM %s QUALIFY row_number() OVER (PARTITION BY equip_id ORDER BY z DESC, detector) = 1) w USING (equip_id) LEFT JOIN (SELECT equip_id, count(*) AS n FROM eps GROUP BY 1) e USING (equip_id)""" % _NOW, "current_health avg_health min_health")  # fmt: skip
def _(s, d):
    return T.defect_summary(f.scores(s, d), f.spans(s, d))


@query("a05_sensor_defects", """SELECT equip_id, detector, detector AS family, CASE WHEN p > 20 THEN 'CRITICAL' WHEN p > 10 THEN 'HIGH' WHEN p > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity, violation_count, p AS violation_pct, max_z, avg_z, current_z, current_z > 2 AS active
  FROM (SELECT equip_id, detector, count(*) FILTER (abs(z) > 2) AS violation_count, count(*) FILTER (abs(z) > 2) * 100.0 / count(*) AS p, max(abs(z)) AS max_z, avg(abs(z)) AS avg_z, max_by(abs(z), ts) AS current_z FROM melted GROUP BY 1, 2)""", "violation_pct max_z avg_z current_z")  # fmt: skip
def _(s, d):
    return T.sensor_defects(f.scores(s, d))


@query("a07_anomalies_by_day", "SELECT equip_id, date_trunc('day', ts)::TIMESTAMP AS period_start, detector, avg(CASE WHEN abs(z) > 2 THEN 1 ELSE 0 END) * 100 AS anomaly_rate_pct, max(abs(z)) AS max_z, avg(abs(z)) AS avg_z, count(*) AS points FROM melted GROUP BY 1, 2, 3", "anomaly_rate_pct max_z avg_z")
def _(s, d):
    return T.anomalies_by_day(f.scores(s, d))


@query("a01_calibration_summary", "SELECT equip_id, detector, avg(abs(z)) AS mean_z, stddev_samp(abs(z)) AS std_z, quantile_cont(abs(z), 0.95) AS p95_z, quantile_cont(abs(z), 0.99) AS p99_z, 8.0 AS clip_z, avg(CASE WHEN abs(z) >= 8 THEN 1 ELSE 0 END) * 100 AS saturation_pct FROM melted GROUP BY 1, 2", "mean_z std_z p95_z p99_z clip_z saturation_pct")
def _(s, d):
    return T.calibration_summary(f.scores(s, d), 8.0)


_PAIRS = [(a, b) for i, a in enumerate(f.TAGS) for b in f.TAGS[i + 1 :]]


@query("a02_detector_correlation", " UNION ALL ".join(f"SELECT equip_id, '{a}_z' AS detector_a, '{b}_z' AS detector_b, corr({a}_z, {b}_z) AS pearson_r FROM scores GROUP BY 1" for a, b in _PAIRS), "pearson_r")
def _(s, d):
    return T.detector_correlation(f.scores(s, d))


@query("a03_fusion_quality", """SELECT coalesce(g.equip_id, w.equip_id) AS equip_id, coalesce(g.detector, w.detector) AS detector, coalesce(w.weight, 0.0) AS weight, g.points IS NOT NULL AS present, mean_z, max_z, coalesce(points, 0) AS points
  FROM (SELECT equip_id, detector, avg(z) AS mean_z, max(z) AS max_z, count(*) AS points FROM melted GROUP BY 1, 2) g
  FULL JOIN (SELECT * FROM (SELECT DISTINCT equip_id FROM scores) CROSS JOIN (VALUES ('click', 0.5), ('view', 0.25), ('omr', 0.25)) v(detector, weight)) w ON g.equip_id = w.equip_id AND g.detector = w.detector""", "weight mean_z max_z")  # fmt: skip
def _(s, d):
    return T.fusion_quality(f.scores(s, d), s.createDataFrame([("click", 0.5), ("view", 0.25), ("omr", 0.25)], "detector string, weight double"))


@query("a13_health_histogram", """SELECT t.equip_id, (r.b * 10 - 10) || '-' || (r.b * 10) AS health_bin, coalesce(n, 0) AS record_count, coalesce(n, 0) * 100.0 / total AS percentage
  FROM (SELECT equip_id, count(*) AS total FROM health GROUP BY 1) t CROSS JOIN range(1, 11) r(b) LEFT JOIN (SELECT equip_id, least(10, CAST(floor(h / 10) AS BIGINT) + 1) AS b, count(*) AS n FROM health GROUP BY 1, 2) g ON g.equip_id = t.equip_id AND g.b = r.b""", "percentage")  # fmt: skip
def _(s, d):
    return T.health_histogram(f.scores(s, d))


@query("a14_weekly_profile", "SELECT equip_id, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour, avg(fused) AS fused_mean, quantile_cont(fused, 0.9) AS fused_p90, quantile_cont(fused, 0.95) AS fused_p95, count(*) AS n FROM scores GROUP BY 1, 2, 3", "fused_mean fused_p90 fused_p95")
def _(s, d):
    return T.weekly_profile(f.scores(s, d))


@query("a15_health_by_day", """SELECT equip_id, date_trunc('day', ts)::TIMESTAMP AS bucket_start, quantile_cont(fused, 0.5) AS fused_p50, quantile_cont(fused, 0.75) AS fused_p75, quantile_cont(fused, 0.9) AS fused_p90, quantile_cont(fused, 0.95) AS fused_p95, quantile_cont(h, 0.5) AS health_p50, quantile_cont(h, 0.1) AS health_p10, count(*) AS n FROM health GROUP BY 1, 2""", "fused_p50 fused_p75 fused_p90 fused_p95 health_p50 health_p10")
def _(s, d):
    return T.health_by_hour(f.scores(s, d), "DAY")


@query("a35_date_hour_map", "SELECT equip_id, date_trunc('day', ts)::TIMESTAMP AS day, " + ", ".join(f'avg(fused) FILTER (hour(ts) = {h}) AS "{h}"' for h in range(24)) + " FROM scores GROUP BY 1, 2", " ".join(f'"{h}"' for h in range(24)))
def _(s, d):
    return T.date_hour_map(f.scores(s, d))


@query("a19_since_when", """SELECT equip_id, CASE WHEN n = 0 THEN 'GOOD' ELSE 'ALERT' END AS alert_zone, start_ts, coalesce(epoch(t1 - start_ts) / 3600, 0.0) AS duration_hours, n AS record_count FROM (SELECT equip_id, min(ts) FILTER (fused > 2) AS start_ts, max(ts) AS t1, count(*) FILTER (fused > 2) AS n FROM scores GROUP BY 1)""", "duration_hours")
def _(s, d):
    return T.since_when(f.scores(s, d))


@query("a08_regime_occupancy", "SELECT equip_id, regime_label, count(*) AS record_count, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY equip_id) AS percentage FROM scores GROUP BY 1, 2", "percentage")
def _(s, d):
    return T.regime_occupancy(f.scores(s, d))


@query("a09_regime_transitions", """SELECT equip_id, p AS from_label, regime_label AS to_label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY equip_id) AS prob FROM (SELECT equip_id, regime_label, lag(regime_label) OVER (PARTITION BY equip_id ORDER BY ts) AS p FROM scores) WHERE p <> regime_label GROUP BY 1, 2, 3""", "prob")
def _(s, d):
    return T.regime_transitions(f.scores(s, d))


@query("a10_regime_dwell", "SELECT equip_id, regime_label, count(*) AS runs, avg(epoch(end_ts - start_ts)) AS mean_seconds, quantile_cont(epoch(end_ts - start_ts), 0.5) AS median_seconds, min(epoch(end_ts - start_ts)) AS min_seconds, max(epoch(end_ts - start_ts)) AS max_seconds FROM rruns GROUP BY 1, 2", "mean_seconds median_seconds min_seconds max_seconds")
def _(s, d):
    return T.regime_dwell(f.scores(s, d))


@query("a11_regime_stats", """SELECT g.equip_id, g.regime_label, fused_mean, fused_p90, n * 100.0 / sum(n) OVER (PARTITION BY g.equip_id) AS occupancy_pct, avg_dwell_seconds FROM (SELECT equip_id, regime_label, count(*) AS n, avg(fused) AS fused_mean, quantile_cont(fused, 0.9) AS fused_p90 FROM scores GROUP BY 1, 2) g
  JOIN (SELECT equip_id, regime_label, avg(epoch(coalesce(nx, end_ts) - start_ts)) AS avg_dwell_seconds FROM (SELECT *, lead(start_ts) OVER (PARTITION BY equip_id ORDER BY start_ts) AS nx FROM rruns) GROUP BY 1, 2) r USING (equip_id, regime_label)""", "fused_mean fused_p90 occupancy_pct avg_dwell_seconds")  # fmt: skip
def _(s, d):
    return T.regime_stats(f.scores(s, d))


@query("a12_regime_stability", """UNPIVOT (SELECT equip_id, count(*) * 100.0 / sum(n_rows) AS churn_rate, CAST(count(*) AS DOUBLE) AS total_transitions, avg(n_rows) AS avg_dwell_periods, CAST(quantile_cont(n_rows, 0.5) AS DOUBLE) AS median_dwell_periods FROM rruns GROUP BY 1) ON churn_rate, total_transitions, avg_dwell_periods, median_dwell_periods INTO NAME metric_name VALUE metric_value""", "metric_value")
def _(s, d):
    return T.regime_stability(f.scores(s, d))


@query("w17_zone_changes", "SELECT equip_id, ts, zone AS to_zone, h AS health_index, fused AS fused_z, coalesce(p, 'START') AS from_zone FROM (SELECT *, lag(zone) OVER (PARTITION BY equip_id ORDER BY ts) AS p FROM health) WHERE zone IS DISTINCT FROM p", "health_index fused_z")
def _(s, d):
    return T.zone_changes(f.scores(s, d))


@query("w18_threshold_crossings", "SELECT equip_id, ts, 0.5 AS threshold, fused AS z, CASE WHEN up THEN 'up' ELSE 'down' END AS direction FROM (SELECT *, fused > 0.5 AS up, lag(fused > 0.5) OVER (PARTITION BY equip_id ORDER BY ts) AS was FROM scores) WHERE was IS NULL OR was <> up", "threshold z")
def _(s, d):
    return T.threshold_crossings(f.scores(s, d), 0.5)


@query("w20_alert_age", """SELECT equip_id, zone AS alert_zone, min(a) AS start_ts, sum(epoch(b - a) / 3600) AS duration_hours, CAST(sum(n) AS BIGINT) AS record_count FROM (SELECT equip_id, zone, min(ts) AS a, max(ts) AS b, count(*) AS n FROM (SELECT *, sum(CASE WHEN zone IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY equip_id ORDER BY ts) AS run FROM (SELECT *, lag(zone) OVER (PARTITION BY equip_id ORDER BY ts) AS p FROM health)) GROUP BY equip_id, zone, run) GROUP BY 1, 2""", "duration_hours")
def _(s, d):
    return T.alert_age(f.scores(s, d))


@query("w21_tail_trend", "SELECT equip_id, regr_slope(fused, -n) AS slope FROM (SELECT equip_id, fused, CAST(row_number() OVER (PARTITION BY equip_id ORDER BY ts DESC) AS DOUBLE) AS n FROM scores) WHERE n <= 20 GROUP BY 1", "slope")
def _(s, d):
    return T.tail_trend(f.scores(s, d), "fused")


@query("w22_tail_volatility", "SELECT equip_id, sum(CASE WHEN regime_label <> p THEN 1 ELSE 0 END) / greatest(count(*) - 1, 1) AS volatility FROM (SELECT *, lag(regime_label) OVER (PARTITION BY equip_id ORDER BY ts) AS p FROM (SELECT *, row_number() OVER (PARTITION BY equip_id ORDER BY ts DESC) AS n FROM scores) WHERE n <= 20) GROUP BY 1", "volatility")
def _(s, d):
    return T.tail_volatility(f.scores(s, d))


@query("w23_rolling_share", "SELECT equip_id, ts, avg(CASE WHEN fused > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY equip_id ORDER BY ts ROWS 23 PRECEDING) AS share FROM scores", "share")
def _(s, d):
    return T.rolling_share(f.scores(s, d))


@query("w24_stationarity", "SELECT equip_id, var_samp(m) / var_samp(fused) AS ratio, var_samp(m) / var_samp(fused) < 0.1 AS stationary FROM (SELECT equip_id, fused, CASE WHEN count(*) OVER w = 50 THEN avg(fused) OVER w END AS m FROM scores WINDOW w AS (PARTITION BY equip_id ORDER BY ts ROWS 49 PRECEDING)) GROUP BY 1", "ratio")
def _(s, d):
    return T.stationarity(f.scores(s, d), "fused")


@query("k01_hotspots", """SELECT * FROM (SELECT equip_id, tag, arg_min(ts, (-a, ts)) AS max_ts, max(ts) AS latest_ts, max(a) AS max_abs_z, arg_min(z, (-a, ts)) AS max_signed_z, max_by(a, ts) AS latest_abs_z, arg_min(value, (-a, ts)) AS value_at_peak, max_by(value, ts) AS latest_value, first(train_mean) AS train_mean, first(train_std) AS train_std, count(*) FILTER (a >= 1.5) AS above_warn, count(*) FILTER (a >= 3.0) AS above_alert FROM (SELECT *, abs(z) AS a FROM context) GROUP BY 1, 2) WHERE max_abs_z >= 1.5 QUALIFY row_number() OVER (PARTITION BY equip_id ORDER BY max_abs_z DESC, tag) <= 3""", "max_abs_z max_signed_z latest_abs_z value_at_peak latest_value train_mean train_std")
def _(s, d):
    return T.hotspots(f.context(s, d), top=3)


@query("k02_hotspot_timeline", "SELECT equip_id, ts, tag, rank, abs(z) AS abs_z, z AS signed_z, value, CASE WHEN abs(z) >= 3 THEN 'ALERT' ELSE 'WARN' END AS level FROM (SELECT *, row_number() OVER (PARTITION BY equip_id, ts ORDER BY abs(z) DESC, tag) AS rank FROM context) WHERE rank <= 3 AND abs(z) >= 1.5", "abs_z signed_z value")
def _(s, d):
    return T.hotspot_timeline(f.context(s, d))


@query("k09_worst_tags", "SELECT tag, max(abs(z)) AS max_abs_z FROM context GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", "max_abs_z")
def _(s, d):
    return T.worst_tags(f.context(s, d), 3)


@query("k07_attribution", "SELECT equip_id, detector, z, CAST(rank AS INTEGER) AS rank, z / sum(z) OVER (PARTITION BY equip_id) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY equip_id ORDER BY z DESC, detector) AS rank FROM %s) WHERE rank <= 3" % _NOW, "z contribution")
def _(s, d):
    from plantwatch.operators.forecasting import attribution

    return attribution(T.melt(f.scores(s, d)), 3)


@query("k08_top_rows", "SELECT equip_id, ts, fused FROM scores ORDER BY fused DESC, equip_id, ts LIMIT 20", "fused")
def _(s, d):
    return f.scores(s, d).select(E, "ts", "fused").orderBy(F.desc("fused"), E, "ts").limit(20)


@query("j09_zone_medians", "SELECT equip_id, tag, g AS good, w AS watch, a AS alert, a - g AS delta FROM (SELECT l.equip_id, l.tag, quantile_cont(l.value, 0.5) FILTER (zone = 'GOOD') AS g, quantile_cont(l.value, 0.5) FILTER (zone = 'WATCH') AS w, quantile_cont(l.value, 0.5) FILTER (zone = 'ALERT') AS a FROM long l JOIN health USING (equip_id, ts) GROUP BY 1, 2)", "good watch alert delta")
def _(s, d):
    return T.zone_medians(f.long(s, d), f.scores(s, d))


@query("a16_episode_metrics", """SELECT *, total_episodes / greatest(30.0, total_hours / 24) AS rate_per_day, CASE WHEN total_episodes > 1 THEN total_hours / (total_episodes - 1) ELSE 0.0 END AS mean_interarrival_hours FROM (SELECT equip_id, count(*) AS total_episodes, sum(duration_s / 3600) AS total_hours, avg(duration_s / 3600) AS avg_hours, quantile_cont(duration_s / 3600, 0.5) AS median_hours, max(duration_s / 3600) AS max_hours, min(duration_s / 3600) AS min_hours FROM eps GROUP BY 1)""", "total_hours avg_hours median_hours max_hours min_hours rate_per_day mean_interarrival_hours")
def _(s, d):
    return T.episode_metrics(f.spans(s, d))


@query("a17_episodes_qc", """SELECT b.equip_id, coalesce(n, 0) AS episode_count, coalesce(m, 0.0) AS median_minutes, coalesce(c / greatest(1.0, epoch(t1 - t0)) * 100, 0.0) AS coverage_pct, time_in_alert_pct, max_fused, avg_fused FROM (SELECT equip_id, min(ts) AS t0, max(ts) AS t1, avg(CASE WHEN fused > 2 THEN 1 ELSE 0 END) * 100 AS time_in_alert_pct, max(fused) AS max_fused, avg(fused) AS avg_fused FROM scores GROUP BY 1) b
  LEFT JOIN (SELECT equip_id, count(*) AS n, quantile_cont(duration_s, 0.5) / 60 AS m, sum(duration_s) AS c FROM eps GROUP BY 1) e USING (equip_id)""", "median_minutes coverage_pct time_in_alert_pct max_fused avg_fused")  # fmt: skip
def _(s, d):
    return T.episodes_qc(f.scores(s, d), f.spans(s, d))


@query("a18_severity_mapping", "SELECT *, 'VALID' AS validation_status FROM (SELECT equip_id, count(*) AS total_episodes, " + ", ".join(f"count(*) FILTER (severity = '{x}') AS {x.lower()}" for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")) + " FROM eps GROUP BY 1)")
def _(s, d):
    return T.severity_mapping(f.spans(s, d)).drop("counts_json")


_IN = "eps e JOIN {} m ON m.equip_id = e.equip_id AND m.ts BETWEEN e.start_ts AND e.end_ts"


@query("a20_episode_contributions", f"SELECT *, row_number() OVER (PARTITION BY equip_id, episode_id ORDER BY contribution_pct DESC, detector) AS rank FROM (SELECT *, mean_z / sum(mean_z) OVER (PARTITION BY equip_id, episode_id) * 100 AS contribution_pct FROM (SELECT e.equip_id, episode_id, detector, avg(abs(z)) AS mean_z FROM {_IN.format('melted')} GROUP BY 1, 2, 3)) WHERE contribution_pct >= 1", "mean_z contribution_pct")
def _(s, d):
    return T.episode_contributions(f.scores(s, d), f.spans(s, d))


@query("f22_episode_diagnostics", f"""SELECT equip_id, episode_id, peak_z, peak_ts, duration_s / 3600 AS duration_h, CASE WHEN culprits LIKE 'click%' THEN 'click' ELSE culprits END AS dominant_sensor, severity, CASE WHEN peak_z >= 3 THEN 'Extreme anomaly' WHEN peak_z >= 2.5 THEN 'High anomaly' WHEN duration_s >= 86400 THEN 'Extended duration' WHEN duration_s >= 14400 THEN 'Moderate duration' ELSE 'Brief anomaly' END AS severity_reason, avg_z, min_health
  FROM (SELECT e.equip_id, e.episode_id, e.duration_s, e.culprits, e.severity, max(m.fused) AS peak_z, arg_min(m.ts, (-m.fused, m.ts)) AS peak_ts, avg(m.fused) AS avg_z, min(m.h) AS min_health FROM {_IN.format('health')} GROUP BY ALL)""", "peak_z duration_h avg_z min_health")  # fmt: skip
def _(s, d):
    return T.episode_diagnostics(f.scores(s, d), f.spans(s, d))


@query("a34_majority_regime", f"SELECT equip_id, episode_id, regime_label AS regime FROM (SELECT e.equip_id, e.episode_id, m.regime_label, row_number() OVER (PARTITION BY e.equip_id, e.episode_id ORDER BY count(*) DESC, m.regime_label) AS r FROM {_IN.format('scores')} GROUP BY 1, 2, 3) WHERE r = 1")
def _(s, d):
    return T.majority_regime(f.scores(s, d), f.spans(s, d))


@query("w27_culprit_history", f"""SELECT equip_id, episode_id, start_ts, end_ts, duration_s / 3600 AS duration_hours, detector AS primary_detector, w AS weighted_contribution, lead_mean_z, during_mean_z, lag_mean_z FROM (
  SELECT *, during_mean_z * CASE WHEN detector = 'view' THEN 2.0 ELSE 1.0 END AS w, row_number() OVER (PARTITION BY equip_id, episode_id ORDER BY during_mean_z * CASE WHEN detector = 'view' THEN 2.0 ELSE 1.0 END DESC, detector) AS r FROM (
    SELECT s.equip_id, s.episode_id, s.start_ts, s.end_ts, s.duration_s, m.detector, avg(z) FILTER (p.i < a) AS lead_mean_z, avg(z) FILTER (p.i BETWEEN a AND b) AS during_mean_z, avg(z) FILTER (p.i > b) AS lag_mean_z
    FROM (SELECT e.equip_id, e.episode_id, e.start_ts, e.end_ts, e.duration_s, min(m.i) AS a, max(m.i) AS b FROM {_IN.format('hours')} GROUP BY ALL) s JOIN hours p ON p.equip_id = s.equip_id AND p.i BETWEEN a - 10 AND b + 10 JOIN melted m ON m.equip_id = p.equip_id AND m.ts = p.ts GROUP BY ALL)) WHERE r = 1""", "duration_hours weighted_contribution lead_mean_z during_mean_z lag_mean_z")  # fmt: skip
def _(s, d):
    return T.culprit_history(f.scores(s, d), f.spans(s, d), {"view_z": 2.0})


@query("f25_parse_culprits", """SELECT equip_id, episode_id, r AS rank, trim(split_part(p, '(', 1)) AS detector, nullif(regexp_extract(p, '\\(([^)]*)\\)', 1), '') AS sensor FROM (SELECT equip_id, episode_id, unnest(string_split(culprits, ',')) AS p, generate_subscripts(string_split(culprits, ','), 1) AS r FROM eps)""")
def _(s, d):
    return T.parse_culprits(f.spans(s, d))


@query("a36_culprits_by_severity", """SELECT detector, count(*) FILTER (severity = 'LOW') AS "LOW", count(*) FILTER (severity = 'MEDIUM') AS "MEDIUM", count(*) FILTER (severity = 'HIGH') AS "HIGH", count(*) FILTER (severity = 'CRITICAL') AS "CRITICAL" FROM (SELECT severity, trim(split_part(unnest(string_split(culprits, ',')), '(', 1)) AS detector FROM eps) GROUP BY 1""")
def _(s, d):
    return T.culprits_by_severity(f.spans(s, d))


@query("a30_health_by_period", "SELECT equip_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'first' ELSE 'second' END AS period, avg(h) AS mean_h, min(h) AS min_h, max(h) AS max_h, stddev_samp(h) AS sd_h, count(*) AS n FROM health GROUP BY 1, 2", "mean_h min_h max_h sd_h")
def _(s, d):
    h = health("fused")
    period = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "first").otherwise("second")
    return f.scores(s, d).groupBy(E, period.alias("period")).agg(F.avg(h).alias("mean_h"), F.min(h).alias("min_h"), F.max(h).alias("max_h"), F.stddev_samp(h).alias("sd_h"), F.count("*").alias("n"))


@query("a32_zone_pivot", "SELECT equip_id, date_trunc('week', ts)::TIMESTAMP AS week, sum(CASE WHEN zone = 'GOOD' THEN 1 ELSE 0 END) * 100.0 / count(*) AS good_pct, sum(CASE WHEN zone = 'WATCH' THEN 1 ELSE 0 END) * 100.0 / count(*) AS watch_pct, sum(CASE WHEN zone = 'ALERT' THEN 1 ELSE 0 END) * 100.0 / count(*) AS alert_pct FROM health GROUP BY 1, 2", "good_pct watch_pct alert_pct")
def _(s, d):
    z = zone(health("fused"))
    pct = lambda n: (F.count_if(z == n) * 100.0 / F.count("*")).alias(f"{n.lower()}_pct")
    return f.scores(s, d).groupBy(E, F.date_trunc("WEEK", "ts").cast("timestamp_ntz").alias("week")).agg(*[pct(n) for n in T.ZONES])


@query("a21_regime_health", """SELECT g.equip_id, g.regime_label, g.n, median_fused, p95_abs_fused, dwell_seconds, transitions, 1.0 / (1.0 + transitions) AS stability, CASE WHEN median_fused >= 3 THEN 'critical' WHEN median_fused >= 1.5 THEN 'suspect' ELSE 'healthy' END AS state
  FROM (SELECT equip_id, regime_label, count(*) AS n, quantile_cont(fused, 0.5) AS median_fused, quantile_cont(abs(fused), 0.95) AS p95_abs_fused FROM scores GROUP BY 1, 2) g JOIN (SELECT equip_id, regime_label, avg(epoch(end_ts - start_ts)) AS dwell_seconds, count(nx) AS transitions FROM (SELECT *, lead(start_ts) OVER (PARTITION BY equip_id ORDER BY start_ts) AS nx FROM rruns) GROUP BY 1, 2) r USING (equip_id, regime_label)""", "median_fused p95_abs_fused dwell_seconds stability")  # fmt: skip
def _(s, d):
    from plantwatch.operators.regimes import regime_health

    return regime_health(f.scores(s, d))


@query("a23_sample_durations", "SELECT equip_id, ts, coalesce(d, m, 0.0) AS duration_s FROM (SELECT equip_id, ts, epoch(lead(ts) OVER (PARTITION BY equip_id ORDER BY ts) - ts) AS d FROM scores) JOIN (SELECT equip_id, quantile_cont(d, 0.5) AS m FROM (SELECT equip_id, epoch(lead(ts) OVER (PARTITION BY equip_id ORDER BY ts) - ts) AS d FROM scores) GROUP BY 1) USING (equip_id)", "duration_s")
def _(s, d):
    return scoring.sample_durations(f.scores(s, d).select(E, "ts"))


@query("a24_saturation", "SELECT equip_id, detector, avg(CASE WHEN abs(z) >= 0.95 * 8 THEN 1 ELSE 0 END) * 100 AS saturation_pct, avg(z) AS mean_z, stddev_pop(z) AS std_z FROM melted GROUP BY 1, 2", "saturation_pct mean_z std_z")
def _(s, d):
    return scoring.saturation(T.melt(f.scores(s, d)), 8.0)


@query("a25_anomaly_rate", "SELECT equip_id, avg(CASE WHEN fused > 1 THEN 1 ELSE 0 END) AS anomaly_rate, max(fused) AS max_score, avg(fused) AS mean_score FROM scores GROUP BY 1", "anomaly_rate max_score mean_score")
def _(s, d):
    return scoring.anomaly_rate(f.scores(s, d))


@query("a27_episode_quality", """SELECT r.equip_id, coalesce(e.n, 0) AS n_episodes, coalesce(c * 100.0 / r.n, 0.0) AS coverage_pct, coalesce(l / 3600, 0.0) AS longest_hours, coalesce(c * 100.0 / r.n, 0.0) <= 80 AND coalesce(l, 0.0) <= 2592000 AS ok FROM (SELECT equip_id, count(*) AS n FROM scores GROUP BY 1) r LEFT JOIN (SELECT equip_id, count(*) AS n, sum(len) AS c, max(duration_s) AS l FROM eps GROUP BY 1) e USING (equip_id)""", "coverage_pct longest_hours")
def _(s, d):
    return scoring.episode_quality(f.spans(s, d), f.scores(s, d))


@query("a29_run_health", "SELECT *, CASE WHEN avg_health >= 85 AND max_fused < 3 THEN 'HEALTHY' WHEN avg_health >= 70 AND max_fused < 5 THEN 'CAUTION' ELSE 'ALERT' END AS status FROM (SELECT equip_id, count(*) AS n_rows, avg(h) AS avg_health, min(h) AS min_health, max(abs(fused)) AS max_fused FROM health GROUP BY 1)", "avg_health min_health max_fused")
def _(s, d):
    return scoring.run_health(f.scores(s, d))
