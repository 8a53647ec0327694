"""Histories, cleaning, rolling features, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plantwatch.functions import scalar
from plantwatch.operators import cleaning, history, islands, rolling, runs, scoring
from plantwatch.plans import frames as f
from plantwatch.plans.catalog import query
from plantwatch.sources import readers, sinks

E = "equip_id"
COLS = list(f.TAGS)
_BY = "PARTITION BY equip_id ORDER BY ts"


# sources, history, sinks


@query("s04_range", "SELECT equip_id, tag, ts, seq, value FROM hist WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07' AND tag IN ('click', 'view')", "value")
def _(s, d):
    return history.span(f.history(s, d), "2024-01-05 00:00:00", "2024-01-07 00:00:00", ["click", "view"])


@query("s06_cyclic", """SELECT k.equip_id, k.tag, g.ts, last_value(l.value IGNORE NULLS) OVER (PARTITION BY k.equip_id, k.tag ORDER BY g.c) AS value
  FROM (SELECT range AS ts, row_number() OVER (ORDER BY range) - 1 AS c FROM range(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06 01:00:00', INTERVAL 1 HOUR)) g CROSS JOIN (SELECT DISTINCT equip_id, tag FROM hist WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' AND tag IN ('click', 'view')) k
  LEFT JOIN (SELECT equip_id, tag, CAST(ceil(epoch(ts - TIMESTAMP '2024-01-05') / 3600) AS BIGINT) AS c, max_by(value, ts) AS value FROM hist WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' GROUP BY 1, 2, 3) l ON l.equip_id = k.equip_id AND l.tag = k.tag AND l.c = g.c""", "value")  # fmt: skip
def _(s, d):
    return history.cyclic(f.history(s, d), "2024-01-05 00:00:00", "2024-01-06 00:00:00", 3600, ["click", "view"])


@query("s07_wide", "SELECT equip_id, ts, max(value) FILTER (tag = 'click') AS click, max(value) FILTER (tag = 'view') AS view FROM hist WHERE tag IN ('click', 'view') GROUP BY 1, 2", "click view")
def _(s, d):
    return history.widen(f.history(s, d).where(F.col("tag").isin("click", "view")), ["click", "view"])


@query("s09_single_tag", "SELECT equip_id, ts, value FROM hist WHERE tag = 'error' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'", "value")
def _(s, d):
    return history.span(f.history(s, d), "2024-01-10 00:00:00", "2024-01-12 00:00:00", ["error"]).select(E, "ts", "value")


_NEXT = "(SELECT *, epoch_us(ts) / 1e6 AS t, epoch_us(nts) / 1e6 AS n FROM (SELECT *, lead(ts) OVER (PARTITION BY equip_id, tag ORDER BY ts, seq) AS nts, lead(value) OVER (PARTITION BY equip_id, tag ORDER BY ts, seq) AS nv FROM hist) WHERE nts IS NOT NULL)"
_GRID = f"(SELECT *, unnest(range(CAST(ceil(t / 3600) * 3600 AS BIGINT), CAST(ceil(n / 3600) * 3600 AS BIGINT), 3600)) AS g FROM {_NEXT})"


@query("s10_interpolated", f"SELECT equip_id, tag, make_timestamp(g * 1000000) AS ts, value + (g - t) / (n - t) * (nv - value) AS value FROM {_GRID}", "value")
def _(s, d):
    return history.between_samples(f.history(s, d), 3600)


@query("s10_flat", f"SELECT equip_id, tag, make_timestamp(g * 1000000) AS ts, value FROM {_GRID}", "value")
def _(s, d):
    return history.between_samples(f.history(s, d), 3600, "flat")


@query("s11_dead_band")
def _(s, d):
    return history.dead_band(f.history(s, d), 50.0)


@query("s12_tag_counts", "SELECT equip_id, tag, count(value) AS n FROM hist WHERE CASE WHEN tag = 'click' THEN value > 10 ELSE TRUE END GROUP BY 1, 2")
def _(s, d):
    return history.tag_counts(f.history(s, d), {"click": F.col("value") > 10})


@query("s13_last_values", "SELECT equip_id, tag, ts, seq, value FROM (SELECT *, dense_rank() OVER (PARTITION BY equip_id, tag ORDER BY ts DESC) AS r FROM hist) WHERE r = 1", "value")
def _(s, d):
    return history.last_values(f.history(s, d))


@query("s15_signals", "SELECT equip_id, ts, split, click AS flow, error AS fault, purchase, signup, view FROM wide", "flow fault purchase signup view")
def _(s, d):
    return history.rename_signals(f.wide(s, d), {"click": "flow", "error": "fault"})


@query("s16_upsert", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation", base=False)
def _(s, d):
    nation = f.table(s, d, "nation")
    return sinks.upsert(nation, nation.where("n_regionkey = 0").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))), ["n_nationkey"])


@query("s18_for_sink", "SELECT * FROM (VALUES (1, 1.5, 'a', 1), (2, NULL, NULL, 0), (3, NULL, NULL, NULL), (4, NULL, 'b', 1), (5, -2.0, NULL, 0)) v(id, x, s, b)", "x", base=False)
def _(s, d):
    return cleaning.for_sink(s.sql("SELECT * FROM VALUES (1, 1.5D, 'a', true), (2, double('NaN'), '', false), (3, double('Infinity'), 'N/A', null), (4, 1e300D, 'b', true), (5, -2.0D, 'nan', false) v(id, x, s, b)"))


@query("s22_defaults", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN '' ELSE n_name END AS n_name, 0.0 AS weight, TRUE AS repaired FROM nation", "weight", base=False)
def _(s, d):
    nation = f.table(s, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("n_name"))
    return sinks.with_defaults(nation, {"n_name": "string", "weight": "double"})


@query("s23_scores_long", "SELECT equip_id, ts, detector AS sensor, z AS value, 'scores' AS source, 'r1' AS run_id FROM melted", "value")
def _(s, d):
    return sinks.scores_long(f.scores(s, d), "r1")


@query("s25_drift_rows", "SELECT equip_id, ts, fused AS drift_value FROM scores", "drift_value")
def _(s, d):
    return sinks.drift_rows(f.scores(s, d).select(E, "ts", F.col("fused").alias("value")))


@query("s26_event_rows", "SELECT equip_id, start_ts AS event_start, end_ts AS event_end, severity, 'OPEN' AS status FROM eps")
def _(s, d):
    return sinks.event_rows(f.spans(s, d))


@query("s35_schema_rows", "SELECT 'customer' AS table_name, c AS column_name, t AS type, CAST(0 AS BIGINT) AS n_null FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) v(c, t)", base=False)
def _(s, d):
    return sinks.schema_rows(f.table(s, d, "customer"), "customer")


@query("s37_tail_buffer", """SELECT equip_id, ts, seq, tag, value FROM (SELECT *, row_number() OVER (PARTITION BY equip_id ORDER BY ts DESC) AS n FROM (SELECT h.*, max(ts) OVER (PARTITION BY equip_id) AS t1 FROM hist h) WHERE ts >= t1 - INTERVAL 48 HOUR) WHERE n <= 100""", "value")
def _(s, d):
    return history.tail_buffer(f.history(s, d), 48, 100)


@query("s45_next_window", "SELECT equip_id, min(ts) AS window_start, min(ts) + INTERVAL 30 MINUTE AS window_end FROM hist GROUP BY 1")
def _(s, d):
    h = f.history(s, d)
    none = s.createDataFrame([], "run_id string, equip_id int, window_end timestamp_ntz, outcome string")
    return runs.next_window(h.select(E).distinct(), none, h, 30, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


_CONFIG = "VALUES (0, 'a.k', '1', 'int'), (0, 'a.h', '5.5', 'float'), (2, 'a.k', '7', 'int'), (3, 'a.k', '9', 'int'), (0, 'b.on', 'yes', 'bool')"


@query("s49_config", "SELECT * FROM (VALUES (2, 'a.k', '7', 'int'), (0, 'a.h', '5.5', 'float'), (0, 'b.on', 'yes', 'bool')) v(equip_id, param_path, param_value, value_type)", base=False)
def _(s, d):
    return runs.effective_config(s.sql(f"SELECT * FROM {_CONFIG} v(equip_id, param_path, param_value, value_type)"), 2)


@query("s50_typed_config", "SELECT * FROM (VALUES (0, 'a.k', '1', 'int', '1'), (0, 'a.h', '5.5', 'float', '5.5'), (2, 'a.k', '7', 'int', '7'), (3, 'a.k', '9', 'int', '9'), (0, 'b.on', 'yes', 'bool', 'true')) v(equip_id, param_path, param_value, value_type, typed)", base=False)
def _(s, d):
    return runs.typed_config(s.sql(f"SELECT * FROM {_CONFIG} v(equip_id, param_path, param_value, value_type)"))


@query("s42_views", "SELECT equip_id, ts, fused, 'unit ' || equip_id AS equip_name FROM scores", "fused")
def _(s, d):
    equipment = s.range(4).select(F.col("id").cast("int").alias(E), F.concat(F.lit("unit "), F.col("id")).alias("equip_name"))
    runs.register_views({"scores": f.scores(s, d).select(E, "ts", "fused")}, equipment)
    return s.sql("SELECT equip_id, ts, fused, equip_name FROM v_scores")


@query("e12_parse_changes", "SELECT * FROM (VALUES (1, 'a.k', '1', '2'), (2, 'b.clip_z', '8.0', '9.6')) v(equip_id, param_path, old_value, new_value)", base=False)
def _(s, d):
    return runs.parse_changes(s.sql("SELECT * FROM VALUES (1, 'a.k: 1->2'), (2, ' b.clip_z : 8.0 -> 9.6'), (3, 'no change') v(equip_id, action)"))


# cleaning


@query("p02_drop_future", "SELECT equip_id, tag, ts, seq, value FROM hist WHERE ts <= TIMESTAMP '2024-01-15 00:10:00'", "value")
def _(s, d):
    return cleaning.drop_future(f.history(s, d), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), grace_minutes=10)


@query("p02_future_report", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_no_time, count(*) FILTER (ts > TIMESTAMP '2024-01-15') AS n_future FROM hist")
def _(s, d):
    return cleaning.future_report(f.history(s, d), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query("p05_keep_last", "SELECT equip_id, date_trunc('hour', ts) AS hour, max_by(value, seq) AS value FROM hist GROUP BY 1, 2", "value")
def _(s, d):
    h = f.history(s, d).select(E, scalar.trunc("HOUR", "ts").alias("hour"), "seq", "value")
    return cleaning.keep_last(h, [E, "hour"], "seq").drop("seq")


@query("p06_fill_median", "SELECT w.equip_id, ts, " + ", ".join(f"coalesce({t}, m_{t}) AS {t}" for t in COLS) + " FROM wide w JOIN (SELECT equip_id, " + ", ".join(f"quantile_cont({t}, 0.5) AS m_{t}" for t in COLS) + " FROM wide WHERE split = 'train' GROUP BY 1) USING (equip_id)", " ".join(COLS))
def _(s, d):
    w = f.wide(s, d)
    return cleaning.fill(w, COLS, "median", cleaning.train_statistics(w, COLS)).drop("split")


@query("p06_ffill", f"SELECT equip_id, ts, last_value(click IGNORE NULLS) OVER ({_BY}) AS click FROM wide", "click")
def _(s, d):
    return cleaning.fill(f.wide(s, d).select(E, "ts", "click"), ["click"], "ffill")


@query("p06_bfill", f"SELECT equip_id, ts, first_value(click IGNORE NULLS) OVER ({_BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS click FROM wide", "click")
def _(s, d):
    return cleaning.fill(f.wide(s, d).select(E, "ts", "click"), ["click"], "bfill")


_NEAR = f"""(SELECT equip_id, ts, x, i, max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY equip_id ORDER BY i) AS ia, min(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY equip_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib,
  last_value(x IGNORE NULLS) OVER (PARTITION BY equip_id ORDER BY i) AS va, first_value(x IGNORE NULLS) OVER (PARTITION BY equip_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM (SELECT *, row_number() OVER ({_BY}) AS i FROM {{}}))"""


@query("p06_interpolate", f"SELECT equip_id, ts, coalesce(x, va + (vb - va) * (i - ia) / (ib - ia), va, vb) AS click FROM {_NEAR.format('(SELECT equip_id, ts, click AS x FROM wide)')}", "click")
def _(s, d):
    return cleaning.fill(f.wide(s, d).select(E, "ts", "click"), ["click"], "interpolate")


_GRIDDED = "(SELECT g.equip_id, g.ts, w.click AS x FROM (SELECT equip_id, unnest(range(min(ts), max(ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM wide GROUP BY 1) g LEFT JOIN wide w USING (equip_id, ts))"


@query("p08_resample", f"SELECT equip_id, ts, CASE WHEN x IS NOT NULL THEN x WHEN least(coalesce(i - ia, 1000000), coalesce(ib - i, 1000000)) <= 2 THEN coalesce(va + (vb - va) * (i - ia) / (ib - ia), va, vb) END AS click FROM {_NEAR.format(_GRIDDED)}", "click")
def _(s, d):
    return cleaning.resample(f.wide(s, d), ["click"], 3600, 7200)


@query("p09_cadence", """SELECT equip_id, c AS cadence_s, avg(CASE WHEN abs(g - c) <= 0.05 * c THEN 1 ELSE 0 END) >= 0.9 AS regular, avg(CASE WHEN abs(g - c) <= 0.05 * c THEN 1 ELSE 0 END) AS share_regular FROM (SELECT equip_id, g, quantile_cont(g, 0.5) OVER (PARTITION BY equip_id) AS c FROM (SELECT equip_id, epoch(ts - lag(ts) OVER (PARTITION BY equip_id ORDER BY ts)) AS g FROM scores) WHERE g IS NOT NULL) GROUP BY 1, 2""", "cadence_s share_regular")
def _(s, d):
    return cleaning.cadence(f.scores(s, d).select(E, "ts"), [E])


@query("p11_common_step", "SELECT equip_id, step_s FROM (SELECT equip_id, CAST(round(g) AS BIGINT) AS step_s, row_number() OVER (PARTITION BY equip_id ORDER BY count(*) DESC, round(g)) AS r FROM (SELECT equip_id, n, epoch(ts - lag(ts) OVER (PARTITION BY equip_id ORDER BY ts)) AS g FROM (SELECT equip_id, ts, row_number() OVER (PARTITION BY equip_id ORDER BY ts) AS n FROM scores) WHERE n <= 100) WHERE g > 0 GROUP BY equip_id, round(g)) WHERE r = 1")
def _(s, d):
    return cleaning.common_step(f.scores(s, d).select(E, "ts"), [E])


_Q = "(SELECT equip_id, tag, ts, CASE WHEN seq % 7 < 2 THEN NULL ELSE CAST(floor(value / 20) AS DOUBLE) END AS value FROM hist)"
_RUN = "SELECT equip_id, tag, max(c) + {x} AS {n} FROM (SELECT equip_id, tag, run, count(*) AS c FROM (SELECT *, sum(CASE WHEN {f} THEN 0 ELSE 1 END) OVER (PARTITION BY equip_id, tag ORDER BY ts) AS run FROM (SELECT *, value = lag(value) OVER (PARTITION BY equip_id, tag ORDER BY ts) AS flat FROM {q})) WHERE {f} GROUP BY 1, 2, 3) GROUP BY 1, 2"


@query("p12_quality_report", f"""SELECT b.equip_id, b.tag, n_rows, n_null, n_null * 100.0 / n_rows AS null_pct, std, coalesce(longest_null_run, 0) AS longest_null_run, coalesce(longest_flat_run, 1) AS longest_flat_run, min_ts, max_ts, CASE WHEN n_null * 100.0 / n_rows >= 80 THEN 'FAIL' WHEN n_null * 100.0 / n_rows >= 10 THEN 'WARN' ELSE 'OK' END AS verdict
  FROM (SELECT equip_id, tag, count(*) AS n_rows, count(*) - count(value) AS n_null, stddev_samp(value) AS std, min(ts) AS min_ts, max(ts) AS max_ts FROM {_Q} GROUP BY 1, 2) b LEFT JOIN ({_RUN.format(x=0, n='longest_null_run', f='value IS NULL', q=_Q)}) USING (equip_id, tag) LEFT JOIN ({_RUN.format(x=1, n='longest_flat_run', f='coalesce(flat, FALSE)', q=_Q)}) USING (equip_id, tag)""", "null_pct std")  # fmt: skip
def _(s, d):
    h = f.history(s, d).withColumn("value", F.when(F.col("seq") % 7 >= 2, F.floor(F.col("value") / 20).cast("double")))
    return cleaning.quality_report(h.drop("seq"))


@query("p16_scale_clip", "SELECT w.equip_id, ts, (greatest(q[1], least(q[2], click)) - q[4]) / CASE WHEN q[5] > q[3] THEN (q[5] - q[3]) / 1.349 ELSE 1.0 END AS click FROM (SELECT equip_id, ts, click FROM wide WHERE click IS NOT NULL) w JOIN (SELECT equip_id, quantile_cont(click, [0.001, 0.999, 0.25, 0.5, 0.75]) AS q FROM wide GROUP BY 1) USING (equip_id)", "click")
def _(s, d):
    return cleaning.scale_clip(f.wide(s, d).select(E, "ts", "click").where("click is not null"), ["click"])


@query("p17_impute_mean", "SELECT w.equip_id, ts, coalesce(click, m) AS click FROM wide w JOIN (SELECT equip_id, avg(click) AS m FROM wide GROUP BY 1) USING (equip_id)", "click")
def _(s, d):
    return cleaning.impute_finite(f.wide(s, d).select(E, "ts", "click"), ["click"], "mean")


@query("p18_context_z", "SELECT equip_id, tag, ts, value, train_mean, train_std, z FROM context", "value train_mean train_std z")
def _(s, d):
    return f.context(s, d).drop("split")


# rolling features


def _wide(s, d):
    return f.wide(s, d).select(E, "ts", "click", "view").where("click is not null and view is not null")


_W = "(SELECT equip_id, ts, click, view, row_number() OVER (PARTITION BY equip_id ORDER BY ts) AS i FROM wide WHERE click IS NOT NULL AND view IS NOT NULL)"
_F = "(PARTITION BY equip_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"


def _roll(name, sql, make):
    @query(name, f"SELECT equip_id, ts, {sql} AS x FROM {_W}", "x")
    def _(s, d):
        df = _wide(s, d).withColumn("i", F.row_number().over(W.partitionBy(E).orderBy("ts")))
        return df.select(E, "ts", make(rolling.frame(8)).alias("x"))


_roll("w01_rolling_median", f"median(click) OVER {_F}", lambda w: rolling.median("click", w))
_roll("w02_rolling_mad", f"mad(click) OVER {_F}", lambda w: rolling.mad("click", w))
_roll("w03_rolling_mean", f"avg(click) OVER {_F}", lambda w: rolling.mean("click", w))
_roll("w03_rolling_std", f"stddev_samp(click) OVER {_F}", lambda w: rolling.std("click", w))
_roll("w04_rolling_skew", f"skewness(click) OVER {_F}", lambda w: rolling.skew("click", w))
_roll("w04_rolling_kurt", f"kurtosis(click) OVER {_F}", lambda w: rolling.kurt("click", w))
_roll("w05_rolling_slope", f"CASE WHEN count(*) OVER {_F} >= 2 THEN regr_slope(click, i) OVER {_F} ELSE 0.0 END", lambda w: rolling.slope("click", "i", w))
_roll("w11_rolling_xcorr", f"CASE WHEN count(*) OVER {_F} >= 2 THEN corr(click, view) OVER {_F} END", lambda w: rolling.xcorr("click", "view", w))
_roll("w16_rolling_rz", f"CASE WHEN TRUE THEN greatest(-100.0, least(100.0, (click - median(click) OVER {_F}) / (greatest(mad(click) OVER {_F}, 1e-9) * 1.4826 + 1e-9))) END", lambda w: scalar.robust_z("click", rolling.median("click", w), rolling.mad("click", w)))


@query("w07_spectral")
def _(s, d):
    return _wide(s, d).select(E, "ts", *[e.alias(f"energy_{i}") for i, e in enumerate(rolling.spectral("click", rolling.frame(8), 8))])


@query("w12_lag_pairs", f"SELECT equip_id, ts, CASE WHEN count(v1) OVER {_F} >= 2 THEN corr(click, v1) OVER {_F} END AS click_view_lag1 FROM (SELECT *, lag(view) OVER (PARTITION BY equip_id ORDER BY ts) AS v1 FROM {_W})", "click_view_lag1")
def _(s, d):
    got = rolling.lag_pairs(_wide(s, d).withColumn("_one", F.lag("view").over(W.partitionBy(E).orderBy("ts"))), ["click", "view"], 1, 8)
    n = F.row_number().over(W.partitionBy(E).orderBy("ts"))
    return got.select(E, "ts", F.when(n >= 3, F.col("click_view_lag1")).alias("click_view_lag1"))


@query("w14_features", f"""SELECT equip_id, ts, median(click) OVER {_F} AS click_med, mad(click) OVER {_F} AS click_mad, avg(click) OVER {_F} AS click_mean, coalesce(stddev_samp(click) OVER {_F}, 0.0) AS click_std, CASE WHEN count(*) OVER {_F} >= 2 THEN regr_slope(click, i) OVER {_F} ELSE 0.0 END AS click_slope, coalesce(skewness(click) OVER {_F}, 0.0) AS click_skew, coalesce(kurtosis(click) OVER {_F}, 0.0) AS click_kurt,
  greatest(-100.0, least(100.0, (click - median(click) OVER {_F}) / (greatest(mad(click) OVER {_F}, 1e-9) * 1.4826 + 1e-9))) AS click_rz FROM {_W}""", "click_med click_mad click_mean click_std click_slope click_skew click_kurt click_rz")  # fmt: skip
def _(s, d):
    return rolling.features(_wide(s, d), ["click"], 8, energy=False)


# joins


@query("j01_equipment_join", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", base=False)
def _(s, d):
    n = f.table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return f.table(s, d, "customer").join(n, "c_nationkey").select("c_custkey", "c_name", "n_name")


_POINTS = "(SELECT equip_id, ts, seq, value FROM hist WHERE tag = 'signup')"
_OTHER = "(SELECT equip_id, ts AS right_ts, value AS v FROM hist WHERE tag = 'error')"


def _sides(s, d):
    h = f.history(s, d)
    return h.where("tag = 'signup'").select(E, "ts", "seq"), h.where("tag = 'error'").select(E, "ts", F.col("value").alias("v"))


@query("j06_asof_forward", f"SELECT a.equip_id, a.ts, a.seq, b.right_ts, b.v FROM {_POINTS} a ASOF LEFT JOIN {_OTHER} b ON a.equip_id = b.equip_id AND a.ts <= b.right_ts", "v")
def _(s, d):
    a, b = _sides(s, d)
    return islands.asof(a, b, "v", direction="forward")


@query("j07_asof_backward", f"SELECT a.equip_id, a.ts, a.seq, b.right_ts, b.v FROM {_POINTS} a ASOF LEFT JOIN {_OTHER} b ON a.equip_id = b.equip_id AND a.ts >= b.right_ts", "v")
def _(s, d):
    a, b = _sides(s, d)
    return islands.asof(a, b, "v")


@query("j07_nearest", f"""SELECT equip_id, ts, seq, CASE WHEN bt IS NULL OR (ft IS NOT NULL AND ft - ts <= ts - bt) THEN ft ELSE bt END AS right_ts, CASE WHEN bt IS NULL OR (ft IS NOT NULL AND ft - ts <= ts - bt) THEN fv ELSE bv END AS v FROM (
  SELECT x.*, c.right_ts AS ft, c.v AS fv FROM (SELECT a.equip_id, a.ts, a.seq, b.right_ts AS bt, b.v AS bv FROM {_POINTS} a ASOF LEFT JOIN {_OTHER} b ON a.equip_id = b.equip_id AND a.ts >= b.right_ts) x ASOF LEFT JOIN {_OTHER} c ON x.equip_id = c.equip_id AND x.ts <= c.right_ts)""", "v")  # fmt: skip
def _(s, d):
    a, b = _sides(s, d)
    return islands.nearest(a, b, "v")


@query("j08_interval_join", "SELECT s.equip_id, s.ts, s.fused, e.episode_id FROM scores s JOIN eps e ON s.equip_id = e.equip_id AND s.ts BETWEEN e.start_ts AND e.end_ts", "fused")
def _(s, d):
    return islands.inside(f.scores(s, d).select(E, "ts", "fused"), f.spans(s, d).select(E, "episode_id", "start_ts", "end_ts")).select(E, "ts", "fused", "episode_id")


@query("j10_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", base=False)
def _(s, d):
    return f.table(s, d, "customer").join(f.table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j11_unknown_tags", "SELECT * FROM (VALUES ('scroll')) v(tag)", base=False)
def _(s, d):
    return history.unknown_tags(s.sql("SELECT * FROM VALUES ('click'), ('scroll') v(tag)"), f.history(s, d).select("tag").distinct())


@query("j12_top_semi_join", "SELECT equip_id, ts, detector, z FROM melted WHERE detector IN (SELECT detector FROM melted GROUP BY 1 ORDER BY avg(abs(z)) DESC, 1 LIMIT 2)", "z")
def _(s, d):
    from plantwatch.operators.tables import melt

    m = melt(f.scores(s, d))
    top = m.groupBy("detector").agg(F.avg(F.abs("z")).alias("a")).orderBy(F.desc("a"), "detector").limit(2)
    return m.join(top, "detector", "left_semi")


@query("j13_latest_run", "SELECT o_custkey AS equip_id, max_by(o_orderkey, o_orderdate) AS run_id, max(o_orderdate) AS started_at FROM (SELECT * FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderdate) = 1) GROUP BY 1", base=False)
def _(s, d):
    o = f.table(s, d, "orders")
    once = o.withColumn("n", F.count("*").over(W.partitionBy("o_custkey", "o_orderdate"))).where("n = 1")
    return runs.latest_run(once.select(F.col("o_custkey").alias(E), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at")))


@query("j15_reindex", "SELECT g.equip_id, g.ts, c.z FROM scores g LEFT JOIN (SELECT * FROM context WHERE tag = 'click') c USING (equip_id, ts)", "z")
def _(s, d):
    return f.scores(s, d).select(E, "ts").join(f.context(s, d).where("tag = 'click'").select(E, "ts", "z"), [E, "ts"], "left")


# set operations, counts, scalars


@query("u01_union_text", "SELECT 'order' AS kind, o_orderkey AS id, CAST(CAST(o_custkey AS BIGINT) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), n_name FROM nation", base=False)
def _(s, d):
    o = f.table(s, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("value"))
    n = f.table(s, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("value"))
    return history.as_text([o, n])


@query("u03_date_series", "SELECT CAST(unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS TIMESTAMP) AS ts", base=False)
def _(s, d):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return cleaning.time_grid(s.range(1).select(t("2024-01-01 00:00:00").alias("t0"), t("2024-01-30 00:00:00").alias("t1")), 86400)


@query("u04_distinct", "SELECT DISTINCT equip_id, tag FROM hist")
def _(s, d):
    return f.history(s, d).select(E, "tag").distinct()


@query("a38_distinct_counts", "SELECT equip_id, count(DISTINCT tag) AS n_tags, count(DISTINCT ts) AS n_times FROM hist GROUP BY 1")
def _(s, d):
    return f.history(s, d).groupBy(E).agg(F.count_distinct("tag").alias("n_tags"), F.count_distinct("ts").alias("n_times"))


@query("a39_table_ranges", "SELECT 'events' AS table_name, count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts FROM events UNION ALL SELECT 'orders', count(*), min(o_orderdate), max(o_orderdate) FROM orders", base=False)
def _(s, d):
    e = f.table(s, d, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"))
    o = f.table(s, d, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    return readers.table_ranges({"events": e, "orders": o})


@query("a33_tick_minutes", "SELECT equip_id, t0, t1, n, CAST(greatest(1, least(1440, ceil(date_diff('second', t0, t1) / 60.0 * 500 / n))) AS BIGINT) AS tick_minutes FROM (SELECT equip_id, date_trunc('second', min(ts)) AS t0, date_trunc('second', max(ts)) AS t1, count(*) AS n FROM hist GROUP BY 1)")
def _(s, d):
    return readers.tick_minutes(f.history(s, d).withColumn("ts", scalar.trunc("SECOND", "ts")), 500)


@query("t01_tick_windows", "SELECT equip_id, time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, count(*) AS n, avg(value) AS mean FROM hist GROUP BY 1, 2", "mean")
def _(s, d):
    w = F.window(F.col("ts").cast("timestamp"), "30 minutes")
    return f.history(s, d).groupBy(E, w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(E, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "mean")


@query("x04_date_parts", "SELECT seq, CAST(hour(ts) AS INTEGER) AS h, CAST(isodow(ts) - 1 AS INTEGER) AS dow, date_trunc('day', ts)::TIMESTAMP AS day, date_diff('second', date_trunc('day', ts), date_trunc('second', ts)) AS sec, strftime(ts, '%Y-%m-%d %H:%M') AS text FROM hist")
def _(s, d):
    t = F.col("ts")
    return f.history(s, d).select("seq", F.hour(t).alias("h"), F.weekday(t).alias("dow"), scalar.trunc("DAY", "ts").alias("day"), F.timestamp_diff("SECOND", scalar.trunc("DAY", "ts"), scalar.trunc("SECOND", "ts")).alias("sec"), F.date_format(t, "yyyy-MM-dd HH:mm").alias("text"))


@query("x05_strings", "SELECT p_partkey, upper(trim(p_name)) AS up, split_part(p_type, ' ', 1) AS head, replace(p_brand, 'Brand', 'B') AS brand, regexp_matches(p_type, '[A-Z]') AS caps, p_brand || '/' || p_size AS joined FROM part", base=False)
def _(s, d):
    return f.table(s, d, "part").select("p_partkey", F.upper(F.trim("p_name")).alias("up"), F.substring_index("p_type", " ", 1).alias("head"), F.replace(F.col("p_brand"), F.lit("Brand"), F.lit("B")).alias("brand"), F.col("p_type").rlike("[A-Z]").alias("caps"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("joined"))


@query("x05_listagg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1", base=False)
def _(s, d):
    return f.table(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("x06_base_sensor", "SELECT DISTINCT split_part(x, '_', 1) AS base FROM (VALUES ('temp_in_mean'), ('flow'), ('a_b')) v(x)", base=False)
def _(s, d):
    return s.sql("SELECT * FROM VALUES ('temp_in_mean'), ('flow'), ('a_b') v(x)").select(scalar.base_sensor("x").alias("base")).distinct()


@query("x07_conditionals", "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS kind, CASE WHEN value > 100 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS size FROM events", base=False)
def _(s, d):
    v = F.col("value")
    return f.table(s, d, "events").select("event_id", F.coalesce(F.nullif("event_type", F.lit("click")), F.lit("none")).alias("kind"), F.when(v > 100, "high").when(v > 10, "mid").otherwise("low").alias("size"))


@query("x08_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", base=False)
def _(s, d):
    return f.table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("x09_hashes", "SELECT n_nationkey, sha256(n_name) AS sha, md5(n_name) AS m FROM nation", base=False)
def _(s, d):
    return f.table(s, d, "nation").select("n_nationkey", F.sha2("n_name", 256).alias("sha"), F.md5("n_name").alias("m"))


@query("x10_equipment_ids", "SELECT n_name, CASE WHEN n_name = 'PUMP' THEN CAST(1 AS BIGINT) ELSE CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(md5(n_name), ''), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS BIGINT))), lambda a, x: (a * 16 + x) % 9999) + 1 AS BIGINT) END AS id FROM nation", base=False)
def _(s, d):
    return f.table(s, d, "nation").select("n_name", scalar.equipment_code_id("n_name", {"PUMP": 1}).alias("id"))


@query("x11_casts", "SELECT * FROM (VALUES ('1.5', 1.5), ('x', NULL), ('', NULL), ('7', 7.0)) v(s, x)", "x", base=False)
def _(s, d):
    return s.sql("SELECT * FROM VALUES ('1.5'), ('x'), (''), ('7') v(s)").select("s", F.col("s").try_cast("double").alias("x"))


@query("x12_row_statistics", "SELECT equip_id, ts, avg(value) AS mean, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95 FROM long GROUP BY 1, 2", "mean median p95")
def _(s, d):
    return f.long(s, d).groupBy(E, "ts").agg(F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.95).alias("p95"))


@query("n03_rollup", "SELECT equip_id, tag, count(*) AS n, avg(value) AS mean FROM hist GROUP BY ROLLUP (equip_id, tag)", "mean")
def _(s, d):
    return f.history(s, d).rollup(E, "tag").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("n04_except", "SELECT DISTINCT equip_id, tag FROM hist WHERE ts < TIMESTAMP '2024-01-02' EXCEPT SELECT DISTINCT equip_id, tag FROM hist WHERE ts >= TIMESTAMP '2024-01-30 23:30:00'")
def _(s, d):
    h = f.history(s, d)
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return h.where(F.col("ts") < t("2024-01-02 00:00:00")).select(E, "tag").distinct().subtract(h.where(F.col("ts") >= t("2024-01-30 23:30:00")).select(E, "tag"))


@query("n05_ranks", "SELECT equip_id, ts, ntile(4) OVER w AS q, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM scores WINDOW w AS (PARTITION BY equip_id ORDER BY fused, ts)", "pr cd")
def _(s, d):
    w = W.partitionBy(E).orderBy("fused", "ts")
    return f.scores(s, d).select(E, "ts", F.ntile(4).over(w).cast("long").alias("q"), F.percent_rank().over(w).alias("pr"), F.cume_dist().over(w).alias("cd"))
