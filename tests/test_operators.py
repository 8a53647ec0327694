"""Rules that the driver's tables can't reach, on hand-made frames, against numpy and pandas."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plantwatch.functions import scalar
from plantwatch.operators import cleaning, detectors, forecasting, history, islands, regimes, rolling, runs, scoring, tables
from plantwatch.sources import readers, sinks

T0 = datetime(2024, 1, 1)


def series(spark, values, column="fused", equip=0, step=60, schema="double"):
    rows = [(equip, T0 + timedelta(seconds=step * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"equip_id int, ts timestamp_ntz, {column} {schema}")


def collected(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("equip_id", "ts").collect()]


# scalars


def test_zones_and_status(spark):
    df = spark.createDataFrame([(float(x),) for x in (0.0, 70.0, 70.1, 85.0, 85.1, 100.0)], "h double")
    assert [r[0] for r in df.select(scalar.zone("h")).collect()] == ["ALERT", "ALERT", "WATCH", "WATCH", "GOOD", "GOOD"]
    assert [r[0] for r in df.select(scalar.status("h")[0]).collect()] == ["ALERT", "CAUTION", "CAUTION", "HEALTHY", "HEALTHY", "HEALTHY"]


def test_norm_cdf(spark):
    xs = [-8.0, -1.5, 0.0, 0.3, 4.0]
    for a, b, x in ((r.a, r.b, r.x) for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalar.norm_cdf("x").alias("a"), scalar.norm_cdf_sql("x").alias("b")).collect()):
        want = 0.5 * (1 + math.erf(x / math.sqrt(2)))
        assert abs(a - want) < 1e-12 and abs(b - want) < 1e-6


def test_finite_and_sink_values(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(scalar.finite("x")).collect()] == [1.0, None, None, None]


# cleaning


def test_fill_and_interpolate(spark):
    df = series(spark, [None, 1.0, None, None, 4.0, None], "x")
    assert collected(cleaning.fill(df, ["x"], "interpolate"), "x") == [(1.0,), (1.0,), (2.0,), (3.0,), (4.0,), (4.0,)]
    assert collected(cleaning.fill(df, ["x"], "ffill"), "x") == [(None,), (1.0,), (1.0,), (1.0,), (4.0,), (4.0,)]
    assert collected(cleaning.fill(df, ["x"], "median"), "x")[0] == (2.5,)
    assert collected(cleaning.fill(df, ["x"], "none"), "x")[0] == (None,)


def test_resample_limits_and_strictness(spark):
    df = series(spark, list(range(10)), "x", schema="long").where("x in (0, 1, 6, 9)").withColumn("x", F.col("x").cast("double"))
    got = collected(cleaning.resample(df, ["x"], 60, 60), "x")
    assert got == [(0.0,), (1.0,), (2.0,), (None,), (None,), (5.0,), (6.0,), (7.0,), (8.0,), (9.0,)]
    with pytest.raises(Exception, match="too many"):
        cleaning.resample(df, ["x"], 60, 60, max_fill_ratio=0.2).collect()


def test_duplicates_and_future(spark):
    rows = [(0, T0, 1, 1.0), (0, T0, 2, 2.0), (0, T0 + timedelta(days=1), 3, 3.0), (0, None, 4, 4.0)]
    df = spark.createDataFrame(rows, "equip_id int, ts timestamp_ntz, seq int, value double")
    assert cleaning.keep_last(df.where("ts is not null"), ["equip_id", "ts"], "seq").count() == 2
    as_of = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    assert [r.seq for r in cleaning.drop_future(df, as_of).orderBy("seq").collect()] == [1, 2]
    assert tuple(cleaning.future_report(df, as_of).first()) == (4, 1, 1)


# rolling features


@pytest.mark.parametrize("width", [1, 3, 4, 16])
def test_rolling_equals_pandas(spark, width):
    r = np.random.default_rng(width)
    x = np.concatenate([r.normal(size=40), np.full(20, 3.0)])
    df = series(spark, x.tolist(), "x")
    got = rolling.features(df, ["x"], width).orderBy("ts").toPandas()
    s = pd.Series(x)
    w = s.rolling(width, min_periods=1)
    mad = w.apply(lambda v: np.median(np.abs(v - np.median(v))), raw=True)
    slope = w.apply(lambda v: np.polyfit(np.arange(len(v)), v, 1)[0] if len(v) > 1 else 0.0, raw=True)
    for name, want in {"med": w.median(), "mad": mad, "mean": w.mean(), "std": w.std().fillna(0), "slope": slope, "skew": w.skew().fillna(0), "kurt": w.kurt().fillna(0)}.items():
        steady = w.std().fillna(0) > 1e-9
        assert np.allclose(got[f"x_{name}"][steady], want[steady], atol=1e-6), name
    energy = np.zeros((len(x), 3))
    for i in range(len(x)):
        v = x[max(0, i - width + 1) : i + 1]
        if len(v) >= max(1, width // 2):
            p, f = np.abs(np.fft.rfft(v - v.mean())) ** 2, np.arange(len(v) // 2 + 1) / len(v) * 2
            energy[i] = [p[(f >= a) & (f < b)].sum() for a, b in rolling.BANDS]
    assert np.allclose(got[["x_energy_0", "x_energy_1", "x_energy_2"]], energy, atol=1e-6)


# islands, joins


def test_first_row_rules(spark):
    fused = series(spark, [3.0, 3.0, 0.0, 3.0])
    assert collected(tables.threshold_crossings(fused), "direction") == [("up",), ("down",), ("up",)]
    assert collected(tables.zone_changes(fused), "from_zone", "to_zone") == [("START", "ALERT"), ("ALERT", "GOOD"), ("GOOD", "ALERT")]
    labels = series(spark, [1, 1, 2, 1], "regime_label", schema="int").withColumn("fused", F.lit(0.0))
    assert {(r.from_label, r.to_label, r.n) for r in tables.regime_transitions(labels).collect()} == {(1, 2, 1), (2, 1, 1)}
    stable = {r.metric_name: r.metric_value for r in tables.regime_stability(labels).collect()}
    assert stable["total_transitions"] == 3 and stable["churn_rate"] == 75
    dwell = {r.regime_label: (r.runs, r.min_seconds, r.max_seconds) for r in tables.regime_dwell(labels).collect()}
    assert dwell == {1: (2, 0.0, 60.0), 2: (1, 0.0, 0.0)}
    assert {r.regime_label: r.avg_dwell_seconds for r in tables.regime_stats(labels).collect()} == {1: 60.0, 2: 60.0}


def test_drift_event_runs_to_the_row_after(spark):
    df = series(spark, [0.0, 4.0, 5.0, 1.0, 6.0], "cusum_z")
    got = [(r.segment_start, r.segment_end, r.value) for r in tables.drift_events(df).orderBy("segment_start").collect()]
    at = [T0 + timedelta(seconds=60 * i) for i in range(5)]
    assert got == [(at[1], at[3], 5.0), (at[4], at[4], 6.0)]


def test_nearest_tie_goes_to_the_later(spark):
    left = series(spark, [0.0] * 5, "x").drop("x")
    right = spark.createDataFrame([(0, T0 - timedelta(seconds=60), 1.0), (0, T0 + timedelta(seconds=60), 2.0)], "equip_id int, ts timestamp_ntz, v double")
    assert collected(islands.nearest(left, right, "v"), "v")[0] == (2.0,)
    assert collected(islands.asof(left, right, "v"), "v")[:2] == [(1.0,), (2.0,)]
    assert collected(islands.asof(left, right.where("v > 5"), "v"), "v")[0] == (None,)


def test_histogram_closes_the_last_bin(spark):
    got = {r.health_bin: r.record_count for r in tables.health_histogram(series(spark, [0.0, 0.0, 3.0])).collect()}
    assert got["90-100"] == 2 and got["10-20"] == 1 and len(got) == 10 and got["0-10"] == 0


def test_hotspot_of_equal_peaks_is_the_earliest(spark):
    rows = [(0, "a", T0 + timedelta(seconds=i), 1.0, z, 0.0, 1.0) for i, z in enumerate([1.0, -4.0, 4.0, 2.0])]
    df = spark.createDataFrame(rows, "equip_id int, tag string, ts timestamp_ntz, value double, z double, train_mean double, train_std double")
    r = tables.hotspots(df).first()
    assert (r.max_ts, r.max_signed_z, r.above_warn, r.above_alert) == (T0 + timedelta(seconds=1), -4.0, 3, 2)


# history


def test_dead_band(spark):
    rows = [(0, "a", T0 + timedelta(seconds=i), i, v) for i, v in enumerate([10.0, 10.4, 10.6, None, 10.0, 0.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "equip_id int, tag string, ts timestamp_ntz, seq int, value double")
    kept = sorted(r.seq for r in history.dead_band(df, 5.0).collect())
    # 10.6 -> 10.0 is a change of 5.66 %; from 0 every change is compared with 1
    assert kept == [0, 2, 3, 4, 5, 7]


def test_cyclic_cells_are_half_open(spark):
    rows = [(0, "a", T0 + timedelta(seconds=s), s, float(s)) for s in (0, 30, 60, 61, 200)] + [(0, "b", T0 + timedelta(seconds=90), 1, 9.0)]
    df = spark.createDataFrame(rows, "equip_id int, tag string, ts timestamp_ntz, seq int, value double")
    got = history.cyclic(df, "2024-01-01 00:00:00", "2024-01-01 00:04:00", 60, ["a", "b"])
    a = [r.value for r in got.where("tag = 'a'").orderBy("ts").collect()]
    b = [r.value for r in got.where("tag = 'b'").orderBy("ts").collect()]
    assert a == [0.0, 60.0, 61.0, 61.0, 200.0] and b == [None, None, 9.0, 9.0, 9.0]


def test_safe_names():
    assert history.safe_names(["A.B (x)", "A B x", "·"]) == {"A.B (x)": "a_b__x", "A B x": "a_b_x", "·": "sensor"}


# scoring


def brute_episodes(x, ts, k, h, min_len, gap, least):
    mu, sd = np.mean(x), np.std(x) if np.std(x) > 1e-9 else 1.0
    s, start, out = 0.0, None, []
    for i, v in enumerate(x):
        s = max(0.0, s + v - mu - k * sd)
        if start is None and s > 0:
            start = i
        if start is not None and s > h * sd:
            if i - start + 1 >= min_len:
                if out and start - out[-1][1] - 1 <= gap:
                    out[-1][1] = i
                else:
                    out.append([start, i])
            s, start = 0.0, None
    return [(ts[a], ts[b], b - a + 1) for a, b in out if (ts[b] - ts[a]).total_seconds() >= least]


def test_episodes(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=100), r.normal(3, 1, 20), r.normal(size=60), r.normal(4, 1, 10), r.normal(size=30)])
    df = series(spark, x.tolist())
    ts = [T0 + timedelta(seconds=60 * i) for i in range(len(x))]
    got = [(e.start_ts, e.end_ts, e.len) for e in scoring.episodes(df, h_sigma=3.0).orderBy("episode_id").collect()]
    assert got == brute_episodes(x, ts, 0.5, 3.0, 3, 5, 60.0) and got
    named = scoring.normalise_episodes(scoring.name_episodes(scoring.episodes(df, h_sigma=3.0), df.withColumn("a_z", F.col("fused"))), df.withColumn("regime_label", F.lit(1)))
    assert {(e.culprits, e.regime) for e in named.collect()} == {("a", 1)}


def test_cusum_closed_form(spark):
    x = np.random.default_rng(2).normal(0.1, 1, 200)
    got = scoring.cusum(series(spark, x.tolist(), "x"), k=0.3).orderBy("ts").toPandas()
    p = n = 0.0
    for i, v in enumerate(x):
        p, n = max(0.0, p + v - 0.3), max(0.0, n - v - 0.3)
        assert abs(got.cusum_pos[i] - p) < 1e-9 and abs(got.cusum_neg[i] - n) < 1e-9


def test_constant_detector_and_small_regimes(spark):
    df = series(spark, [5.0] * 30, "score").withColumn("detector", F.lit("a"))
    r = scoring.calibrate(df).first()
    assert (r["median"], r.scale) == (5.0, 1.0)
    two = df.withColumn("regime_label", F.when(F.col("ts") < F.lit(T0 + timedelta(seconds=300)), 1).otherwise(2)).withColumn("score", F.rand(1))
    rows = {x.regime_label: x for x in scoring.calibrate_by_regime(two).collect()}
    assert rows[1]["median"] == scoring.calibrate(two).first()["median"] != rows[2]["median"]


def test_fuse_without_weights(spark):
    df = series(spark, [1.0, 2.0, 3.0], "a_z").withColumn("b_z", F.lit(0.0))
    got = [r.fused for r in scoring.fuse(df, {}).orderBy("ts").collect()]
    assert np.allclose(got, np.array([-1, 0, 1]) * math.sqrt(1.5) / 2)


def test_alert_mode_has_hysteresis(spark):
    df = spark.createDataFrame([(1, 0.1, 2.5, 0.0), (2, 0.1, 2.5, 0.0), (3, 0.1, 3.5, 0.0)], "equip_id int, slope double, p95 double, volatility double")
    was = spark.createDataFrame([(1, "DRIFT"), (2, "FAULT"), (3, "FAULT")], "equip_id int, mode string")
    assert {r.equip_id: r.mode for r in scoring.alert_mode(df, was).collect()} == {1: "DRIFT", 2: "FAULT", 3: "DRIFT"}


# detectors


@pytest.fixture(scope="module")
def plant(spark):
    r = np.random.default_rng(42)
    x = r.normal(size=(300, 3))
    x[:, 1] += 0.7 * x[:, 0]
    x[275, 1] += 8
    rows = [(0, T0 + timedelta(seconds=60 * i), *map(float, v)) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "equip_id int, ts timestamp_ntz, s1 double, s2 double, s3 double").cache()


S = ["s1", "s2", "s3"]


def test_mahalanobis(plant):
    x, df = plant
    got = detectors.Mahalanobis(S).fit(df).score(df).orderBy("ts").toPandas().score.to_numpy()
    inv = np.linalg.pinv(np.cov(x.T) + 1e-3 * np.eye(3))
    c = x - x.mean(axis=0)
    assert np.allclose(got, np.sqrt(np.einsum("ij,jk,ik->i", c, inv, c)), atol=1e-8)


def test_subspace(plant):
    x, df = plant
    got = detectors.Subspace(S, most=2).fit(df).score(df).orderBy("ts").toPandas()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    u, s, v = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    t = z @ v[:2].T
    assert np.allclose(got.pca_spe, ((z - t @ v[:2]) ** 2).sum(axis=1), atol=1e-8)
    assert np.allclose(got.pca_t2, (t**2 / (s[:2] ** 2 / (len(z) - 1))).sum(axis=1), atol=1e-6)


@pytest.mark.parametrize("kind", ["linear", "pls", "pca"])
def test_reconstruction_finds_the_break(plant, kind):
    _, df = plant
    model = detectors.Reconstruction(S, kind=kind, components=2).fit(df.where(F.col("ts") < F.lit(T0 + timedelta(seconds=60 * 270))))
    got = model.score(df).orderBy("ts").toPandas().omr_z
    assert got.idxmax() == 275 and got[275] > 3
    top = detectors.top_contributors(model.contributions(df), str(T0 + timedelta(seconds=60 * 275)), 1).first()
    assert top.sensor in ("s1", "s2")


def test_choice():
    assert [detectors.choose_omr(*a) for a in ((50, 100), (2000, 10), (200, 10))] == ["pca", "linear", "pls"]


def test_outlier_scores(plant):
    _, df = plant
    iso = detectors.IsolationForest(S, trees=50).fit(df).score(df).orderBy("ts").toPandas().iforest
    gmm = detectors.DiagonalMixture(S).fit(df).score(df).orderBy("ts").toPandas().gmm
    assert iso.rank(ascending=False)[275] <= 5 and gmm.idxmax() == 275 and ((iso > 0) & (iso <= 1)).all()
    hst = detectors.half_space_scores(df, S, [-5.0] * 3, [5.0] * 3, trees=10, height=5).toPandas()
    assert len(hst) == 300 and hst.hst.between(0, 1).all()


def test_merge_moments():
    a, b = np.arange(5.0), np.arange(7.0) * 3
    part = lambda v: (len(v), v.mean(), ((v - v.mean()) ** 2).sum())
    assert np.allclose(detectors.merge_moments(part(a), part(b)), part(np.concatenate([a, b])))


# regimes


def test_hold():
    assert regimes.hold([1, 1, 1, 2, 1, 1, 1], 2) == [1] * 7
    assert regimes.hold([2, 1, 1, 1, 3, 3], 2) == [1, 1, 1, 1, 3, 3]
    assert regimes.hold([1, 1, 2, 3, 3, 3], 2, {1: 1.0}) == [1, 1, 1, 3, 3, 3]
    assert regimes.hold([5], 3) == [5]


def plain_hold(labels, least, health=None, times=None, seconds=None):
    """The same rule with a search from the start after every change."""
    out = list(labels)
    while True:
        runs, a = [], 0
        for b in range(1, len(out) + 1):
            if b == len(out) or out[b] != out[a]:
                runs.append((a, b, out[a]))
                a = b
        short = [k for k, (a, b, _) in enumerate(runs) if (times[b - 1] - times[a] < seconds if seconds is not None else b - a < least) and len(runs) > 1]
        if not short:
            return out
        near = [runs[k] for k in (short[0] - 1, short[0] + 1) if 0 <= k < len(runs)]
        a, b, _ = runs[short[0]]
        out[a:b] = [max(near, key=lambda r: ((health or {}).get(r[2], 0.0), r[1] - r[0]))[2]] * (b - a)


def test_hold_against_a_plain_search():
    r = random.Random(6)
    for _ in range(600):
        labels = [r.randint(0, 3) for _ in range(r.randint(0, 30))]
        times = sorted(r.uniform(0, 100) for _ in labels)
        health = r.choice([None, {0: 1.0, 2: 0.5}])
        least = r.randint(1, 6)
        assert regimes.hold(labels, least, health) == plain_hold(labels, least, health)
        assert regimes.hold(labels, 0, health, times, 12.0) == plain_hold(labels, 0, health, times, 12.0)
    assert len(regimes.hold([1, 2] * 100_000, 3)) == 200_000


def test_grid_of_milliseconds(spark):
    rows = [(1, "a", f"2024-01-01 00:00:00.00{i}", i, 0, float(i)) for i in (1, 4, 6)]
    df = spark.createDataFrame(rows, "equip_id int, tag string, ts string, seq long, quality int, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = history.cyclic(df, "2024-01-01 00:00:00", "2024-01-01 00:00:00.008", 0.001, ["a"]).orderBy("ts").collect()
    assert [x.value for x in got] == [None, 1.0, 1.0, 1.0, 4.0, 4.0, 6.0, 6.0, 6.0] and [x.ts.microsecond for x in got] == [1000 * i for i in range(9)]


def test_dwell_in_seconds(spark):
    rows = [(1, i * 60, 1 if i < 5 else 2 if i < 7 else 1, "x") for i in range(12)]
    df = spark.createDataFrame(rows, "equip_id int, s int, regime_label int, extra string").select("equip_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "regime_label", "extra")
    assert {x.regime_label for x in regimes.min_dwell(df, 0, seconds=61).collect()} == {1} and regimes.min_dwell(df, 0, seconds=60).where("regime_label = 2").count() == 2
    assert regimes.min_dwell(df, 0, seconds=61).columns == df.columns


def test_smooth_repeats_the_ends(spark):
    got = collected(regimes.smooth(series(spark, [0, 1, 1, 0, 1, 1, 9], "regime_label", schema="int"), 3), "regime_label")
    assert got == [(0,), (1,), (1,), (1,), (1,), (1,), (9,)]


def test_regimes_are_found_and_ordered(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.2, (60, 2)), r.normal(5, 0.2, (60, 2))])
    df = spark.createDataFrame([(0, T0 + timedelta(seconds=i), *map(float, v)) for i, v in enumerate(x)], "equip_id int, ts timestamp_ntz, a double, b double")
    model = regimes.fit_regimes(df, ["a", "b"], 2, 3)
    assert model.k == 2 and collected(model.predict(df), "regime_label") == [(0,)] * 60 + [(1,)] * 60


def test_transients(spark):
    df = series(spark, [0.0, 0.5, 0.0, 0.0, 0.2, 0.15, 0.0], "roc").withColumn("regime_label", F.when(F.col("roc") == 0.15, 2).otherwise(1))
    assert collected(regimes.transients(df, hold_rows=1), "transient_state") == [("steady",), ("trip",), ("trip",), ("steady",), ("transient",), ("startup",), ("startup",)]


# forecasts


def test_quadratic(spark):
    y = [2.0 + 0.5 * i - 0.01 * i * i for i in range(40)]
    got = [r.forecast for r in forecasting.quadratic(series(spark, y, "y"), 5).orderBy("h").collect()]
    assert np.allclose(got, [2.0 + 0.5 * i - 0.01 * i * i for i in range(40, 45)], atol=1e-6)


def test_failure_is_never_crossed(spark):
    y = [90.0 + (i % 3) for i in range(30)]
    points = forecasting.forecast(forecasting.fit(series(spark, y, "y")), 10, low=0.0, high=100.0)
    r = forecasting.failure(points).first()
    assert r.rul_steps == 10 and r.failure_ts is None and not r.crossed
    assert forecasting.maintenance_window(forecasting.failure_probability(points)).first().window_start is None


def test_patterns_and_actions(spark):
    df = spark.createDataFrame([(1, "a", 3.0, 6.0, 4, 0.2), (1, "b", 2.5, 3.0, 0, -0.2), (2, "a", 0.1, 0.2, 0, 0.0)], "equip_id int, detector string, mean_z double, max_z double, spikes long, slope double")
    got = {r.equip_id: r.patterns for r in forecasting.patterns(df).collect()}
    assert got == {1: ["spike", "drift", "correlation_break", "decay"], 2: []}
    assert forecasting.actions(forecasting.patterns(df)).count() == 4


# sources, sinks, runs


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Stamp,Flow.A (m),B\n2024-01-01 00:00:00,1.5,x\n2024-01-01 00:01:00,,2\n")
    got = readers.read_csv(spark, str(p), equip_id=7)
    assert got.columns == ["equip_id", "ts", "flow_a__m", "b"] and collected(got, "flow_a__m", "b") == [(1.5, None), (None, 2.0)]
    (tmp_path / "b.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        readers.read_csv(spark, str(tmp_path / "b.csv"))


def test_load(spark):
    df = series(spark, [float(i) for i in range(20)], "x").withColumn("y", F.lit(1))
    got = readers.load(df)
    assert {r.split: r.n_rows for r in readers.load_meta(got).collect()} == {"train": 12, "score": 8}
    with pytest.raises(ValueError, match="fewer"):
        readers.load(df.limit(5))
    assert set(readers.load(df, df.drop("y")).columns) == {"equip_id", "ts", "x", "split"}


def test_writes_and_models(spark, tmp_path):
    root = str(tmp_path / "out")
    df = series(spark, [1.0, float("nan")], "x")
    sinks.write_all({"t": df}, root, "r1", spark.createDataFrame([("r1",)], "run_id string"))
    sinks.write_table(df, f"{root}/t", "r2")
    assert sinks.read_published(spark, root, "t").count() == 2
    sinks.replace_partitions(df.withColumn("equip_id", F.lit(3)), f"{root}/u")
    sinks.replace_partitions(df.limit(1).withColumn("equip_id", F.lit(4)), f"{root}/u")
    sinks.replace_partitions(df.limit(1).withColumn("equip_id", F.lit(3)), f"{root}/u")
    assert {r.equip_id: r["count"] for r in spark.read.parquet(f"{root}/u").groupBy("equip_id").count().collect()} == {3: 1, 4: 1}
    assert [sinks.save_model(df, root, "m", s) for s in ("a", "b")] == [1, 2]
    assert sinks.load_model(spark, root, "m").first().signature == "b" and sinks.load_model(spark, root, "m", 1).first().signature == "a"
    assert sinks.model_valid("a", ["x"], "a", ["x"]) == (True, []) and not sinks.model_valid("a", ["x"], "b", ["y"])[0]


def test_configuration():
    rows = [("a.k", "3", "int"), ("a.h", "2.5", "float"), ("a.on", "yes", "bool"), ("b", "[1, 2]", "list"), ("c", "x", "string"), ("b.c", "1", "int")]
    got = runs.nested(rows)
    assert got["a"] == {"k": 3, "h": 2.5, "on": True} and got["c"] == "x" and got["b"] == {"c": 1}
    assert runs.signature({"a": 1, "b": 2}) == runs.signature({"b": 2, "a": 1}) and len(runs.signature({})) == 16


def test_runs(spark):
    eq = spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], "equip_id int, code string, db string")
    new = spark.createDataFrame([("B", None), ("C", "z")], "code string, db string")
    assert {tuple(r) for r in runs.register(eq, new).select("equip_id", "code", "db").collect()} == {(1, "A", "x"), (2, "B", "y"), (3, "C", "z")}
    done = spark.createDataFrame([("r1", 1, T0 + timedelta(hours=2), "OK"), ("r2", 1, T0 + timedelta(hours=9), "FAIL")], "run_id string, equip_id int, window_end timestamp_ntz, outcome string")
    h = spark.createDataFrame([(2, T0)], "equip_id int, ts timestamp_ntz")
    got = {r.equip_id: (r.window_start, r.window_end) for r in runs.next_window(eq, done, h, 30, F.lit(T0)).collect()}
    assert got == {1: (T0 + timedelta(hours=2), T0 + timedelta(hours=2, minutes=30)), 2: (T0, T0 + timedelta(minutes=30))}
    state = spark.createDataFrame([(1, 490, 1), (2, 10, 2), (3, 0, 0)], "equip_id int, rows long, attempts long")
    fresh = spark.createDataFrame([(1,)] * 10 + [(4,)], "equip_id int")
    assert {r.equip_id: r.status for r in runs.coldstart(state, fresh).collect()} == {1: "COMPLETE", 2: "FAILED", 3: "PENDING", 4: "IN_PROGRESS"}
    same = runs.data_signature(eq).first()
    assert runs.data_signature(eq.orderBy(F.desc("code"))).first() == same


def test_every_nth_and_tail(spark):
    df = series(spark, [float(i) for i in range(10)], "x").withColumn("seq", F.row_number().over(W.orderBy("ts")))
    assert collected(cleaning.every_nth(df, 3), "x") == [(0.0,), (3.0,), (6.0,), (9.0,)]
    assert collected(history.tail_buffer(df, 0.05, 2), "x") == [(8.0,), (9.0,)]


def test_random_interval_join(spark):
    r = random.Random(3)
    spans = [(0, i, a, a + timedelta(seconds=r.randint(0, 400_000))) for i in range(20) for a in [T0 + timedelta(seconds=r.randint(0, 900_000))]]
    points = [(0, T0 + timedelta(seconds=r.randint(0, 1_200_000))) for _ in range(200)]
    got = islands.inside(spark.createDataFrame(points, "equip_id int, ts timestamp_ntz"), spark.createDataFrame(spans, "equip_id int, episode_id int, start_ts timestamp_ntz, end_ts timestamp_ntz"))
    want = sorted((t, i) for _, t in points for _, i, a, b in spans if a <= t <= b)
    assert sorted((x.ts, x.episode_id) for x in got.collect()) == want


def test_constant_series_have_no_correlation(spark):
    df = series(spark, [1.0, 1.0, 1.0, 2.0], "a_z").withColumn("b_z", F.lit(0.0)).withColumn("c_z", F.col("a_z") * 2)
    got = {(r.detector_a, r.detector_b): r.pearson_r for r in tables.detector_correlation(df).collect()}
    assert got == {("a_z", "b_z"): 0.0, ("a_z", "c_z"): pytest.approx(1.0), ("b_z", "c_z"): 0.0}
    rows = collected(rolling.lag_pairs(df, ["a_z", "b_z"], 1, 3), "a_z_b_z_lag0", "b_z_a_z_lag1")
    assert rows == [(None, None)] * 4
    still = series(spark, [5.0] * 30, "y")
    assert forecasting.suitability(still).first().score == 1.5
    zero = series(spark, [0.0] * 4).withColumn("a_z", F.lit(0.0))
    spans = spark.createDataFrame([(0, 1, T0, T0 + timedelta(hours=1))], "equip_id int, episode_id int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    assert tables.episode_contributions(zero, spans).count() == 0
