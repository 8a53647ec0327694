"""Models by piece of equipment, whole batches, settings and small helpers."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwatch.operators import assets, batch, regimes, rolling, runs
from plantwatch.sources import sinks

T0 = datetime(2024, 1, 1)
COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    """Two pieces of equipment of different levels and correlations, and one of too few rows; a null and an infinite value."""
    r = np.random.default_rng(5)
    rows = []
    for equip, n in ((1, 200), (2, 150), (3, 10)):
        x = r.normal(size=(n, 3)) @ np.array([[1, 0.8 * (equip == 1), 0], [0, 0.6, 0], [0, 0.3, 1]]) * equip + 10 * equip
        for i, v in enumerate(x.tolist()):
            if i == 7:
                v[1] = None
            if i == 9:
                v[2] = float("inf")
            rows.append((equip, T0 + timedelta(minutes=i), "train" if i < n // 2 else "score", *v))
    return spark.createDataFrame(rows, "equip_id int, ts timestamp_ntz, split string, a double, b double, c double").cache()


def clean(frame, equip):
    """The equipment's rows filled by training medians, and its training part."""
    p = frame.where(F.col("equip_id") == equip).orderBy("ts").toPandas()
    x = p[COLUMNS].to_numpy(float)
    train = (p.split == "train").to_numpy()
    fill = [np.median(c[np.isfinite(c)]) for c in x[train].T]
    return np.where(np.isfinite(x), x, fill), train


def scored(df, *names):
    return {e: np.array([[r[n] for n in names] for r in df.where(F.col("equip_id") == e).orderBy("ts").collect()], float) for e in (1, 2, 3)}


def test_models_by_equipment(frame):
    train = frame.where("split = 'train'")
    got = scored(assets.score_mahalanobis(frame, assets.fit_mahalanobis(train, COLUMNS), COLUMNS), "score")
    pca = scored(assets.score_subspace(frame, assets.fit_subspace(train, COLUMNS, 2), COLUMNS, 2), "pca_spe", "pca_t2")
    omr = {k: scored(assets.score_reconstruction(frame, assets.fit_reconstruction(train, COLUMNS, k), COLUMNS), "omr_z") for k in ("linear", "pca", "pls")}
    for e in (1, 2):
        x, t = clean(frame, e)
        d = x - x[t].mean(axis=0)
        inverse = np.linalg.inv(np.cov(x[t].T) + 1e-3 * np.eye(3))
        assert np.allclose(got[e][:, 0], np.sqrt(np.einsum("ni,ij,nj->n", d, inverse, d)))
        z = d / x[t].std(axis=0)
        values, vectors = np.linalg.eigh(np.cov(z[t].T))
        top = vectors[:, ::-1][:, :2]
        assert np.allclose(pca[e][:, 0], ((z - z @ top @ top.T) ** 2).sum(axis=1)) and np.allclose(pca[e][:, 1], ((z @ top) ** 2 / values[::-1][:2]).sum(axis=1))
        # ridge of each column on the others, with the normal equations of n rows
        s, n = np.cov(z[t].T), t.sum()
        rest = z.copy()
        for j in range(3):
            o = [i for i in range(3) if i != j]
            rest[:, j] = z[:, j] - z[:, o] @ np.linalg.solve(s[np.ix_(o, o)] * n + np.eye(2), s[o, j] * n)
        norm = np.sqrt((rest**2).sum(axis=1))
        assert np.allclose(omr["linear"][e][:, 0], np.minimum(10, norm / norm[t].std()))
        assert all(np.isfinite(v[e]).all() for v in omr.values())
    # too few rows: no model, and null scores
    assert np.isnan(got[3]).all() and np.isnan(pca[3]).all() and np.isnan(omr["pls"][3]).all()


def test_healthy_rows_only_where_there_are_enough(frame):
    labelled = frame.withColumn("regime_label", F.when((F.col("equip_id") == 1) & (F.minute("ts") >= 30), 1).when((F.col("equip_id") == 2) & (F.col("ts") > F.lit(T0 + timedelta(minutes=5)).cast("timestamp_ntz")), 4).otherwise(0))
    kept = {r.equip_id: r.n for r in assets.healthy(labelled, least=20).groupBy("equip_id").agg(F.count("*").alias("n")).collect()}
    assert kept[1] == labelled.where("equip_id = 1 and regime_label = 0").count() < 200 and kept[2] == 150 and kept[3] == 10


def test_batch(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = []
    for equip in (1, 2):
        for i in range(240):
            shift = 6.0 if equip == 2 and 200 <= i < 220 else 0.0
            base = r.normal()
            rows += [(equip, t, T0 + timedelta(hours=i), 0, 0, float(k * base + r.normal() * 0.3 + shift * k)) for k, t in ((1, "a"), (2, "b"), (3, "c"))]
    df = spark.createDataFrame(rows, "equip_id int, tag string, ts timestamp_ntz, seq long, quality int, value double")
    found = batch.run(df, batch.Settings(COLUMNS, keep=lambda x: x.cache()))
    peak = found["scores"].orderBy(F.desc("fused")).limit(12).collect()
    assert sum(x.equip_id == 2 and T0 + timedelta(hours=198) <= x.ts < T0 + timedelta(hours=222) for x in peak) >= 10
    assert {x.equip_id for x in found["zones_by_day"].select("equip_id").distinct().collect()} == {1, 2}
    some = {k: found[k] for k in ("scores", "defect_summary")}
    batch.write(some, str(tmp_path), "r1", spark.createDataFrame([("r1", 1, "OK")], "run_id string, equip_id int, outcome string"))
    assert sinks.read_published(spark, str(tmp_path), "scores").count() == found["scores"].count() == 480


def test_auto_k_finds_planted_clusters(spark):
    r = np.random.default_rng(1)
    rows = [(0, T0 + timedelta(minutes=i), *(r.normal(size=2) * 0.2 + [(0, 0), (5, 0), (0, 5)][i % 3]).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "equip_id int, ts timestamp_ntz, a double, b double")
    found, labels = regimes.fit_auto_k(df, ["a", "b"], 2, 5)
    assert found.k == 3 and labels.columns == [*df.columns, "regime_label"]
    groups = {}
    for x in labels.collect():
        groups.setdefault(int((x.ts - T0).total_seconds() // 60) % 3, set()).add(x.regime_label)
    assert sorted(map(len, groups.values())) == [1, 1, 1] and len(set.union(*groups.values())) == 3


def test_array_energies_agree(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=n).tolist()) for i, n in enumerate((4, 5, 8, 33, 64))]
    df = spark.createDataFrame(rows, "i int, l array<double>")
    got = df.select("i", rolling.fourier_energy("l").alias("f"), F.array(*rolling.band_energy("l", 8)).alias("g")).orderBy("i").collect()
    for (_, x), y in zip(rows, got, strict=True):
        p = np.abs(np.fft.rfft(np.array(x) - np.mean(x))) ** 2
        share = 2 * np.arange(len(p)) / len(x)
        want = [p[(share >= a) & (share < b)].sum() for a, b in rolling.BANDS]
        assert np.allclose(y.f, want) and np.allclose(y.g, want)


def test_config_tells_of_changes():
    config, told = runs.Config([("a.b", "1", "int"), ("a.c", "x", "string")]), []
    config.on_update(lambda *x: told.append(x))
    config.update("a.b", 2)
    config.update("d.e", [1])
    assert (config.get("a.b"), config.get("a.c"), config.get("d.e"), config.get("d.f", 5)) == (2, "x", [1], 5)
    assert told == [("a.b", 1, 2), ("d.e", None, [1])]


def test_timer_counts_calls_that_fail_too():
    timer = runs.Timer()

    @timer.wrap("work")
    def work(x):
        return 1 / x

    assert work(2) == 0.5
    with pytest.raises(ZeroDivisionError):
        work(0)
    assert list(timer.seconds) == ["work"] and timer.seconds["work"] >= 0


def test_files_for_people(spark, tmp_path):
    df = spark.createDataFrame([(1, T0, 1234567.891, "x"), (2, None, 0.000123456789, None), (3, T0, 0.0, "y")], "equip_id int, ts timestamp_ntz, v double, s string")
    text = {x.equip_id: (x.ts, x.v) for x in sinks.as_text(df).collect()}
    assert text == {1: ("2024-01-01 00:00:00", 1234570.0), 2: (None, 0.000123457), 3: ("2024-01-01 00:00:00", 0.0)}
    sinks.write_json_lines(df, str(tmp_path / "j"))
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "j")).collect()]
    assert len(lines) == 3 and all(set(x) == set(df.columns) for x in lines)
    kept = sinks.Artifacts()
    kept.put("t", df)
    assert kept.get("t").count() == 3 and kept.get("u") is None
    kept.drop()
    assert kept.get("t") is None


def test_text_has_the_digits_of_c(spark):
    values = [0.0654095, 4598185.0, -4.717255, 1.084075e-12, -61651180000.0, 999999.5, 0.9999995, 100000.5, 1e-310, 5e-324, 1.7976931348623157e308, 1e23, 3.0, -0.0]
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(values)] + [(99, float("nan"), 1.0)], "i int, v double, u double")
    got = {x.i: x for x in sinks.as_text(df).collect()}
    assert [got[i].v for i in range(len(values))] == [float("%.5e" % v) for v in values]
    assert got[99].v != got[99].v and got[99].u == 1.0 and all(got[i].u is None for i in range(len(values)))
    assert sinks.as_text(df.where("i = 2").select("v"), digits=3).collect()[0].v == -4.72
    far = spark.createDataFrame([(float("inf"), -float("inf"))], "a double, b double")
    assert tuple(sinks.as_text(far).collect()[0]) == (float("inf"), -float("inf"))
