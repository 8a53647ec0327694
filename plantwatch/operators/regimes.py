"""Operating regimes: clusters, smoothing, dwell and transient states."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plantwatch.functions.scalar import seconds_between
from plantwatch.operators.detectors import Subspace, filled, medians, moments
from plantwatch.operators.islands import islands

E = "equip_id"


def basis(df: DataFrame, columns: list[str], pca: Subspace, raw: list[str], k: int = 3) -> DataFrame:
    """The first k components beside raw columns, standardised by the whole frame: (equip_id, ts, b0..)."""
    ready, _, ts = pca.project(df)
    got = ready.select(E, "ts", *[t.alias(f"b{i}") for i, t in enumerate(ts[:k])], *[F.col(c).alias(f"b{min(k, len(ts)) + j}") for j, c in enumerate(raw)])
    names = [c for c in got.columns if c.startswith("b")]
    _, mean, cov = moments(got, names)
    sd = np.sqrt(np.diag(cov))
    return got.select(E, "ts", *[((F.col(n) - float(m)) / float(s if s > 1e-9 else 1.0)).alias(n) for n, m, s in zip(names, mean, sd, strict=True)])


@dataclass
class Regimes:
    columns: list[str]
    centers: np.ndarray
    silhouette: float
    k: int

    def predict(self, df: DataFrame, name: str = "regime_label") -> DataFrame:
        """The nearest centre, the lowest label of equals, as a JVM expression."""
        parts = []
        for i, c in enumerate(self.centers):
            d = F.lit(0.0)
            for n, v in zip(self.columns, c, strict=True):
                d = d + F.pow(F.coalesce(F.col(n), F.lit(0.0)) - float(v), F.lit(2.0))
            parts.append(F.struct(d.alias("d"), F.lit(i).alias("i")))
        return df.withColumn(name, F.array_min(F.array(*parts))["i"])


def fit_regimes(df: DataFrame, columns: list[str], k_min: int = 2, k_max: int = 6, seed: int = 17, most: int = 4000) -> Regimes:
    """K-means for each k; the best silhouette, judged on at most ``most`` rows, wins. Centres are ordered, so labels are stable."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(df.dropna(subset=columns)).select(E, "ts", "features").cache()
    judged = ready.orderBy(F.xxhash64(E, "ts")).limit(most)
    best = None
    try:
        for k in range(k_min, k_max + 1):
            model = KMeans(k=k, seed=seed, maxIter=50).fit(ready)
            s = ClusteringEvaluator().evaluate(model.transform(judged))
            if best is None or s > best.silhouette:
                centers = np.array(sorted(map(list, model.clusterCenters())))
                best = Regimes(columns, centers, float(s), k)
    finally:
        ready.unpersist()
    return best


def smooth(df: DataFrame, width: int = 5, passes: int = 1, label: str = "regime_label") -> DataFrame:
    """Median filter of an odd width; ends repeat their last value."""
    half = width // 2
    for _ in range(passes):
        order = W.partitionBy(E).orderBy("ts")
        values = F.collect_list(label).over(order.rowsBetween(-half, half))
        i, n = F.row_number().over(order), F.count("*").over(W.partitionBy(E))
        whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        head = F.array_repeat(F.first(label).over(whole), F.greatest(F.lit(0), F.lit(half + 1) - i).cast("int"))
        tail = F.array_repeat(F.last(label).over(whole), F.greatest(F.lit(0), i + half - n).cast("int"))
        df = df.withColumn("_s", F.element_at(F.array_sort(F.concat(head, values, tail)), half + 1)).drop(label).withColumnRenamed("_s", label)
    return df


def hold(labels: list[int], least: int, health: dict[int, float] | None = None, times: Sequence[float] | None = None, seconds: float | None = None) -> list[int]:
    """Runs shorter than the least take the neighbour with the better health, or else the longer one.

    With times and ``seconds``, a run is short if its last row comes less than so many seconds after its first. Short
    runs are settled from the left, each in its turn; what it becomes part of is looked at again, so one pass does.
    """
    by_time = seconds is not None and times is not None
    ahead, a = [], 0
    for b in range(1, len(labels) + 1):
        if b == len(labels) or labels[b] != labels[a]:
            ahead.append((a, b, labels[a]))
            a = b
    ahead.reverse()
    settled: list[tuple[int, int, int]] = []
    while ahead:
        a, b, label = ahead.pop()
        short = times[b - 1] - times[a] < seconds if by_time else b - a < least
        near = settled[-1:] + ahead[-1:]
        if not short or not near:
            settled.append((a, b, label))
            continue
        label = max(near, key=lambda r: ((health or {}).get(r[2], 0.0), r[1] - r[0]))[2]
        if settled and settled[-1][2] == label:
            a = settled.pop()[0]
        if ahead and ahead[-1][2] == label:
            b = ahead.pop()[1]
        ahead.append((a, b, label))
    return [label for a, b, label in settled for _ in range(a, b)]


def min_dwell(df: DataFrame, least: int, health: dict[int, float] | None = None, label: str = "regime_label", seconds: float | None = None) -> DataFrame:
    """Least dwell in rows, or in seconds if they are given; sequential by nature, so by piece of equipment, which a task holds whole."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts")
        times = frame["ts"].astype("int64").to_numpy() / 1e9 if seconds is not None else None
        return frame.assign(**{label: np.array(hold(frame[label].tolist(), least, health, times, seconds), "int32")})

    typed = df.withColumn(label, F.col(label).cast("int"))
    return typed.groupBy(E).applyInPandas(run, typed.schema)


def regime_health(scores: DataFrame, suspect: float = 1.5, critical: float = 3.0) -> DataFrame:
    """By regime: median fused, P95 of |fused|, share, dwell, transitions, stability 1 / (1 + transitions) and a state."""
    got = scores.groupBy(E, "regime_label").agg(F.count("*").alias("n"), F.percentile("fused", 0.5).alias("median_fused"), F.percentile(F.abs("fused"), 0.95).alias("p95_abs_fused"))
    runs = islands(scores, "regime_label").groupBy(E, "regime_label").agg(F.avg(seconds_between("start_ts", "end_ts")).alias("dwell_seconds"), F.count_if(F.col("next_ts").isNotNull()).alias("transitions"))
    state = F.when(F.col("median_fused") >= critical, "critical").when(F.col("median_fused") >= suspect, "suspect").otherwise("healthy")
    return got.join(runs, [E, "regime_label"]).withColumn("stability", 1.0 / (1.0 + F.col("transitions"))).withColumn("state", state)


def rate_of_change(df: DataFrame, columns: list[str], weights: dict[str, float] | None = None, rows: int = 10) -> DataFrame:
    """Weighted relative change of the columns, clipped at its P99, as a rolling mean."""
    order = W.partitionBy(E).orderBy("ts")
    total = sum((weights or {}).get(c, 1.0) for c in columns) or 1.0
    roc = F.lit(0.0)
    for c in columns:
        before = F.lag(c).over(order)
        roc = roc + (weights or {}).get(c, 1.0) / total * F.coalesce(F.abs(F.col(c) - before) / (F.abs(before) + 1e-9), F.lit(0.0))
    got = df.withColumn("_r", roc)
    top = got.groupBy(E).agg(F.percentile("_r", 0.99).alias("_p"))
    return got.join(top, E).withColumn("roc", F.avg(F.least("_r", "_p")).over(order.rowsBetween(-(rows - 1), 0))).drop("_r", "_p")


def transients(df: DataFrame, high: float = 0.1, trip: float = 0.3, hold_rows: int = 10) -> DataFrame:
    """trip, startup, shutdown, transient or steady by rate of change and label changes; a state holds for a number of rows.

    ``df`` has equip_id, ts, roc and regime_label. The timer is a state machine,
    run by piece of equipment.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts")
        roc, label = frame["roc"].to_numpy(float), frame["regime_label"].to_numpy()
        out, timer, state, before = [], 0, "steady", None
        for r, l in zip(roc, label, strict=True):
            changed = before is not None and l != before
            if r > trip:
                timer, state = hold_rows, "trip"
            elif changed and r > high:
                timer, state = hold_rows, "startup" if l > before else "shutdown"
            elif timer > 0:
                timer -= 1
            elif r > high:
                state = "transient"
            else:
                state = "steady"
            out.append(state)
            before = l
        return pd.DataFrame({"equip_id": frame["equip_id"], "ts": frame["ts"], "transient_state": out})

    return df.select(F.col(E).cast("int").alias(E), "ts", "roc", "regime_label").groupBy(E).applyInPandas(run, f"{E} int, ts timestamp_ntz, transient_state string")


def fit_auto_k(df: DataFrame, columns: list[str], k_min: int = 2, k_max: int = 6, pca_dim: int = 20, sil_sample: int = 4000, seed: int = 17) -> tuple[Regimes, DataFrame]:
    """K-means on robustly scaled columns, through principal components where there are more than ``pca_dim``; and the rows with labels."""
    middle = medians(df, columns)
    spread = df.agg(*[F.percentile(F.abs(F.col(c) - float(m)), 0.5).alias(c) for c, m in zip(columns, middle, strict=True)]).first()
    scale = [1.4826 * (spread[c] or 0.0) or 1.0 for c in columns]
    ready = filled(df, columns, middle).withColumns({f"b{i}": F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (F.col(c) - float(m)) / float(s))) for i, (c, m, s) in enumerate(zip(columns, middle, scale, strict=True))})
    names = [f"b{i}" for i in range(len(columns))]
    if len(names) > pca_dim:
        pca = Subspace(names, most=pca_dim).fit(ready)
        scaled, _, parts = pca.project(ready)
        ready = scaled.withColumns({f"p{i}": t for i, t in enumerate(parts)})
        names = [f"p{i}" for i in range(len(parts))]
    found = fit_regimes(ready, names, k_min, k_max, seed, sil_sample)
    return found, found.predict(ready).select(*df.columns, "regime_label")


def silhouette(df: DataFrame, columns: list[str], centers: np.ndarray) -> DataFrame:
    """(equip_id, silhouette): by distances to the nearest and the next centre."""
    parts = [F.sqrt(sum((F.pow(F.coalesce(F.col(c), F.lit(0.0)) - float(v), F.lit(2.0)) for c, v in zip(columns, center, strict=True)), F.lit(0.0))) for center in centers]
    d = F.array_sort(F.array(*parts))
    return df.groupBy(E).agg(F.avg((d[1] - d[0]) / F.greatest(d[1], F.lit(1e-12))).alias("silhouette"))


def quality_gate(found: DataFrame, least: float = 0.15) -> DataFrame:
    """Whether regimes are told apart well enough to be used; an unknown silhouette is not."""
    return found.withColumn("regime_quality_ok", F.coalesce(F.col("silhouette") >= least, F.lit(False)))
