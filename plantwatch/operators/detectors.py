"""Multivariate detectors: fit a small parameter object on Spark-made moments, score rows in the JVM or by Arrow batches.

Input frames have equip_id, ts and sensor columns; ``split`` selects what is
fitted. Only sums, d x d matrices and bounded samples leave the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

E = "equip_id"
#: Rows of the healthy regime that a model is fitted on alone, at least.
LEAST_ROWS = 50


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and the covariance (n - 1) of rows without nulls, from one aggregation."""
    clean = df.dropna(subset=columns)
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = clean.agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(d)]), cov


def medians(df: DataFrame, columns: list[str]) -> list[float]:
    row = df.agg(*[F.percentile(x, 0.5).alias(x) for x in columns]).first()
    return [row[x] or 0.0 for x in columns]


def filled(df: DataFrame, columns: list[str], values: list[float], limit: float = 1e6) -> DataFrame:
    """Nulls and non-finite values by the given ones, the rest within the limit."""
    def one(x, v):
        bad = F.col(x).isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(bad, F.lit(float(v))).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col(x))))

    return df.withColumns({x: one(x, v) for x, v in zip(columns, values, strict=True)})


def with_filled(df: DataFrame, columns: list[str], values: list[float]) -> tuple[DataFrame, list[str]]:
    """The frame with filled copies of the columns beside them, and their names; they go with ``drop``."""
    names = [f"_filled_{i}" for i in range(len(columns))]
    return filled(df.withColumns(dict(zip(names, map(F.col, columns), strict=True))), names, values), names


def _dot(row: np.ndarray, xs: list[Column]) -> Column:
    out = F.lit(0.0)
    for w, x in zip(row, xs, strict=True):
        out = out + F.lit(float(w)) * x
    return out


# AR(1) by tag, in long form


def fit_ar1(long: DataFrame, cap: float = 0.999) -> DataFrame:
    """(equip_id, tag, mu, phi, sd): phi of the demeaned series, deviation of the residuals but the first.

    One exchange: the mean and the row before come from windows by tag, and the residuals' variance follows from the
    pairs' variances and covariance. A null lies at the mean.
    """
    key = W.partitionBy(E, "tag")
    x = long.withColumn("mu", F.avg("value").over(key)).withColumn("x", F.coalesce(F.col("value") - F.col("mu"), F.lit(0.0)))
    return lag_moments(x.withColumn("p", F.lag("x").over(key.orderBy("ts"))), [E, "tag"], cap).select(E, "tag", "mu", "phi", "sd")


def lag_moments(x: DataFrame, keys: list[str], cap: float, *more: Column) -> DataFrame:
    """mu, phi and sd by key from demeaned values ``x`` and those before them, ``p``; further aggregates beside them."""
    pair = F.col("p").isNotNull()
    mean_x, mean_p = F.avg(F.when(pair, F.col("x"))), F.avg("p")
    sums = x.groupBy(*keys).agg(F.first("mu").alias("mu"), F.covar_pop("x", "p").alias("_c"), F.var_pop(F.when(pair, F.col("x"))).alias("_vx"), F.var_pop("p").alias("_vp"), mean_x.alias("_mx"), mean_p.alias("_mp"), *more)
    den = F.col("_vp") + F.col("_mp") * F.col("_mp")
    phi = F.coalesce((F.col("_c") + F.col("_mx") * F.col("_mp")) / F.when(den > 0, den), F.lit(0.0))
    sums = sums.withColumn("phi", F.greatest(F.lit(-cap), F.least(F.lit(cap), phi)))
    rest = F.col("_vx") - 2 * F.col("phi") * F.col("_c") + F.col("phi") * F.col("phi") * F.col("_vp")
    return sums.withColumn("sd", F.greatest(F.sqrt(F.greatest(F.coalesce(rest, F.lit(0.0)), F.lit(0.0))), F.lit(1e-6))).drop("_c", "_vx", "_vp", "_mx", "_mp")


def score_ar1(long: DataFrame, params: DataFrame) -> DataFrame:
    """|residual| / sd of each tag; the first row's residual is 0."""
    w = W.partitionBy(E, "tag").orderBy("ts")
    x = long.join(params, [E, "tag"]).withColumn("x", F.col("value") - F.col("mu")).withColumn("p", F.lag("x").over(w))
    return x.select(E, "tag", "ts", F.abs(F.coalesce(F.col("x") - F.col("phi") * F.col("p"), F.lit(0.0)) / F.col("sd")).alias("z"))


def combine_tags(z: DataFrame, how: str = "mean") -> DataFrame:
    of = {"mean": F.avg("z"), "median": F.percentile("z", 0.5), "p95": F.percentile("z", 0.95)}[how]
    return z.groupBy(E, "ts").agg(of.alias("score"))


@dataclass
class Mahalanobis:
    """Distance under a regularised covariance; lambda grows tenfold while the matrix is ill-conditioned."""

    columns: list[str]
    reg: float = 1e-3
    mean: np.ndarray = field(default=None)  # type: ignore[assignment]
    inverse: np.ndarray = field(default=None)  # type: ignore[assignment]
    condition: float = 0.0

    def fit(self, df: DataFrame) -> Mahalanobis:
        _, self.mean, cov = moments(df, self.columns)
        for _ in range(8):
            s = cov + self.reg * np.eye(len(cov))
            self.condition = float(np.linalg.cond(s))
            if self.condition <= 1e10:
                break
            self.reg *= 10
        self.inverse = np.linalg.pinv(s)
        return self

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """A quadratic form as a JVM expression; nulls lie at the mean."""
        xs = [F.coalesce(F.col(c) - float(m), F.lit(0.0)) for c, m in zip(self.columns, self.mean, strict=True)]
        total = F.lit(0.0)
        for i, row in enumerate(self.inverse):
            total = total + xs[i] * _dot(row, xs)
        return df.withColumn(name, F.sqrt(F.greatest(F.lit(0.0), total)))


@dataclass
class Subspace:
    """Principal components of standardised columns: squared prediction error and T²."""

    columns: list[str]
    most: int = 5
    fill: list[float] = field(default_factory=list)
    mean: np.ndarray = field(default=None)  # type: ignore[assignment]
    scale: np.ndarray = field(default=None)  # type: ignore[assignment]
    components: np.ndarray = field(default=None)  # type: ignore[assignment]
    variances: np.ndarray = field(default=None)  # type: ignore[assignment]
    all_variances: np.ndarray = field(default=None)  # type: ignore[assignment]

    def fit(self, df: DataFrame) -> Subspace:
        rows = df.select(*self.columns).persist()  # read twice
        try:
            self.fill = medians(rows, self.columns)
            n, self.mean, cov = moments(filled(rows, self.columns, self.fill), self.columns)
        finally:
            rows.unpersist()
        sd = np.sqrt(np.diag(cov) * (n - 1) / max(1, n))
        self.scale = np.where(sd > 1e-12, sd, 1.0)
        values, vectors = np.linalg.eigh(cov / np.outer(self.scale, self.scale))
        order = np.argsort(values)[::-1]
        self.all_variances = np.clip(values[order], 0, None)
        k = max(1, min(self.most, len(self.columns), n - 1))
        self.variances, self.components = self.all_variances[:k], vectors[:, order[:k]].T
        self.components *= np.sign(self.components[np.arange(k), np.abs(self.components).argmax(axis=1)])[:, None]
        return self

    def project(self, df: DataFrame) -> tuple[DataFrame, list[Column], list[Column]]:
        ready = filled(df, self.columns, self.fill)
        xs = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)]
        return ready, xs, [_dot(c, xs) for c in self.components]

    def score(self, df: DataFrame, spe: str = "pca_spe", t2: str = "pca_t2") -> DataFrame:
        ready, names = with_filled(df, self.columns, self.fill)
        xs = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(names, self.mean, self.scale, strict=True)]
        ts = [_dot(c, xs) for c in self.components]
        error, hotelling = F.lit(0.0), F.lit(0.0)
        for i, x in enumerate(xs):
            rest = x - _dot(self.components[:, i], ts)
            error = error + rest * rest
        for t, v in zip(ts, self.variances, strict=True):
            hotelling = hotelling + t * t / float(max(v, 1e-12))
        return ready.withColumns({spe: error, t2: hotelling}).drop(*names)

    def loadings(self) -> list[tuple[int, str, float]]:
        return [(k + 1, c, float(self.components[k, i])) for k in range(len(self.components)) for i, c in enumerate(self.columns)]

    def explained(self) -> list[float]:
        total = self.all_variances.sum() or 1.0
        return [float(v / total) for v in self.all_variances]

    def needed(self, share: float = 0.9) -> int:
        return int(np.searchsorted(np.cumsum(self.explained()), share - 1e-12) + 1)


def choose_omr(n: int, d: int) -> str:
    """pca with more columns than rows, ridge for long and narrow data, else pls."""
    return "pca" if d > n else "linear" if n > 1000 and d < 20 else "pls"


@dataclass
class Reconstruction:
    """Overall residual: every column rebuilt from the others; the norm of the residuals in training deviations."""

    columns: list[str]
    kind: str = "auto"
    components: int = 5
    ridge: float = 1.0
    fill: list[float] = field(default_factory=list)
    mean: np.ndarray = field(default=None)  # type: ignore[assignment]
    scale: np.ndarray = field(default=None)  # type: ignore[assignment]
    weights: np.ndarray = field(default=None)  # type: ignore[assignment]
    residual_std: float = 1.0

    def fit(self, df: DataFrame) -> Reconstruction:
        rows = df.select(*self.columns, *(["regime_label"] if "regime_label" in df.columns else [])).persist()  # read up to four times
        try:
            return self._fit(rows)
        finally:
            rows.unpersist()

    def _fit(self, df: DataFrame) -> Reconstruction:
        if "regime_label" in df.columns:  # the healthy regime is the lowest label, if it has enough rows to fit
            low = df.groupBy("regime_label").agg(F.count("*").alias("n")).where("regime_label is not null").orderBy("regime_label").first()
            df = df.where(F.col("regime_label") == low[0]) if low is not None and low[1] >= LEAST_ROWS else df
        self.fill = medians(df, self.columns)
        ready = filled(df, self.columns, self.fill)
        n, self.mean, cov = moments(ready, self.columns)
        d = len(self.columns)
        if self.kind == "auto":
            self.kind = choose_omr(n, d)
        sd = np.sqrt(np.diag(cov) * (n - 1) / max(1, n))
        self.scale = np.where(sd > 1e-9, sd, 1.0)
        s = cov / np.outer(self.scale, self.scale)
        if self.kind == "linear":  # ridge of each column on the others, from the normal equations
            self.weights = np.zeros((d, d))
            for j in range(d):
                o = [i for i in range(d) if i != j]
                if o:
                    self.weights[j, o] = np.linalg.solve(s[np.ix_(o, o)] * n + self.ridge * np.eye(len(o)), s[o, j] * n)
        elif self.kind == "pca":
            self.weights = self._project(s, min(self.components, max(1, d - 1)))
        else:  # partial least squares of X on itself deflates like its covariance, component by component
            self.weights = self._pls(s, min(self.components, max(1, d - 1)))
        norm = ready.select(self._norm(self._residuals()).alias("r")).agg(F.stddev_pop("r")).first()[0]
        self.residual_std = max(float(norm or 0.0), 1e-6)
        return self

    @staticmethod
    def _project(s: np.ndarray, k: int) -> np.ndarray:
        values, vectors = np.linalg.eigh(s)
        top = vectors[:, np.argsort(values)[::-1][:k]]
        return top @ top.T

    @staticmethod
    def _pls(s: np.ndarray, k: int) -> np.ndarray:
        """Coefficients of X on X by k components, from the covariance alone."""
        d, rest = len(s), s.copy()
        ws, ps = [], []
        for _ in range(k):
            values, vectors = np.linalg.eigh(rest @ rest.T)
            w = vectors[:, values.argmax()]
            var = w @ rest @ w
            if var < 1e-12:
                break
            p = rest @ w / var
            rest = rest - var * np.outer(p, p)
            ws.append(w)
            ps.append(p)
        if not ws:
            return np.zeros((d, d))
        wm, pm = np.array(ws).T, np.array(ps).T
        r = wm @ np.linalg.pinv(pm.T @ wm)
        return pm @ r.T

    def _residuals(self, names: list[str] | None = None) -> list[Column]:
        xs = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(names or self.columns, self.mean, self.scale, strict=True)]
        return [x - _dot(w, xs) for x, w in zip(xs, self.weights, strict=True)]

    @staticmethod
    def _norm(parts: list[Column]) -> Column:
        total = F.lit(0.0)
        for p in parts:
            total = total + p * p
        return F.sqrt(total)

    def score(self, df: DataFrame, name: str = "omr_z", limit: float = 10.0) -> DataFrame:
        """The norm over its training deviation, clipped; rows are filled by training medians."""
        ready, names = with_filled(df, self.columns, self.fill)
        return ready.withColumn(name, F.least(F.lit(limit), self._norm(self._residuals(names)) / self.residual_std)).drop(*names)

    def contributions(self, df: DataFrame) -> DataFrame:
        """(equip_id, ts, sensor, score): squared residuals."""
        parts = [F.struct(F.lit(c).alias("sensor"), (r * r).alias("score")) for c, r in zip(self.columns, self._residuals(), strict=True)]
        return filled(df, self.columns, self.fill).select(E, "ts", F.inline(F.array(*parts)))


def top_contributors(contributions: DataFrame, ts: str, n: int = 5) -> DataFrame:
    return contributions.where(F.col("ts") == F.lit(ts).cast("timestamp_ntz")).orderBy(F.desc("score"), "sensor").limit(n)


def _sample(df: DataFrame, columns: list[str], most: int) -> np.ndarray:
    """At most ``most`` rows, the first by a hash of their key: the documented bound of what a model is grown from."""
    rows = df.dropna(subset=columns).select(E, "ts", *columns).orderBy(F.xxhash64(E, "ts"), E, "ts").limit(most)
    return rows.select(*columns).toPandas().to_numpy(float).reshape(-1, len(columns))


def _unsuccessful(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


@dataclass
class IsolationForest:
    """Trees of random cuts grown on a bounded sample; a row scores 2^(-mean depth / expected depth)."""

    columns: list[str]
    trees: int = 100
    per_tree: int = 256
    most: int = 2048
    seed: int = 17
    fill: list[float] = field(default_factory=list)
    forest: list[tuple] = field(default_factory=list)
    expected: float = 1.0

    def fit(self, df: DataFrame) -> IsolationForest:
        self.fill = medians(df, self.columns)
        x = _sample(filled(df, self.columns, self.fill), self.columns, self.most)
        rng = np.random.default_rng(self.seed)
        size = min(self.per_tree, len(x))
        self.expected = max(_unsuccessful(size), 1e-9)
        depth = math.ceil(math.log2(max(2, size)))
        self.forest = [self._grow(x[rng.choice(len(x), size, replace=False)], depth, rng) for _ in range(self.trees)] if size else []
        return self

    def _grow(self, x: np.ndarray, depth: int, rng) -> tuple:
        """(feature, threshold, left, right, depth added at a leaf) as flat arrays."""
        feature, cut, left, right, add = [], [], [], [], []

        def node(rows: np.ndarray, d: int) -> int:
            i = len(feature)
            for a, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (add, d + _unsuccessful(len(rows)))):
                a.append(v)
            spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(rows.shape[1])
            if d < depth and len(rows) > 1 and (spread > 0).any():
                f = int(rng.choice(np.flatnonzero(spread > 0)))
                t = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
                feature[i], cut[i] = f, t
                left[i] = node(rows[rows[:, f] < t], d + 1)
                right[i] = node(rows[rows[:, f] >= t], d + 1)
            return i

        node(x, 0)
        return tuple(np.array(a) for a in (feature, cut, left, right, add))

    def values(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, add in self.forest:
            at = np.zeros(len(x), int)
            live = np.flatnonzero(feature[at] >= 0)
            while len(live):
                f = feature[at[live]]
                down = x[live, f] < cut[at[live]]
                at[live] = np.where(down, left[at[live]], right[at[live]])
                live = live[feature[at[live]] >= 0]
            total += add[at]
        return 2.0 ** (-total / max(1, len(self.forest)) / self.expected)

    def score(self, df: DataFrame, name: str = "iforest") -> DataFrame:
        ready = filled(df, self.columns, self.fill)
        model, columns = self, self.columns

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for parts in batches:
                yield pd.Series(model.values(np.column_stack([p.to_numpy(float) for p in parts])))

        return ready.withColumn(name, score(*[F.col(c) for c in columns]))


@dataclass
class DiagonalMixture:
    """Gaussian mixture with diagonal covariances, components chosen by BIC; scores are negative log likelihoods."""

    columns: list[str]
    k_min: int = 1
    k_max: int = 3
    most: int = 5000
    seed: int = 17
    fill: list[float] = field(default_factory=list)
    parameters: tuple = ()
    bic: dict[int, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> DiagonalMixture:
        self.fill = medians(df, self.columns)
        x = _sample(filled(df, self.columns, self.fill), self.columns, self.most)
        self.center, self.spread = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
        x = (x - self.center) / self.spread
        best = None
        for k in range(self.k_min, min(self.k_max, max(1, len(x) // 5)) + 1):
            p, ll = self._em(x, k)
            self.bic[k] = -2 * ll + (k * 2 * x.shape[1] + k - 1) * math.log(max(2, len(x)))
            if best is None or self.bic[k] < best:
                best, self.parameters = self.bic[k], p
        return self

    def _em(self, x: np.ndarray, k: int, rounds: int = 100) -> tuple[tuple, float]:
        rng = np.random.default_rng(self.seed)
        mu, var, w = x[rng.choice(len(x), k, replace=False)], np.ones((k, x.shape[1])), np.full(k, 1 / k)
        last = -np.inf
        for _ in range(rounds):
            log = self._log(x, mu, var, w)
            top = log.max(axis=1, keepdims=True)
            norm = top + np.log(np.exp(log - top).sum(axis=1, keepdims=True))
            r = np.exp(log - norm)
            n = r.sum(axis=0) + 1e-9
            mu = r.T @ x / n[:, None]
            var = np.maximum(r.T @ (x * x) / n[:, None] - mu * mu, 1e-3)
            w = n / n.sum()
            ll = float(norm.sum())
            if ll - last < 1e-4 * len(x):
                break
            last = ll
        return (mu, var, w), ll

    @staticmethod
    def _log(x, mu, var, w):
        return np.log(w) - 0.5 * (np.log(2 * np.pi * var).sum(axis=1) + (((x[:, None, :] - mu) ** 2) / var).sum(axis=2))

    def score(self, df: DataFrame, name: str = "gmm") -> DataFrame:
        ready = filled(df, self.columns, self.fill)
        model, columns = self, self.columns

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for parts in batches:
                x = (np.column_stack([p.to_numpy(float) for p in parts]) - model.center) / model.spread
                log = model._log(x, *model.parameters)
                top = log.max(axis=1, keepdims=True)
                yield pd.Series(-(top[:, 0] + np.log(np.exp(log - top).sum(axis=1))))

        return ready.withColumn(name, score(*[F.col(c) for c in columns]))


class HalfSpaceTrees:
    """Online anomaly scores over random half-spaces: mass of the last window against what comes in, row by row."""

    def __init__(self, d: int, trees: int = 25, height: int = 8, window: int = 100, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.height, self.window, self.seen, self.trees = height, window, 0, []
        for _ in range(trees):
            s = rng.uniform(0, 1, d)
            low, high = s - 2 * np.maximum(s, 1 - s), s + 2 * np.maximum(s, 1 - s)
            n = 2 ** (height + 1) - 1
            dim, cut = np.zeros(n, int), np.zeros(n)

            def build(i, lo, hi, depth, dim=dim, cut=cut):
                if depth == height:
                    return
                q = int(rng.integers(d))
                dim[i], cut[i] = q, (lo[q] + hi[q]) / 2
                up, down = hi.copy(), lo.copy()
                up[q] = down[q] = cut[i]
                build(2 * i + 1, lo, up, depth + 1)
                build(2 * i + 2, down, hi, depth + 1)

            build(0, low, high, 0)
            self.trees.append((dim, cut, np.zeros(n), np.zeros(n)))

    def step(self, x: np.ndarray) -> float:
        """The score of a row within [0, 1], which is then learned; greater is stranger."""
        total = 0.0
        for dim, cut, ref, now in self.trees:
            i = 0
            for depth in range(self.height + 1):
                now[i] += 1
                if depth == self.height or ref[i] < 0.1 * self.window:
                    total += ref[i] * 2.0**depth
                    break
                i = 2 * i + (1 if x[dim[i]] < cut[i] else 2)
            while 2 * i + 2 < len(dim):  # learning goes on to the leaf
                i = 2 * i + (1 if x[dim[i]] < cut[i] else 2)
                now[i] += 1
        self.seen += 1
        if self.seen % self.window == 0:
            for _, _, ref, now in self.trees:
                ref[:] = now
                now[:] = 0
        most = self.window * 2.0**self.height * len(self.trees)
        return 1.0 - min(1.0, total / most) if self.seen > self.window else 0.0


def half_space_scores(df: DataFrame, columns: list[str], lows: list[float], highs: list[float], **options) -> DataFrame:
    """Score, then learn, each row in order of time; sequential within a piece of equipment by definition."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts")
        spread = np.where(np.array(highs) > np.array(lows), np.array(highs) - np.array(lows), 1.0)
        x = np.clip((np.nan_to_num(frame[columns].to_numpy(float)) - np.array(lows)) / spread, 0, 1)
        model = HalfSpaceTrees(len(columns), **options)
        return pd.DataFrame({"equip_id": frame["equip_id"], "ts": frame["ts"], "hst": [model.step(r) for r in x]})

    return df.select(E, "ts", *columns).groupBy(E).applyInPandas(run, "equip_id int, ts timestamp_ntz, hst double")


def merge_moments(a: tuple[float, float, float], b: tuple[float, float, float]) -> tuple[float, float, float]:
    """(n, mean, M2) of two parts put together: an incremental scaler update."""
    n = a[0] + b[0]
    if not n:
        return 0.0, 0.0, 0.0
    delta = b[1] - a[1]
    return n, a[1] + delta * b[0] / n, a[2] + b[2] + delta * delta * a[0] * b[0] / n
