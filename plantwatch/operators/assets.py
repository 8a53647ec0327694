"""Detectors with a model for each piece of equipment, fitted on its training rows.

One aggregation by equipment makes the sums; the small algebra (d x d) runs over
its rows, one for each piece of equipment, and gives a frame of parameters. That
joins the rows to be scored, and the score is a JVM expression. Nothing is
collected, so there may be any number of pieces of equipment.

Equipment with fewer than ``least`` training rows gets no model and null scores.
Nulls and non-finite values are filled by the equipment's training medians.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantwatch.operators.detectors import E, Reconstruction, choose_omr

LEAST = 20


def healthy(df: DataFrame, regime: str = "regime_label", least: int = LEAST) -> DataFrame:
    """Rows of each equipment's lowest regime, or all of them where that has too few."""
    low = df.groupBy(E).agg(F.min(regime).alias("_low"))
    size = df.join(low, E).where(F.col(regime) == F.col("_low")).groupBy(E, "_low").agg(F.count("*").alias("_n"))
    return df.join(size, E, "left").where((F.coalesce("_n", F.lit(0)) < least) | (F.col(regime) == F.col("_low"))).drop("_low", "_n")


def fills(train: DataFrame, columns: list[str]) -> DataFrame:
    """(equip_id, fill): the training medians, 0 where a column has no value."""
    return train.groupBy(E).agg(F.array(*[F.coalesce(F.percentile(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)), 0.5), F.lit(0.0)) for c in columns]).alias("fill"))


def _filled(columns: list[str], limit: float = 1e6) -> list[Column]:
    def one(i: int, c: str) -> Column:
        bad = F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(bad, F.get("fill", F.lit(i))).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col(c))))

    return [one(i, c) for i, c in enumerate(columns)]


def moments(train: DataFrame, columns: list[str], fill: DataFrame) -> DataFrame:
    """(equip_id, n, fill, mean, cov): covariances (n - 1) row by row, from one aggregation by equipment."""
    d = len(columns)
    ready = train.join(fill, E).select(E, "fill", *[x.alias(f"x{i}") for i, x in enumerate(_filled(columns))])
    cov = [F.coalesce(F.covar_samp(f"x{min(i, j)}", f"x{max(i, j)}"), F.lit(0.0)) for i in range(d) for j in range(d)]
    return ready.groupBy(E).agg(F.count("*").alias("n"), F.first("fill").alias("fill"), F.array(*[F.avg(f"x{i}") for i in range(d)]).alias("mean"), F.array(*cov).alias("cov"))


def _algebra(sums: DataFrame, least: int, make: Callable[[int, np.ndarray, np.ndarray], dict[str, list[float]]], names: list[str]) -> DataFrame:
    """A row of parameters, arrays of doubles, for each equipment with enough rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                d = len(r.mean)
                rows.append({E: getattr(r, E), "fill": r.fill, "mean": r.mean} | make(int(r.n), np.array(r.mean, float), np.array(r.cov, float).reshape(d, d)))
            yield pd.DataFrame(rows, columns=[E, "fill", "mean", *names])

    kept = sums.where(F.col("n") >= least)
    kind = kept.schema[E].dataType.simpleString()
    return kept.mapInPandas(run, f"{E} {kind}, fill array<double>, mean array<double>, " + ", ".join(f"{n} array<double>" for n in names))


def _sum(parts: list[Column]) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + p
    return total


def _at(name: str, i: int) -> Column:
    return F.get(name, F.lit(i))


def fit_mahalanobis(train: DataFrame, columns: list[str], reg: float = 1e-3, least: int = LEAST) -> DataFrame:
    """(equip_id, fill, mean, inverse, condition); the regularisation grows tenfold while the matrix is ill-conditioned."""

    def make(n: int, mean: np.ndarray, cov: np.ndarray) -> dict:
        grown = reg
        for _ in range(8):
            s = cov + grown * np.eye(len(cov))
            if (condition := float(np.linalg.cond(s))) <= 1e10:
                break
            grown *= 10
        return {"inverse": np.linalg.pinv(s).ravel().tolist(), "condition": [condition, grown]}

    return _algebra(moments(train, columns, fills(train, columns)), least, make, ["inverse", "condition"])


def score_mahalanobis(df: DataFrame, params: DataFrame, columns: list[str], name: str = "score") -> DataFrame:
    d = len(columns)
    xs = [x - _at("mean", i) for i, x in enumerate(_filled(columns))]
    total = _sum([xs[i] * xs[j] * _at("inverse", i * d + j) for i in range(d) for j in range(d)])
    return df.join(params, E, "left").withColumn(name, F.when(F.col("mean").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), total)))).select(*df.columns, name)


def _standard(n: int, cov: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Population deviations, 1 for a constant column, and the covariance of what is divided by them."""
    sd = np.sqrt(np.diag(cov) * (n - 1) / max(1, n))
    scale = np.where(sd > least, sd, 1.0)
    return scale, cov / np.outer(scale, scale)


def fit_subspace(train: DataFrame, columns: list[str], most: int = 5, least: int = LEAST) -> DataFrame:
    """(equip_id, fill, mean, scale, components, variances): principal components row by row."""

    def make(n: int, mean: np.ndarray, cov: np.ndarray) -> dict:
        scale, s = _standard(n, cov, 1e-12)
        values, vectors = np.linalg.eigh(s)
        order = np.argsort(values)[::-1][: max(1, min(most, len(mean), n - 1))]
        return {"scale": scale.tolist(), "components": vectors[:, order].T.ravel().tolist(), "variances": np.clip(values[order], 0, None).tolist()}

    return _algebra(moments(train, columns, fills(train, columns)), least, make, ["scale", "components", "variances"])


def score_subspace(df: DataFrame, params: DataFrame, columns: list[str], most: int = 5, spe: str = "pca_spe", t2: str = "pca_t2") -> DataFrame:
    """Squared prediction error and T² of each row."""
    d, k = len(columns), min(most, len(columns))
    met = df.join(params, E, "left").withColumns({f"_x{i}": (x - _at("mean", i)) / _at("scale", i) for i, x in enumerate(_filled(columns))})
    # a component that the equipment has too few rows for counts nothing
    met = met.withColumns({f"_t{c}": _sum([F.coalesce(_at("components", c * d + i), F.lit(0.0)) * F.col(f"_x{i}") for i in range(d)]) for c in range(k)})
    rest = [F.col(f"_x{i}") - _sum([F.coalesce(_at("components", c * d + i), F.lit(0.0)) * F.col(f"_t{c}") for c in range(k)]) for i in range(d)]
    hotelling = _sum([F.col(f"_t{c}") * F.col(f"_t{c}") / F.greatest(F.coalesce(_at("variances", c), F.lit(1.0)), F.lit(1e-12)) for c in range(k)])
    known = F.col("mean").isNotNull()
    return met.withColumns({spe: F.when(known, _sum([r * r for r in rest])), t2: F.when(known, hotelling)}).select(*df.columns, spe, t2)


def _residual_norm(columns: list[str]) -> Column:
    d = len(columns)
    xs = [(x - _at("mean", i)) / _at("scale", i) for i, x in enumerate(_filled(columns))]
    rest = [xs[j] - _sum([_at("weights", j * d + i) * xs[i] for i in range(d)]) for j in range(d)]
    return F.sqrt(_sum([r * r for r in rest]))


def fit_reconstruction(train: DataFrame, columns: list[str], kind: str = "auto", components: int = 5, ridge: float = 1.0, least: int = LEAST) -> DataFrame:
    """(equip_id, fill, mean, scale, weights, residual_std): every column rebuilt from the others, by ridge, PCA or PLS as the equipment's rows ask for."""

    def make(n: int, mean: np.ndarray, cov: np.ndarray) -> dict:
        d = len(mean)
        scale, s = _standard(n, cov, 1e-9)
        how = choose_omr(n, d) if kind == "auto" else kind
        k = min(components, max(1, d - 1), max(1, n - 1))
        if how == "linear":
            weights = np.zeros((d, d))
            for j in range(d):
                o = [i for i in range(d) if i != j]
                if o:
                    weights[j, o] = np.linalg.solve(s[np.ix_(o, o)] * n + ridge * np.eye(len(o)), s[o, j] * n)
        else:
            weights = Reconstruction._project(s, k) if how == "pca" else Reconstruction._pls(s, k)
        return {"scale": scale.tolist(), "weights": np.asarray(weights).ravel().tolist()}

    params = _algebra(moments(train, columns, fills(train, columns)), least, make, ["scale", "weights"])
    deviation = train.join(params, E).groupBy(E).agg(F.greatest(F.coalesce(F.stddev_pop(_residual_norm(columns)), F.lit(0.0)), F.lit(1e-6)).alias("residual_std"))
    return params.join(deviation, E)


def score_reconstruction(df: DataFrame, params: DataFrame, columns: list[str], name: str = "omr_z", limit: float = 10.0) -> DataFrame:
    """The norm of the residuals in training deviations, clipped."""
    score = F.when(F.col("mean").isNotNull(), F.least(F.lit(limit), _residual_norm(columns) / F.col("residual_std")))
    return df.join(params, E, "left").withColumn(name, score).select(*df.columns, name)
