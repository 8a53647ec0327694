"""Rolling features: frames of rows that end at the current row.

All expressions share one window, so a feature set costs one exchange and one
sort however many sensors and statistics it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from plantwatch.functions.scalar import c, correlation, robust_z


def frame(width: int, by: tuple[str, ...] = ("equip_id",), ts: str = "ts") -> WindowSpec:
    return W.partitionBy(*by).orderBy(ts).rowsBetween(-(width - 1), 0)


def median(x: Column | str, w: WindowSpec) -> Column:
    return F.percentile(c(x), F.lit(0.5)).over(w)


def _middle(a: Column) -> Column:
    """Median of a sorted array; null if empty."""
    n = F.size(a)
    return F.when(n > 0, (F.element_at(a, ((n + 1) / 2).cast("int")) + F.element_at(a, (n / 2).cast("int") + 1)) / 2)


def mad(x: Column | str, w: WindowSpec) -> Column:
    """Median absolute deviation about the window's own median."""
    values = F.collect_list(c(x)).over(w)
    mid = _middle(F.array_sort(values))
    return _middle(F.array_sort(F.transform(values, lambda v: F.abs(v - mid))))


def mean(x: Column | str, w: WindowSpec) -> Column:
    return F.avg(c(x)).over(w)


def std(x: Column | str, w: WindowSpec) -> Column:
    return F.stddev_samp(c(x)).over(w)


def skew(x: Column | str, w: WindowSpec) -> Column:
    """Bias corrected; null below three values."""
    n = F.count(c(x)).over(w)
    return F.when(n >= 3, F.skewness(c(x)).over(w) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(x: Column | str, w: WindowSpec) -> Column:
    """Bias-corrected excess; null below four values."""
    n = F.count(c(x)).over(w)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c(x)).over(w) + 6))


def slope(x: Column | str, i: Column | str, w: WindowSpec) -> Column:
    """Least squares on the row number; 0 below two values."""
    return F.coalesce(F.regr_slope(c(x), c(i).cast("double")).over(w), F.lit(0.0))


# Shares of the Nyquist frequency that bound the bands.
BANDS = ((0.0, 0.15), (0.15, 0.4), (0.4, 1.0))


def spectral(x: Column | str, w: WindowSpec, width: int, bands: tuple = BANDS) -> list[Column]:
    """Power of the demeaned window in each band [low, high) of the Nyquist frequency; 0 with less than half a window.

    A discrete Fourier transform in array functions: good for the small windows
    that rolling features use, its cost grows with the square of the width.
    """
    values = F.collect_list(c(x)).over(w)
    n = F.size(values)
    avg = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    k_last = F.floor(n / 2).cast("int")

    def power(k):
        turn = lambda t: 2 * math.pi * k * t / n
        rows = F.transform(values, lambda v, t: F.struct(((v - avg) * F.cos(turn(t))).alias("re"), ((v - avg) * F.sin(turn(t))).alias("im")))
        both = F.aggregate(rows, F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")), lambda a, r: F.struct((a["re"] + r["re"]).alias("re"), (a["im"] + r["im"]).alias("im")))
        return both["re"] * both["re"] + both["im"] * both["im"]

    out = []
    for low, high in bands:
        # frequency k / n against the Nyquist frequency 1/2
        inside = F.filter(F.sequence(F.lit(0), k_last), _within(low, high, n))
        total = F.aggregate(F.transform(inside, power), F.lit(0.0), lambda a, v: a + v)
        out.append(F.when(n >= max(1, width // 2), total).otherwise(F.lit(0.0)))
    return out


def _within(low: float, high: float, n: Column):
    return lambda k: (2.0 * k / n >= low) & (2.0 * k / n < high)


def xcorr(a: Column | str, b: Column | str, w: WindowSpec) -> Column:
    return correlation(a, b, w)


def lag_pairs(df: DataFrame, columns: list[str], max_lag: int, width: int, by: tuple[str, ...] = ("equip_id",), ts: str = "ts", unique: bool = False) -> DataFrame:
    """Rolling correlation of a with b, k rows earlier, for ordered (or unique) pairs and lags 0..max_lag."""
    order = W.partitionBy(*by).orderBy(ts)
    pairs = [(a, b) for i, a in enumerate(columns) for j, b in enumerate(columns) if (i < j if unique else i != j)]
    lagged = df.withColumns({f"_{b}_{k}": F.lag(b, k).over(order) if k else F.col(b) for b in columns for k in range(max_lag + 1)})
    out = {f"{a}_{b}_lag{k}": correlation(a, f"_{b}_{k}", frame(width, by, ts)) for a, b in pairs for k in range(max_lag + 1)}
    return lagged.select(*by, ts, *[v.alias(k) for k, v in out.items()])


def strong_columns(df: DataFrame, columns: list[str], least: float) -> list[str]:
    """Columns whose greatest magnitude reaches the least; one row to the driver."""
    row = df.agg(*[F.max(F.abs(x)).alias(x) for x in columns]).first()
    return [x for x in columns if (row[x] or 0.0) >= least]


def features(df: DataFrame, columns: list[str], width: int, by: tuple[str, ...] = ("equip_id",), ts: str = "ts", energy: bool = True) -> DataFrame:
    """Eleven features of each column; what can't be computed is 0."""
    w = frame(width, by, ts)
    df = df.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(ts)))
    first = {}
    for x in columns:
        parts = {"med": median(x, w), "mad": mad(x, w), "mean": mean(x, w), "std": std(x, w), "slope": slope(x, "_i", w), "skew": skew(x, w), "kurt": kurt(x, w)}
        if energy:
            parts |= {f"energy_{i}": e for i, e in enumerate(spectral(x, w, width))}
        first |= {f"{x}_{n}": v for n, v in parts.items()}
    got = df.select(*by, ts, *columns, *[v.alias(n) for n, v in first.items()])
    clean = lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v)
    rz = [clean(robust_z(x, f"{x}_med", f"{x}_mad")).alias(f"{x}_rz") for x in columns]
    return got.select(*by, ts, *[clean(F.col(n)).alias(n) for n in first], *rz)


def band_energy(values: Column | str, width: int, bands: tuple = BANDS) -> list[Column]:
    """Energy by band of an array, by Goertzel's recurrence: one pass over the array for each frequency."""
    v = c(values)
    n = F.size(v)
    avg = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n

    def power(k: Column) -> Column:
        turn = 2 * F.cos(2 * math.pi * k / n)
        start = F.struct(F.lit(0.0).alias("one"), F.lit(0.0).alias("two"))
        end = F.aggregate(v, start, lambda s, x: F.struct((x - avg + turn * s["one"] - s["two"]).alias("one"), s["one"].alias("two")))
        return F.transform(F.array(end), lambda s: s["one"] * s["one"] + s["two"] * s["two"] - turn * s["one"] * s["two"])[0]

    out = []
    for low, high in bands:
        inside = F.filter(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), _within(low, high, n))
        total = F.aggregate(F.transform(inside, power), F.lit(0.0), lambda a, x: a + x)
        out.append(F.when(n >= max(1, width // 2), total).otherwise(F.lit(0.0)))
    return out


def fourier_energy(values: Column | str, bands: tuple = BANDS) -> Column:
    """Energy by band of long arrays, an array of doubles, by a fast Fourier transform over Arrow batches."""

    @F.pandas_udf("array<double>")
    def energy(arrays: pd.Series) -> pd.Series:
        def one(a) -> list[float]:
            x = np.asarray(a, float)
            if not len(x):
                return [0.0] * len(bands)
            p = np.abs(np.fft.rfft(x - x.mean())) ** 2
            share = 2 * np.arange(len(p)) / len(x)
            return [float(p[(share >= low) & (share < high)].sum()) for low, high in bands]

        return arrays.map(one)

    return energy(c(values))


def apply(values: Column | str, w: WindowSpec, f: Callable[[np.ndarray], float]) -> Column:
    """Any function of a window's values, null ones left out, over Arrow batches: the slow path, for what has no built-in."""

    @F.pandas_udf("double")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: float(f(np.asarray(a, float))) if len(a) else None)

    return run(F.collect_list(c(values)).over(w))


def map_elements(values: Column | str, f: Callable[[np.ndarray], float]) -> Column:
    """Any function of an array column, over Arrow batches."""

    @F.pandas_udf("double")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else float(f(np.asarray(a, float))))

    return run(c(values))
