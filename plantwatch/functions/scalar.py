"""Column functions: health, zones, binning, clipping, names, hashes and the normal distribution."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

# Zone edges and severity levels that results depend on.
ALERT_BELOW, WATCH_BELOW = 70.0, 85.0
Z_WARN = 2.0
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """NaN and infinities as null; Spark counts NaN as a value, the operators do not."""
    x = c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(x: Column | str, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(c(x).isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c(x))))


def correlation(a: Column | str, b: Column | str, over: WindowSpec | None = None) -> Column:
    """Pearson's r over the rows where both are known; null where either doesn't vary (the built-in raises an error there)."""
    a, b = c(a).cast("double"), c(b).cast("double")
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    cov, sx, sy = [p.over(over) for p in parts] if over is not None else parts
    r = F.when((sx > 1e-12) & (sy > 1e-12), F.try_divide(cov, sx * sy))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def health(z: Column | str) -> Column:
    """100 / (1 + z^2)."""
    return F.lit(100.0) / (F.lit(1.0) + c(z) * c(z))


def zone(h: Column | str) -> Column:
    """Right-closed bins: (0, 70] ALERT, (70, 85] WATCH, (85, 100] GOOD."""
    return F.when(c(h) <= ALERT_BELOW, "ALERT").when(c(h) <= WATCH_BELOW, "WATCH").when(c(h) <= 100.0, "GOOD")


def status(h: Column | str) -> tuple[Column, Column]:
    """Status and severity of a current health, with left-closed edges."""
    h = c(h)
    return F.when(h >= WATCH_BELOW, "HEALTHY").when(h >= ALERT_BELOW, "CAUTION").otherwise("ALERT"), F.when(h >= WATCH_BELOW, "LOW").when(h >= ALERT_BELOW, "MEDIUM").otherwise("HIGH")


def severity_of_share(pct: Column | str) -> Column:
    pct = c(pct)
    return F.when(pct > 20, "CRITICAL").when(pct > 10, "HIGH").when(pct > 5, "MEDIUM").otherwise("LOW")


def robust_z(x: Column | str, med: Column | str, mad: Column | str, eps: float = 1e-9, limit: float = 100.0) -> Column:
    return clip((c(x) - c(med)) / (F.greatest(c(mad), F.lit(eps)) * 1.4826 + eps), -limit, limit)


def base_sensor(name: Column | str) -> Column:
    return F.substring_index(c(name), "_", 1)


def seconds(ts: Column | str) -> Column:
    """Seconds since the epoch of a time-zone free timestamp, with fractions."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c(ts).cast("timestamp_ntz")) / 1e6


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", c(a).cast("timestamp_ntz"), c(b).cast("timestamp_ntz")) / 1e6


def trunc(unit: str, ts: Column | str) -> Column:
    return F.date_trunc(unit, c(ts)).cast("timestamp_ntz")


def equipment_code_id(name: Column | str, known: dict[str, int] | None = None) -> Column:
    """A fixed map first, else md5 modulo 9999 plus 1, folded digit by digit as the hash exceeds a long."""
    digits = F.split(F.md5(c(name)), "")
    folded = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda a, d: F.pmod(a * 16 + F.instr(F.lit("0123456789abcdef"), d) - 1, F.lit(9999)))
    fixed = F.create_map(*[F.lit(v) for kv in (known or {"": 0}).items() for v in kv])
    return F.coalesce(F.try_element_at(fixed, c(name)).cast("long"), folded + 1)


def parse_value(value: Column | str, kind: Column | str) -> Column:
    """A configuration value as JSON text by its declared type; what can't be read is null."""
    value, kind = F.trim(c(value)), F.lower(c(kind))
    flag = F.lower(value).isin("true", "1", "yes", "on")
    return (
        F.when(kind == "int", value.try_cast("long").cast("string"))
        .when(kind == "float", value.try_cast("double").cast("string"))
        .when(kind == "bool", F.when(flag, "true").otherwise("false"))
        .when(kind.isin("list", "dict", "json"), F.when(F.try_parse_json(value).isNotNull(), value))
        .otherwise(value)
    )


@F.pandas_udf(T.DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    """The normal distribution function; Spark has no erf."""
    return x.map(lambda v: None if v is None or v != v else 0.5 * (1.0 + math.erf(v / math.sqrt(2.0))))


def norm_cdf_sql(x: Column | str) -> Column:
    """The same by a rational approximation, exact to 1e-7, that stays in the JVM."""
    a = F.abs(c(x) / math.sqrt(2.0))
    t = 1.0 / (1.0 + 0.3275911 * a)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = F.signum(c(x)) * (1.0 - poly * F.exp(-a * a))
    return 0.5 * (1.0 + erf)
