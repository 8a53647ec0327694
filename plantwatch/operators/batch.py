"""A whole batch for all equipment in one go: load, split, score, calibrate, fuse, find episodes, build tables, write.

Equipment is a column throughout, so one job takes the place of a process for
each asset. Every detector is fitted on an equipment's own training rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.operators import assets, cleaning, detectors, history, scoring, tables
from plantwatch.operators.detectors import E
from plantwatch.sources import sinks


@dataclass
class Settings:
    """What a batch needs to know beside its rows; ``weights`` are those of the fusion."""

    tags: list[str]
    unit: str = "HOUR"
    ratio: float = 0.6
    least: int = assets.LEAST
    weights: dict[str, float] = field(default_factory=lambda: {"ar1_z": 0.25, "mhal_z": 0.25, "pca_spe_z": 0.25, "omr_z": 0.25})
    keep: Callable[[DataFrame], DataFrame] | None = None


def sensor_frame(rows: DataFrame, settings: Settings) -> DataFrame:
    """(equip_id, ts, split, a column for each tag): means by time unit, the first share of rows trains."""
    mean = rows.groupBy(E, F.date_trunc(settings.unit, "ts").cast("timestamp_ntz").alias("ts")).pivot("tag", settings.tags).agg(F.avg("value"))
    return history.split_ratio(mean, settings.ratio)


def detector_scores(wide: DataFrame, settings: Settings) -> DataFrame:
    """(equip_id, ts, split, detector, score) of all detectors, long; without a model there is no score."""
    tags, train = settings.tags, wide.where("split = 'train'")
    long = wide.unpivot([E, "ts", "split"], tags, "tag", "value").where("value is not null")
    ar1 = detectors.combine_tags(detectors.score_ar1(long, detectors.fit_ar1(long.where("split = 'train'"))))
    scored = assets.score_mahalanobis(wide, assets.fit_mahalanobis(train, tags, least=settings.least), tags, "mhal")
    scored = assets.score_subspace(scored, assets.fit_subspace(train, tags, least=settings.least), tags)
    scored = assets.score_reconstruction(scored, assets.fit_reconstruction(train, tags, least=settings.least), tags, "omr")
    parts = scored.unpivot([E, "ts", "split"], ["mhal", "pca_spe", "pca_t2", "omr"], "detector", "score")
    return parts.unionByName(ar1.join(wide.select(E, "ts", "split"), [E, "ts"]).withColumn("detector", F.lit("ar1"))).where("score is not null")


def fused_scores(long: DataFrame, settings: Settings) -> DataFrame:
    """(equip_id, ts, a z for each detector, fused, regime): calibrated on training rows."""
    names = ["ar1", "mhal", "pca_spe", "pca_t2", "omr"]
    z = scoring.apply_calibration(long, scoring.calibrate(long.where("split = 'train'")))
    wide = z.groupBy(E, "ts").pivot("detector", names).agg(F.first("z"))
    wide = wide.select(E, "ts", *[F.coalesce(n, F.lit(0.0)).alias(f"{n}_z") for n in names])
    fused = scoring.fuse(wide, settings.weights)
    label = F.when(F.col("mhal_z") < 1, 0).otherwise(1).cast("int")
    return fused.withColumn("regime_label", label).withColumn("regime_state", F.when(label == 0, "healthy").otherwise("suspect"))


def run(rows: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Scores, episodes, drift, sensor context and every table, by name.

    ``settings.keep`` (a checkpoint, a written table) cuts the scores once, as all else is built on them.
    """
    keep = settings.keep or (lambda df: df)
    wide = keep(sensor_frame(rows, settings))
    scores = keep(fused_scores(keep(detector_scores(wide, settings)), settings))
    episodes = keep(scoring.name_episodes(scoring.episodes(scores), scores))
    drift = scoring.drift(scores)
    long = wide.unpivot([E, "ts", "split"], settings.tags, "tag", "value").where("value is not null")
    context = cleaning.context_z(long)
    return {"scores": scores, "episodes": episodes, "drift": drift} | tables.build_all(scores, episodes, context, drift)


def write(found: dict[str, DataFrame], root: str, run_id: str, runs: DataFrame) -> None:
    """All tables of the batch under a run id; the run's own row comes last and publishes it."""
    sinks.write_all({k: v for k, v in found.items() if E in v.columns}, root, run_id, runs)
