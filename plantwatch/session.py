"""A Spark session with the settings the operators assume."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "plantwatch", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; a master set outside is kept."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).config(map=settings)
    if "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once, unless their Python finds it anyway (installed, or on PYTHONPATH)."""
    root = Path(__file__).resolve().parent.parent
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if "site-packages" in root.parts or str(root) in known or getattr(context, "_plantwatch_sent", False):
        return
    target = Path(tempfile.mkdtemp(prefix="plantwatch-")) / "plantwatch.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted((root / "plantwatch").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(target))  # the driver serves it, executors need no shared folder
    context._plantwatch_sent = True


def kept(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint in the cluster's shared folder.

    ``spark.checkpoint.dir`` names it; where that is unset, in local mode, a temporary folder is taken.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="plantwatch-"))
    return df.checkpoint(eager=True)
