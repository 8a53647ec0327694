"""Writing results, models and buffers.

Tables are partitioned Parquet. A write is idempotent through dynamic partition
overwrite; a run becomes visible when its row in ``runs`` is written last.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from plantwatch.operators.cleaning import for_sink

# What a missing required value is written as.
DEFAULTS = {"string": "", "double": 0.0, "int": 0, "bigint": 0, "boolean": False, "timestamp_ntz": "1900-01-01 00:00:00", "timestamp": "1900-01-01 00:00:00", "date": "1900-01-01"}


def write_table(df: DataFrame, path: str, run_id: str, partition_by: tuple[str, ...] = ("equip_id",), mode: str = "append") -> None:
    clean = for_sink(df).withColumn("run_id", F.lit(run_id))
    clean.write.mode(mode).partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("equip_id",)) -> None:
    """Delete and insert in one: only the partitions that the frame holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_all(tables: dict[str, DataFrame], root: str, run_id: str, runs: DataFrame) -> None:
    """All tables of a run, then its row: readers join ``runs``, so a half-written run is not seen."""
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", run_id)
    runs.write.mode("append").parquet(f"{root}/runs")


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").join(spark.read.parquet(f"{root}/runs").select("run_id").distinct(), "run_id", "left_semi")


def with_defaults(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Missing or null required columns get their type's default, and ``repaired`` says so."""
    fix = F.lit(False)
    for name, kind in required.items():
        if name in df.columns:
            fix = fix | F.col(name).isNull()
            df = df.withColumn(name, F.coalesce(F.col(name).cast(kind), F.lit(DEFAULTS[kind]).cast(kind)))
        else:
            fix = F.lit(True)
            df = df.withColumn(name, F.lit(DEFAULTS[kind]).cast(kind))
    return df.withColumn("repaired", fix) if "repaired" not in df.columns else df


def only_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema, cast; extra ones go, missing ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with the new ones put in by key; of equal keys the new row stays."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_v")))).where("_n = 1").drop("_n", "_v")


def scores_long(scores: DataFrame, run_id: str, source: str = "scores") -> DataFrame:
    names = [c for c in scores.columns if c.endswith("_z")]
    return scores.unpivot(["equip_id", "ts"], names, "sensor", "value").where("value is not null").select("equip_id", "ts", F.regexp_replace("sensor", "_z$", "").alias("sensor"), "value", F.lit(source).alias("source"), F.lit(run_id).alias("run_id"))


def drift_rows(df: DataFrame) -> DataFrame:
    """The first of drift_z, cusum_z and value that a frame has."""
    have = [F.col(c).cast("double") for c in ("drift_z", "cusum_z", "value") if c in df.columns]
    return df.select("equip_id", "ts", F.coalesce(*have).alias("drift_value")).dropna()


def event_rows(episodes: DataFrame) -> DataFrame:
    severity = F.coalesce("severity", F.lit("MEDIUM")) if "severity" in episodes.columns else F.lit("MEDIUM")
    state = F.coalesce("status", F.lit("OPEN")) if "status" in episodes.columns else F.lit("OPEN")
    return episodes.select("equip_id", F.col("start_ts").alias("event_start"), F.col("end_ts").alias("event_end"), severity.alias("severity"), state.alias("status"))


def schema_rows(df: DataFrame, name: str) -> DataFrame:
    """A row for each column: its type, and how many nulls it has."""
    nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    items = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"`{f.name}`").alias("n_null")) for f in df.schema])
    return nulls.select(F.lit(name).alias("table_name"), F.inline(items))


def pca_rows(spark: SparkSession, pca, equip_id: int, run_id: str) -> tuple[DataFrame, DataFrame]:
    """One row with JSON of a fitted subspace, and its loadings."""
    model = [(equip_id, run_id, len(pca.components), json.dumps(pca.explained()), json.dumps({"mean": pca.mean.tolist(), "scale": pca.scale.tolist()}))]
    loads = [(equip_id, run_id, k, c, v) for k, c, v in pca.loadings()]
    return spark.createDataFrame(model, "equip_id int, run_id string, n_components int, explained_json string, scaling_json string"), spark.createDataFrame(loads, "equip_id int, run_id string, component int, feature string, loading double")


def pca_metrics(scored: DataFrame, needed: int) -> DataFrame:
    return scored.groupBy("equip_id").agg(F.percentile("pca_spe", 0.95).alias("spe_p95"), F.percentile("pca_t2", 0.95).alias("t2_p95")).withColumn("n_for_90", F.lit(needed))


def save_model(params: DataFrame, root: str, name: str, signature: str) -> int:
    """Parameters under the next version, and the version."""
    spark = params.sparkSession
    version = (latest_version(spark, root, name) or 0) + 1
    params.withColumn("signature", F.lit(signature)).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{root}/{name}")
    return version


def latest_version(spark: SparkSession, root: str, name: str) -> int | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{root}/{name}").agg(F.max("version")).first()[0]


def load_model(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    version = version or latest_version(spark, root, name)
    return spark.read.parquet(f"{root}/{name}").where(F.col("version") == version)


def model_valid(signature: str, sensors: list[str], want: str, have: list[str]) -> tuple[bool, list[str]]:
    """Whether a stored model may be used, and what speaks against it."""
    why = (["configuration changed"] if signature != want else []) + [f"sensor gone: {s}" for s in sorted(set(sensors) - set(have))] + [f"sensor new: {s}" for s in sorted(set(have) - set(sensors))]
    return not why, why


# files for people and other programs


def as_text(df: DataFrame, digits: int = 6) -> DataFrame:
    """Times as yyyy-MM-dd HH:mm:ss and doubles rounded to significant digits, as text files show them.

    The digits are those of C's %e, halves by the binary value; a product with a power of ten and Java's formats miss some.
    """

    @F.arrow_udf("double")
    def shown(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else float(f"{x:.{digits - 1}e}") + 0.0 for x in v.to_pylist()], pa.float64())

    def one(f: T.StructField):
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return shown(f.name).alias(f.name)
        return F.col(f.name)

    return df.select(*[one(f) for f in df.schema])


def write_scores(scores: DataFrame, path: str, run_id: str) -> None:
    """Scores as a table, unrounded, and beside it as CSV."""
    write_table(scores, f"{path}/scores", run_id)
    as_text(scores).write.mode("overwrite").option("header", True).csv(f"{path}/scores_csv")


def episode_rows(episodes: DataFrame) -> DataFrame:
    """Episodes with a severity in words, its rank and their length in hours."""
    level = F.when(F.col("severity") == "CRITICAL", 4).when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    return episodes.select("equip_id", "episode_id", "start_ts", "end_ts", (F.col("duration_s") / 3600).alias("duration_hours"), F.lower("severity").alias("severity"), level.alias("severity_rank"), "culprits")


def write_episodes(episodes: DataFrame, path: str, run_id: str) -> None:
    write_table(episode_rows(episodes), f"{path}/episodes", run_id)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, in a column ``value`` that the text sink writes."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


class Artifacts:
    """Tables of a run by name, kept in the cluster's memory and disk until they are dropped."""

    def __init__(self) -> None:
        self.tables: dict[str, DataFrame] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.drop(name)
        self.tables[name] = df.persist()
        return self.tables[name]

    def get(self, name: str) -> DataFrame | None:
        return self.tables.get(name)

    def drop(self, name: str | None = None) -> None:
        for key in [name] if name is not None else list(self.tables):
            if key in self.tables:
                self.tables.pop(key).unpersist()
