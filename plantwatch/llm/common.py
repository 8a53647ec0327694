"""Small helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Where that is unset (tests in
    local mode) a temporary folder is made and set for the session's context.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        had = context._jsc.sc().getCheckpointDir()
        if had.isDefined():
            return str(had.get())
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        found = "file://" + tempfile.mkdtemp(prefix="plantwatch-")
        context.setCheckpointDir(found)
    return found


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete what a step wrote under the shared folder, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table written to the shared folder: columns are packed, and a later read takes only those it needs."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, spread by a hash of their key and the same ones each time.

    A cut-off on the hash, from the number of rows, leaves about twice what is
    wanted before anything is sorted, so the sort doesn't grow with the input.
    """
    total = df.count()
    shares = 1 << 30
    spread = F.pmod(F.xxhash64(key), F.lit(shares))
    if total > 4 * most:
        df = df.where(spread < max(1, shares * 2 * most // total))
    return df.orderBy(spread, key, F.xxhash64(*df.columns)).limit(most)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str, rows: int = 256) -> DataFrame:
    """Arrow-batched map of rows to rows, one output row for each input row.

    ``make`` runs once in each task and returns a function from an input row's
    values to an output row's values. Rows are handled in slices of ``rows``, so
    that a batch of very long texts is never held as Python objects at once.
    """
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    target = pa.schema([pa.field(n, _ARROW[t]) for n, t in (f.strip().split(" ") for f in schema.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = [one(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
