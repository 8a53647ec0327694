"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

Toxic documents go, one document of each near-duplicate group stays, documents
that hold benchmark passages go, personal data is replaced in what is left, and
that is packed into token sequences. SQL can't express the stages (a trained
classifier, SimHash components, transducers, a tokenizer), so the whole is held
against brute force in tests/llm.

Defined results: a null or empty text goes through every stage as a text without
words (all such rows are near copies of each other, and one with a doc_id stays);
a row without a doc_id is never dropped as a copy, and is judged by its text
elsewhere; of rows that repeat a doc_id all stay or all go; an empty table gives
an empty result; further columns are carried up to the last stage. A stage's
folder is deleted as soon as the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantwatch.llm import common, decontaminate, packing, pii, simhash, toxicity
from plantwatch.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("decontamination", drop_leaks), ("pii", redact), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    ship(spark)
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = common.work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            common.remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    # packing cuts its pieces in the shared folder, so the last folder has been read by then
    packed = STAGES[-1][1](spark, docs, sf_dir)
    if before is not None:
        common.remove_path(spark, before)
    return packed
