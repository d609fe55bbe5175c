"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. quality: rejected documents go. 2. near duplicates: one document of each group stays. 3. decontamination: documents
that hold benchmark text go. 4. personal data becomes surrogates. 5. mixing: what the mix takes of each document.
All but the last return the columns of ``documents``. A stage that has nothing to do returns its rows as they are;
nulls, empty texts and empty tables pass as the operators define.

A stage's scratch tables lie in one folder and serve its own result only. That has been written when the next stage (or
the next run) starts, which removes the folder; the last one goes with the application.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattfold.llm import decontam, mixing, pii, quality, shingles
from wattfold.llm.scratch import folder, remove, written
from wattfold.session import scratch_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_former: list[tuple[str, str]] = []  # application, scratch folder of the stage before


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(work: Stage) -> Stage:
    """Keeps the scratch tables of ``work`` together, and removes those of the stage before."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        while _former:
            whose, path = _former.pop()
            if whose == application:
                remove(spark, path)
        with scratch_folder(spark, work.__name__) as path:
            _former.append((application, path))
            return work(spark, docs, sf_dir)

    run.__name__ = work.__name__
    return run


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accept(docs, _table(spark, sf_dir, "labels"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.deduplicate(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


@stage
def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs)


@stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", surrogates),
    ("mixing", source_mixing),
]
#: A trained classifier, fingerprints and alignments are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, work in STAGES:
        path = folder(spark, name.replace(" ", "-"))
        docs = written(work(spark, docs, sf_dir), f"{path}/rows")
        if before:
            remove(spark, before)
        before = path
    return docs
