"""The document pipeline: quality, near copies, repeated passages, secrets, packing.

Each stage takes the documents that its predecessor kept, with the columns of ``documents``; the
last one returns the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm import packing, quality_classifier, secret_scan, simhash_dedup, substring_dedup
from quern.llm.common import table
from quern.session import delete_table, handovers, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the rated ones among them, doesn't reject."""
    grades = quality_classifier.label_grades(table(spark, sf_dir, "labels"))
    model = quality_classifier.fit_on(docs, grades)
    return quality_classifier.quality(docs, model, whole=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by fingerprints of three-word shingles that differ
    in at most two bits."""
    return simhash_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without passages that an earlier one holds."""
    return _recounted(substring_dedup.remove_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets masked."""
    return _recounted(secret_scan.redact_secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("secret scans", secrets),
    ("packing", packed),
]

# The classifier, the fingerprints and the tokens have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of what all stages keep.  A stage's own tables are deleted when its result is written,
    and that when the next one's is; the last stage's are left, since the result reads them."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with handovers(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before is not None:
            delete_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
