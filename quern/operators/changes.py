"""What has changed in a tree of files since it was last read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NEW, CHANGED, DELETED, UNCHANGED = "new", "changed", "deleted", "unchanged"
KINDS = [NEW, CHANGED, DELETED, UNCHANGED]


def fingerprints(contents: DataFrame) -> DataFrame:
    """(file_path, content) to path, length and content hash."""
    return contents.select(
        "file_path", F.octet_length("content").cast("bigint").alias("original_size"),
        F.md5("content").alias("content_md5"),
    )


def compare(current: DataFrame, known: DataFrame) -> DataFrame:
    """(file_path, change) of every file that is or was there; both sides have one row per path."""
    then = known.select(
        "file_path", F.col("original_size").alias("known_size"), F.col("content_md5").alias("known_md5"))
    same = (F.col("original_size") == F.col("known_size")) & (F.col("content_md5") == F.col("known_md5"))
    change = (
        F.when(F.col("known_md5").isNull(), NEW).when(F.col("content_md5").isNull(), DELETED)
        .when(same, UNCHANGED).otherwise(CHANGED)
    )
    return current.join(then, "file_path", "full_outer").select("file_path", change.alias("change"))


def change_totals() -> list[Column]:
    return [F.count_if(F.col("change") == kind).alias(kind) for kind in KINDS]


def of_kind(compared: DataFrame, *kinds: str) -> DataFrame:
    return compared.filter(F.col("change").isin(*kinds)).select("file_path")
