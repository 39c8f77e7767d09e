"""Outputs of several tables that appear together or not at all.

A run writes its tables below a folder of its own number and marks that folder last, with one atomic
create.  Readers take the newest marked folder, so they see the tables of one run, never a mix.  What a
run left that was cut off carries no mark; the next run clears it away and takes its number.  One run at
a time writes below a root.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from quern.session import delete_table

FOLDER = "version="
MARK = "_PUBLISHED"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folder(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/{FOLDER}{number:06d}"


def published(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all versions that are complete."""
    system, path = _path(spark, root)
    if not system.exists(path):
        return []
    names = [status.getPath().getName() for status in system.listStatus(path)]
    numbers = [int(name.removeprefix(FOLDER)) for name in names if name.startswith(FOLDER)]
    return sorted(n for n in numbers if system.exists(_path(spark, f"{folder(root, n)}/{MARK}")[1]))


def is_empty(spark: SparkSession, root: str) -> bool:
    """Nothing but versions that were cut off, or no folder at all."""
    system, path = _path(spark, root)
    return not system.exists(path) or all(
        status.getPath().getName().startswith(FOLDER) for status in system.listStatus(path))


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest complete version."""
    numbers = published(spark, root)
    return folder(root, numbers[-1]) if numbers else None


@contextmanager
def publication(spark: SparkSession, root: str) -> Iterator[tuple[str, int]]:
    """Folder and number of the next version, which is complete when the block ends without error."""
    number = max(published(spark, root), default=0) + 1
    made = folder(root, number)
    delete_table(spark, made)
    yield made, number
    system, mark = _path(spark, f"{made}/{MARK}")
    system.create(mark, False).close()
