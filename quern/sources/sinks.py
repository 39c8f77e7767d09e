"""Writers.  Paths are always arguments; nothing is written next to the code."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Observation, functions as F

from quern.functions.text import path_stays_inside
from quern.sources import lines

SAMPLE_COLUMNS = ["type", "instruction", "code"]


class Counted:
    """A table that is counted in the pass that writes it.

    ``rows`` must be written once, with no shuffle in between: the counts then come from the tasks
    that wrote, each of which Spark counts once even if it ran again.
    """

    def __init__(self, df: DataFrame, *counts: Column):
        self.seen, self.spark = Observation(), df.sparkSession
        self.rows = df.observe(self.seen, *counts)
        self.schema = df.agg(*counts).schema

    def counts(self) -> dict:
        """What was counted; waits for the write."""
        return self.seen.get

    def report(self, **more) -> DataFrame:
        """The counts as a table of one row.  ``more`` replaces counts of these names."""
        told = self.counts() | more
        return self.spark.createDataFrame([[told[name] for name in self.schema.names]], self.schema)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_json_samples(samples: DataFrame, path: str) -> None:
    samples.select(*SAMPLE_COLUMNS).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> DataFrame:
    """One JSON object; the report is one row.  Returns a reader of what was written."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return report.sparkSession.read.schema(report.schema).json(path)


def _write_by_repo(files: DataFrame, path: str) -> None:
    """One folder per repository.  Rebalancing keeps small repositories in one file each and
    splits a repository that holds much of the data."""
    write_table(files.hint("rebalance", "repo"), path, ("repo",))


def write_landed(files: DataFrame, path: str) -> None:
    """Accepted files by repository."""
    _write_by_repo(files.filter("path_ok").drop("path_ok"), path)


def write_cleaned(cleaned: DataFrame, path: str) -> None:
    """Cleaned text under the file's relative path, by top folder."""
    folder = F.substring_index("file_path", "/", 1)
    _write_by_repo(cleaned.select("file_path", "source").withColumn("repo", folder), path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Replaces the rejects of the stages that occur, so a job may run again."""
    writer = rejects.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("stage").parquet(path)


def write_tree(files: DataFrame, root: str) -> int:
    """Texts (file_path, source) as single files below ``root``, each under its relative path; returns
    their number.  A path that would leave the root is an error.

    Every task writes its own files with Arrow's file systems, whole and under their final name, so
    a task that runs again writes the same.  The store must be one that Arrow writes.
    """
    uri = lines.qualified(files.sparkSession, root)
    if not lines.readable(uri):
        raise ValueError(f"{uri} is in a store that Arrow does not write")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = pa.fs.FileSystem.from_uri(uri)
        made: set[str] = set()
        for batch in batches:
            for path, source, inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not inside:
                    raise ValueError(f"{path} leaves the root")
                name = posixpath.normpath(f"{top}/{path}")
                folder = posixpath.dirname(name)
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(name) as out:
                    out.write((source or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = files.select("file_path", "source", path_stays_inside("file_path").alias("inside"))
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
