"""Text files as numbered lines, without a stored copy.

A data source plans byte ranges of a fixed size from the sizes of the files alone.  A first read only
counts the lines that begin in each range; a second one returns the lines with their place in the
range.  Adding what the ranges before hold gives line numbers over all files in path order.  A line
that runs on into the next ranges belongs to the one it begins in.

Lines end as in Python's text files: at a line feed, a carriage return, or both together.  The bytes are
read with Arrow's file systems; ``readable`` tells if a path is in one of them.  Compressed files are one
range each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.operators.ordering import BROADCAST_SHARDS, before_totals

RANGE_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20
# Hadoop's names for stores that Arrow reads under another name.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}
COMPRESSED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
LF, CR = 10, 13


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the session's default store, as Arrow writes it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    scheme, _, rest = system.makeQualified(folder).toString().partition(":")
    rest = rest if rest.startswith("//") else f"//{rest}"
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def readable(uri: str) -> bool:
    """Arrow reads this store, and the path is no pattern."""
    return uri.partition(":")[0] in SCHEMES.values() and not set("*?[{") & set(uri)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int
    compression: str | None


def line_ends(data: np.ndarray, more: bool) -> np.ndarray:
    """Places of the last byte of every line end.  ``more`` says that bytes follow the last one, so
    a carriage return there may be half a line end and is left for later."""
    feed, ret = data == LF, data == CR
    ret[:-1] &= ~feed[1:]
    if more and len(ret):
        ret[-1] = False
    return np.flatnonzero(feed | ret)


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.size = int(options.get("rangebytes", RANGE_BYTES))
        self.counting = options.get("count") == "true"

    def _system(self):
        return pa.fs.FileSystem.from_uri(self.uri)

    def partitions(self) -> list[Range]:
        system, root = self._system()
        info = system.get_file_info(root)
        if info.type == pa.fs.FileType.Directory:
            below = system.get_file_info(pa.fs.FileSelector(root, recursive=True))
            found = [i for i in below if i.type == pa.fs.FileType.File and not any(
                part.startswith(("_", ".")) for part in i.path[len(root):].split("/"))]
        else:
            found = [info]
        made = []
        for one in sorted(found, key=lambda i: i.path):
            compression = next((c for end, c in COMPRESSED.items() if one.path.endswith(end)), None)
            step = max(one.size, 1) if compression else self.size
            made += [
                Range(one.path, start, min(start + step, one.size), compression)
                for start in range(0, one.size, step)
            ]
        # Spark wants a partition even where there is nothing to read.
        return made or [Range("", 0, 0, None)]

    def _blocks(self, part: Range) -> Iterator[tuple[np.ndarray, bool]]:
        """Bytes from the one before the range (a line may begin at its first) to the file's end, in
        blocks, each with whether more follow."""
        system, _ = self._system()
        if part.compression:
            with system.open_input_stream(part.file, compression=part.compression) as stream:
                block = stream.read(BLOCK_BYTES)
                while block:
                    following = stream.read(BLOCK_BYTES)
                    yield np.frombuffer(block, np.uint8), bool(following)
                    block = following
            return
        with system.open_input_file(part.file) as stream:
            at, size = max(part.start - 1, 0), stream.size()
            while at < size:
                block = stream.read_at(min(BLOCK_BYTES, size - at), at)
                at += len(block)
                yield np.frombuffer(block, np.uint8), at < size

    def _lines(self, part: Range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of bytes, and where lines of the range begin and end in them, line ends included."""
        at = 0 if part.compression else max(part.start - 1, 0)
        skipping = at < part.start  # what runs on from the byte before the range is no line of it
        held = np.zeros(0, np.uint8)
        for block, more in self._blocks(part):
            data = np.concatenate([held, block]) if len(held) else block
            ends = line_ends(data, more) + 1
            if not more and (not len(ends) or ends[-1] < len(data)):
                ends = np.append(ends, len(data))
            if not len(ends):
                last = len(data) - 1 if skipping else 0
            else:
                begins, last = np.r_[0, ends[:-1]], int(ends[-1])
                if skipping:
                    begins, ends, skipping = begins[1:], ends[1:], False
                if not part.compression:
                    inside = begins + at < part.stop
                    begins, ends = begins[inside], ends[inside]
                if len(begins):
                    yield data, np.column_stack([begins, ends])
                if not part.compression and at + last >= part.stop:
                    return
            held, at = data[last:], at + last

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        place = 0
        if part.file:
            for data, edges in self._lines(part):
                if not self.counting:
                    yield self._batch(part, data, edges, place)
                place += len(edges)
        if self.counting and part.file:
            yield pa.record_batch([[part.file], [part.start], [place]], names=["file", "range", "n"])

    def _batch(self, part: Range, data: np.ndarray, edges: np.ndarray, place: int) -> pa.RecordBatch:
        begins, ends = edges[:, 0], edges[:, 1].copy()
        for mark in (LF, CR):  # the line end is no part of the line
            full = ends > begins
            full[full] = data[ends[full] - 1] == mark
            ends[full] -= 1
        low, count = int(begins[0]), len(begins)
        # Bytes between lines are dropped, so that lines lie end to end.
        keep = np.zeros(int(edges[-1, 1]) - low + 1, np.int8)
        np.add.at(keep, begins - low, 1)
        np.add.at(keep, ends - low, -1)
        text = data[low:low + len(keep) - 1][np.cumsum(keep[:-1]) > 0]
        offsets = np.r_[0, np.cumsum(ends - begins)].astype(np.int32)
        values = pa.StringArray.from_buffers(count, pa.py_buffer(offsets), pa.py_buffer(text.tobytes()))
        return pa.record_batch([
            pa.array([part.file] * count), pa.array(np.full(count, part.start)),
            pa.array(np.arange(place, place + count)), values,
        ], names=["file", "range", "place", "value"])


class Lines(DataSource):
    """Options: ``path`` (a URI), ``rangeBytes``, and ``count`` to count lines only."""

    @classmethod
    def name(cls) -> str:
        return "quern_lines"

    def schema(self) -> str:
        if self.options.get("count") == "true":
            return "file string, range long, n long"
        return "file string, range long, place long, value string"

    def reader(self, schema) -> LineReader:
        return LineReader({name.lower(): value for name, value in self.options.items()})


def numbered_lines(
    spark: SparkSession, uri: str, name: str = "source_line", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """(value, line number from 1 on over all files in path order)."""
    spark.dataSource.register(Lines)
    reader = spark.read.format(Lines.name()).option("path", uri).option("rangeBytes", str(range_bytes))
    counts = reader.option("count", "true").load()
    starts = before_totals(counts, ["file", "range"], "n", "start")
    lines = spark.read.format(Lines.name()).option("path", uri).option("rangeBytes", str(range_bytes)).load()
    if starts.count() <= BROADCAST_SHARDS:
        starts = F.broadcast(starts)
    numbered = lines.join(starts, ["file", "range"])
    return numbered.select("value", (F.col("start") + F.col("place") + 1).alias(name))
