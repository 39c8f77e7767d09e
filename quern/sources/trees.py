"""Trees of files as a table, every file of them.

Spark's own file sources leave out files that are empty and files whose name begins with ``_`` or ``.``, so
``__init__.py`` would be missing.  This data source lists a tree with Arrow's file systems, plans parts of
bounded size and reads each part's files whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES = 32 << 20
PART_FILES = 2000
BATCH_BYTES = 8 << 20


@dataclass
class Part(InputPartition):
    paths: list[str]
    top: str


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.pattern = options["path"], options["pattern"]

    def partitions(self) -> list[Part]:
        system, top = pa.fs.FileSystem.from_uri(self.uri)
        found = system.get_file_info(pa.fs.FileSelector(top, recursive=True))
        files = sorted(
            (one.path, one.size or 0) for one in found
            if one.type == pa.fs.FileType.File and fnmatchcase(one.base_name, self.pattern)
        )
        parts, size = [Part([], top)], 0
        for path, length in files:
            if parts[-1].paths and (size + length > PART_BYTES or len(parts[-1].paths) >= PART_FILES):
                parts.append(Part([], top))
                size = 0
            parts[-1].paths.append(path)
            size += length
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, _ = pa.fs.FileSystem.from_uri(self.uri)
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            paths, contents = zip(*held, strict=True)
            return pa.record_batch(
                [pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["file_path", "content"])

        for path in part.paths:
            with system.open_input_stream(path) as stream:
                content = stream.read()
            held.append((path[len(part.top):].lstrip("/"), content))
            size += len(content)
            if size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class Tree(DataSource):
    """Options: ``path`` (a URI of a folder) and ``pattern`` (of file names)."""

    @classmethod
    def name(cls) -> str:
        return "quern_tree"

    def schema(self) -> str:
        return "file_path string, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)
