"""Helpers that the operators on documents and vectors share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

LONG_KEY = 96


class Memo(dict):
    """Computes missing values and keeps them.  It starts anew when it is full, and never keeps a
    long key, so its size is bounded by ``limit`` short entries."""

    def __init__(self, compute: Callable, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= LONG_KEY:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """The texts of a batch; NULL is the empty text."""
    return [text or "" for text in batch.column(column).to_pylist()]


def map_texts(
    df: DataFrame, schema: str, rows: Callable[[list[str]], list[list]], id_col: str, text_col: str
) -> DataFrame:
    """One row per document: its id, then the columns that ``rows`` makes of a batch of texts.

    ``schema`` names the id's column first.  The step is a map over Arrow batches: no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows(texts_of(batch))
            arrays = [batch.column(0)] + [
                pa.array(values, type=kind) for values, kind in zip(made, kinds, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    fields = StructType.fromDDL(schema)
    names = fields.names
    kinds = [to_arrow_type(field.dataType) for field in fields.fields[1:]]
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, fields)


def blocks_for(size: int, block: int) -> int:
    """How many blocks of a fixed size hold ``size``; at least one."""
    return max(1, math.ceil(size / block))


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has, in whatever case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
