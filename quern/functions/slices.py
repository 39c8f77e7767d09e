"""Arrow batches in slices of few rows.

A batch holds up to 10,000 rows, and Python values take many times the room that they have in Arrow: a
list of ids about five times.  A function that works slice by slice holds the values of one slice.
"""

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

ROWS = 64


def slices(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    for at in range(0, len(columns[0]), ROWS):
        yield tuple(column.slice(at, ROWS) for column in columns)


# As the functions of ``pysource``, which need it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
