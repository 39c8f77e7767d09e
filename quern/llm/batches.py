"""Documents dealt into batches of bounded text, and parcels of arrays between batches and buckets.

Operators that compare all documents by hashes deal the documents once.  A batch sends parcels to
buckets, a bucket answers the batches, and an answer joins its batch by a second key group over the
same exchange.  A parcel is one row (kind, bucket, batch, packed arrays), so a batch has at most one
row per bucket and step, and never more rows than entries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import blocks_for
from quern.session import spool

PARCEL = "kind int, bucket int, batch int, packed binary"
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
# Ids whose rows fill a batch alone; a row is below 40 bytes.
BROADCAST_IDS = 100_000
LAST_ID = np.iinfo(np.int64).max


def deal(
    docs: DataFrame, id_col: str, text_col: str, whole: bool = False, batch_bytes: int | None = None
) -> tuple[DataFrame, int]:
    """(batch, id, text, copies[, row]) and the number of text bytes.

    Rows go by a hash of their id.  Rows of an id that fills a batch alone (NULL is such an id too)
    are folded if they are equal, ``copies`` says how many they were, and dealt by all their
    columns.  With ``whole``, ``row`` holds all columns of the document.
    """
    batch_bytes = batch_bytes or BATCH_BYTES
    own = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([own.alias("row")] if whole else [])
    )
    sizes = spool(rows.groupBy("id").agg(
        F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    batches = blocks_for(total, batch_bytes)

    def place(*by: str):
        return F.pmod(F.xxhash64(*by, F.lit("batch")), F.lit(batches)).cast("int")

    large = sizes.filter((F.col("n") > 1) & (F.col("size") > batch_bytes)).select(F.col("id").alias("large"))
    found = large.limit(BROADCAST_IDS + 1).count()
    if not found:
        return rows.withColumns({"copies": F.lit(1).cast("long"), "batch": place("id")}), total
    if found <= BROADCAST_IDS:
        large = F.broadcast(large)
    same = rows["id"].eqNullSafe(large["large"])
    alone = rows.join(large, same, "left_anti").withColumns(
        {"copies": F.lit(1).cast("long"), "batch": place("id")})
    shared = rows.join(large, same, "left_semi").groupBy(*rows.columns).agg(
        F.count(F.lit(1)).alias("copies")).withColumn("batch", place(*rows.columns))
    return alone.unionByName(shared), total


def copied(made: DataFrame, *columns) -> DataFrame:
    """One row per copy; ``columns`` are what stays."""
    once = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return made.withColumn("copy", F.explode(once)).select(*columns)


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    changed = np.zeros(len(sorted_keys[0]), bool)
    changed[0] = True
    for key in sorted_keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changed)


def pack(arrays: Sequence[np.ndarray]) -> bytes:
    return b"".join(
        part for array in arrays for part in (np.uint32(array.nbytes).tobytes(), array.tobytes())
    )


def unpack(packed: bytes, kinds: Sequence[str]) -> list[np.ndarray]:
    arrays, at = [], 0
    for kind in kinds:
        size = int.from_bytes(packed[at:at + 4], "little")
        arrays.append(np.frombuffer(packed, kind, size // np.dtype(kind).itemsize, at + 4))
        at += 4 + size
    return arrays


def sections(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket of entries sorted by bucket, and its stretch."""
    heads = runs(bucket)
    for head, tail in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=False):
        yield int(bucket[head]), slice(head, tail)


def parcels(rows: Sequence[tuple[int, int, int, bytes]]) -> pa.Table:
    """Rows (kind, bucket, batch, packed)."""
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=["kind", "bucket", "batch", "packed"],
    )


def opened(table: pa.Table, kind: int, kinds: Sequence[str]) -> list[tuple[int, int, list[np.ndarray]]]:
    """(bucket, batch, arrays) of the parcels of one kind, sorted by bucket and batch."""
    rows = zip(*(table.column(n).to_pylist() for n in ("kind", "bucket", "batch", "packed")), strict=True)
    chosen = sorted((bucket, batch, packed) for k, bucket, batch, packed in rows if k == kind)
    return [(bucket, batch, unpack(packed, kinds)) for bucket, batch, packed in chosen]


def above_least(ids: np.ndarray) -> list[np.ndarray]:
    """Ids as the least one and what they lie above it, in 32 bits if that is enough."""
    if not len(ids):
        return [np.zeros(0, "<i8"), np.zeros(0, "<u4"), np.zeros(0, "<u8")]
    least = ids.min()
    above = ids.astype(np.uint64) - np.uint64(least.astype(np.uint64))
    if above.max() >> np.uint64(32):
        return [np.array([least], "<i8"), np.zeros(0, "<u4"), above]
    return [np.array([least], "<i8"), above.astype("<u4"), np.zeros(0, "<u8")]


def ids_above(least: np.ndarray, narrow: np.ndarray, wide: np.ndarray) -> np.ndarray:
    if not len(least):
        return np.zeros(0, np.int64)
    above = wide if len(wide) else narrow.astype(np.uint64)
    return (above + np.uint64(least.astype(np.uint64)[0])).astype(np.int64)
