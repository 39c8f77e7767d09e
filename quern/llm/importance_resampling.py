"""Importance resampling of documents towards a target distribution.

Features are all runs of one to ``ORDER`` consecutive words, hashed into buckets by crc32.  A bucket's
gain is the log ratio of its smoothed share in the target texts to that in the documents; a
document's weight is the mean gain of its features.  Adding Gumbel noise, fixed by a seed and the
document's id, and taking the highest scores draws documents without replacement.

Interning.  The n-grams of a block of texts go into an open-addressed NumPy table.  The key is the
xxhash64 of the n-gram's bytes; all n-grams probe together, claim free slots, and are done where key,
length and bytes equal those of the slot's owner; the others move on to the next slot.  A slot stores
its bucket and count, so crc32 runs once per distinct n-gram of the block; each occurrence keeps its
slot's number and gathers what the slot stores through it.

How it runs.  One map over the texts interns them.  It writes, to a table in the shared folder, every
document's gathered buckets, two bytes each, and one row per task with the counts of its slots.  The
gains follow from the counts, and a map over the stored buckets gathers them into weights, so no
text is read twice.  Only the bucket totals (bounded by ``BUCKETS``) pass through the driver.  Ranks come
from range partitions of scores and offsets, never from one task; identical rows are split by a salt.

Cases: NULL and blank texts have no words, no features and weight 0; texts are read whole, a very
long one as a block of its own; rows that repeat an id are scored each and share its noise; ties go
to the smaller id, NULL last, then to fewer features (rows that still tie are alike); a NULL id has
the noise of the empty id; an empty table gives an empty result, and empty target texts give gains
from smoothing alone; other columns are ignored, or kept if whole documents are asked for.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.llm.common import unused_name
from quern.operators.ordering import number_rows
from quern.session import spool

ORDER = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = "7"
# Bytes of text whose n-grams share a table; a longer text has one of its own.
BLOCK_BYTES = 1 << 20

# Fixed value: bytes that are no part of words are 00-2F, 3A-60 and 7B-7F.
_BLANKED = bytes(
    32 if byte <= 0x2F or 0x3A <= byte <= 0x60 or 0x7B <= byte <= 0x7F else byte for byte in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_BLANKED).split()  # bytes: only A-Z change


# ---------------------------------------------------------------- the table


class NGrams:
    """All n-grams of a block of texts: where each lies in the joined words, and whose it is."""

    def __init__(self, texts: list[str | None], order: int = ORDER):
        words = [words_of(text) for text in texts]
        self.n_words = np.array([len(w) for w in words], np.int64)
        joined = b"".join(b" ".join(w) + b" " for w in words if w)
        self.joined = joined
        ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.r_[0, ends + 1][:len(ends)]
        owner = np.repeat(np.arange(len(texts)), self.n_words)
        begins, stops, owners = [starts], [ends], [owner]
        for n in range(2, order + 1):
            inside = owner[n - 1:] == owner[:len(owner) - n + 1]
            begins.append(starts[:len(inside)][inside])
            stops.append(ends[n - 1:][inside])
            owners.append(owner[:len(inside)][inside])
        self.begin, stop = np.concatenate(begins), np.concatenate(stops)
        self.size = stop - self.begin
        self.owner = np.concatenate(owners)
        digest = xxhash.xxh64_intdigest
        self.key = np.fromiter(
            (digest(joined[a:b]) for a, b in zip(self.begin.tolist(), stop.tolist(), strict=True)),
            np.uint64, len(stop),
        )
        # Eight bytes from every place on, as one number.
        padded = joined + bytes(8)
        self.eight = np.ndarray((len(joined) + 1,), "<u8", padded, 0, (1,))

    def same_bytes(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether n-grams (by number) have the same bytes."""
        same = self.size[one] == self.size[two]
        live, done = np.flatnonzero(same & (one != two)), 0
        while len(live):
            a, b = one[live], two[live]
            left = self.size[a] - done
            unused = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
            apart = (self.eight[self.begin[a] + done] ^ self.eight[self.begin[b] + done]) << unused
            same[live[apart != 0]] = False
            live, done = live[(apart == 0) & (left > 8)], done + 8
        return same


class Table:
    """Open addressing with linear probing over the n-grams of a block.

    ``slot`` is the slot number of every occurrence; ``bucket`` and ``count`` are stored per slot.
    """

    def __init__(self, grams: NGrams, buckets: int = BUCKETS, key: np.ndarray | None = None):
        keys = grams.key if key is None else key
        capacity = 1 << max(4, (2 * len(keys)).bit_length())
        mask = np.uint64(capacity - 1)
        owner = np.full(capacity, -1, np.int64)
        self.slot = np.zeros(len(keys), np.int64)
        at = (keys & mask).astype(np.int64)
        pending = np.arange(len(keys))
        while len(pending):
            place = at[pending]
            free = owner[place] < 0
            owner[place[free]] = pending[free]  # of several claims the last one stays
            held = owner[place]
            same = keys[held] == keys[pending]
            same[same] = grams.same_bytes(held[same], pending[same])
            self.slot[pending[same]] = place[same]
            pending = pending[~same]
            at[pending] = (at[pending] + 1) & (capacity - 1)
        self.count = np.bincount(self.slot, minlength=capacity)
        self.bucket = np.zeros(capacity, np.int64)
        used = np.flatnonzero(owner >= 0)
        begin = grams.begin[owner[used]]
        stop = begin + grams.size[owner[used]]
        self.bucket[used] = np.fromiter(
            (zlib.crc32(grams.joined[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)),
            np.int64, len(used),
        ) % buckets

    def counts(self, buckets: int = BUCKETS) -> np.ndarray:
        total = np.zeros(buckets, np.int64)
        np.add.at(total, self.bucket, self.count)
        return total


def blocks_of(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of bounded size together."""
    block, size = [], 0
    for text in texts:
        length = len(text or "")
        if block and size + length > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(text)
        size += length
    if block:
        yield block


# ---------------------------------------------------------------- counts and gains


def _bucket_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def block_buckets(
    texts: list[str | None], order: int, buckets: int
) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words of each text, the buckets of its features, and the counts of all."""
    grams = NGrams(texts, order)
    table = Table(grams, buckets)
    gathered = table.bucket[table.slot][np.argsort(grams.owner, kind="stable")]
    packed = gathered.astype(_bucket_type(buckets))
    ends = (np.cumsum(np.bincount(grams.owner, minlength=len(texts))) * packed.itemsize).tolist()
    raw = packed.tobytes()
    parts = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return grams.n_words, parts, table.counts(buckets)


def interned(
    docs: DataFrame, id_col: str, text_col: str, order: int, buckets: int, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, kept columns, n_words, features, counts): a row per document with the buckets of its
    features, and a row per task with ``counts`` alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            words, features = [np.zeros(0, np.int64)], []
            for block in blocks_of(batch.column(1).to_pylist()):
                n_words, parts, counts = block_buckets(block, order, buckets)
                words.append(n_words)
                features += parts
                total += counts
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *batch.columns[2:], pa.array(np.concatenate(words)),
                pa.array(features, pa.binary()), pa.nulls(batch.num_rows, pa.binary()),
            ], names=schema.names)
        empty = [pa.nulls(1, field.type) for field in to_arrow_schema(schema)][:-1]
        yield pa.RecordBatch.from_arrays(
            [*empty, pa.array([total.tobytes()], pa.binary())], names=schema.names)

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    schema = T.StructType([chosen.schema["id"], *chosen.schema.fields[2:]])
    for name, kind in (("n_words", "long"), ("features", "binary"), ("counts", "binary")):
        schema = schema.add(name, kind)
    for field in schema.fields:
        field.nullable = True
    return chosen.mapInArrow(run, schema)


def total_counts(stored: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all interned texts fall into each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(packed, np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"]
        )

    folded = stored.select("counts").filter("counts is not null").mapInArrow(run, "bucket int, n long")
    counts = np.zeros(buckets, np.int64)
    for row in folded.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets``
        counts[row.bucket] = row.n
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the log ratio of the smoothed shares, floored."""
    whole = int(corpus.sum()) + len(corpus)
    aimed = int(target.sum()) + len(target)
    return np.array([
        math.floor(1000 * math.log((t + 1) * whole / ((s + 1) * aimed)))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ], np.int64)


def noise(seed: str, name: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(stored: DataFrame, gains: np.ndarray, seed: str) -> DataFrame:
    """(id, kept columns, n_words, n_features, weight, score) of every interned document."""
    shared = stored.sparkSession.sparkContext.broadcast(gains)
    kind = _bucket_type(len(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("features").to_pylist()
            features = np.array([len(p) for p in packed], np.int64) // np.dtype(kind).itemsize
            found = np.cumsum(np.r_[0, shared.value[np.frombuffer(b"".join(packed), kind)]])
            ends = np.cumsum(features)
            weight = (found[ends] - found[ends - features]) // np.maximum(features, 1)
            names = ["" if i is None else str(i) for i in batch.column("id").to_pylist()]
            score = weight + np.array([noise(seed, name) for name in names], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, (features, weight, score))], names=schema.names)

    rows = stored.filter("counts is null").drop("counts")
    schema = T.StructType(rows.schema.fields[:-1])
    for name in ("n_features", "weight", "score"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema)


# ---------------------------------------------------------------- the draw


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    seed: str = SEED, order: int = ORDER, buckets: int = BUCKETS, id_col: str = "doc_id",
    text_col: str = "text", target_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: id, ``n_features``, ``weight``, ``score`` and ``rank`` in the draw, or NULL."""
    stored = spool(interned(docs, id_col, text_col, order, buckets, keep), "interned")
    aimed = interned(target, target_col, target_col, order, buckets)
    gains = gains_of(total_counts(stored, buckets), total_counts(aimed, buckets))
    made = spool(scored(stored, gains, seed), "scores")
    able = made.filter(F.col("n_words") >= least_words)
    n = able.count()
    ordered = able.withColumns({
        "_down": -F.col("score"), "_last": F.col("id").isNull(),
        "_salt": F.xxhash64(F.monotonically_increasing_id()),
    })
    ranked = number_rows(ordered, ["_down", "_last", "id", "n_features", "_salt"], "place", n)
    rank = F.when(F.col("place") <= percent * n // 100, F.col("place").cast("long"))
    out = [F.col("id").alias(id_col), *keep, "n_features", "weight", "score"]
    rest = made.filter(F.col("n_words") < least_words)
    return ranked.select(*out, rank.alias("rank")).unionByName(
        rest.select(*out, F.lit(None).cast("long").alias("rank"))
    )


def draw_documents(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings
) -> DataFrame:
    """The drawn documents, with their own columns.  Rows are told apart by number, not by id."""
    row = unused_name(docs, "row")
    rows = spool(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = resample(rows, target, id_col=id_col, text_col=text_col, keep=(row,), **settings)
    drawn = found.filter(F.col("rank").isNotNull()).select(row)
    return rows.join(drawn, row, "left_semi").drop(row)
