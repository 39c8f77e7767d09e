"""Vector code compression: product quantisation with equal-average search.

Components become integers (scaled and floored) and vectors are cut into equal consecutive parts.
Each part position has a codebook, which starts as that part of the vectors with the smallest ids.
A round assigns every part to its nearest entry and replaces each entry by the floored mean of its
parts; after the rounds, parts are assigned again.

Equal-average search.  For parts of ``d`` components, the squared gap of two component sums is at
most ``d`` times their squared distance.  A codebook is therefore sorted by component sum, and the
search expands outward from a part's own sum until the squared gap over ``d`` strictly exceeds the
best distance; at equality it goes on, since an entry with a lower index may still tie.  Parts with
neighbouring sums expand together, a small block of entries at a time, and each part leaves as soon
as its own bound ends it.

How it runs.  A round is one map over the vectors.  Each task folds its parts to a count and sums
per entry before the shuffle, so a hot entry sends one row per task.  Only codebooks (parts times
entries, whatever the table) pass through the driver.  All arithmetic is on integers within the
exact range of the number type.

Cases: vectors that are NULL or hold NULL or non-finite components are dropped; vectors of unequal
length (or empty ones) are padded with zeros to the longest length, rounded up to whole parts; rows
that repeat an id are coded each, and seed the codebooks in the order of their components; a NULL
id comes last; fewer vectors than entries give smaller codebooks; ties go to the lower index; NULL
labels are one group; an empty table gives an empty result; other columns are ignored.  Components
so large that squared distances would leave 64 bits are refused with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quern.session import spool

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
# Parts that expand together, and entries they meet in one step.
GROUP = 512
STEP = 16
# Labels whose totals are broadcast, rows of well under 200 bytes; beyond, labels are salted.
BROADCAST_LABELS = 100_000
SALTS = 64


class Codebook:
    """The entries of one part position, sorted by component sum."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.entries, self.sums = entries[self.order], sums[self.order]
        self.squares = (self.entries * self.entries).sum(axis=1)
        self.measured = 0

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lowest) and the squared distance, for each row."""
        index = np.zeros(len(rows), np.int64)
        distance = np.zeros(len(rows), rows.dtype)
        sums = rows.sum(axis=1)
        by_sum = np.argsort(sums, kind="stable")
        for start in range(0, len(rows), GROUP):
            group = by_sum[start:start + GROUP]
            index[group], distance[group] = self._expand(rows[group], sums[group])
        return index, distance

    def _expand(self, rows: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = rows.shape[1]
        squares = (rows * rows).sum(axis=1)
        best = np.full(len(rows), -1, rows.dtype)
        index = np.full(len(rows), len(self.sums), np.int64)
        home = int(np.searchsorted(self.sums, sums[len(sums) // 2])) // STEP
        blocks = -(-len(self.sums) // STEP)
        for block in sorted(range(blocks), key=lambda b: abs(b - home)):
            part = slice(block * STEP, (block + 1) * STEP)
            least, most = self.sums[part][0], self.sums[part][-1]
            gap = np.maximum(0, np.maximum(least - sums, sums - most))
            going = np.flatnonzero((best < 0) | (gap * gap <= size * best))
            if not len(going):
                continue
            self.measured += len(going) * len(self.sums[part])
            found = squares[going, None] - 2 * (rows[going] @ self.entries[part].T) + self.squares[part]
            near = found.min(axis=1)
            name = np.where(found == near[:, None], self.order[part], len(self.sums)).min(axis=1)
            better = (best[going] < 0) | (near < best[going]) | (
                (near == best[going]) & (name < index[going]))
            best[going[better]], index[going[better]] = near[better], name[better]
        return index, best


def whole_rows(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Scaled and floored vectors, padded to ``width``, in a type that keeps all sums exact."""
    sizes = np.asarray(column.value_lengths())
    rows = np.zeros((len(column), width))
    rows[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.floor(rows * scale)
    reach = float(np.abs(rows).max(initial=0))
    bound = width * width * (2 * reach + 1) ** 2
    if bound < 2.0**53:
        return rows
    if bound < 2.0**62:
        return rows.astype(np.int64)
    raise ValueError(f"components of size {reach:.0f} after scaling leave the exact range of 64 bits")


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, x) of vectors whose components are all finite."""
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("x"),
    ).filter(F.col("x").isNotNull() & finite)


class Quantiser:
    """Codebooks for vectors of ``width`` components, one per part position."""

    def __init__(self, books: list[np.ndarray], width: int, scale: int):
        self.books, self.width, self.scale = books, width, scale

    def assign(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per part position: the parts of all vectors, their entries and squared distances."""
        rows = whole_rows(column, self.width, self.scale)
        size = self.width // len(self.books)
        for place, entries in enumerate(self.books):
            part = np.ascontiguousarray(rows[:, place * size:(place + 1) * size])
            # Codebooks are means of kept parts, so the rows' exact type holds for them too.
            yield part, *Codebook(entries.astype(part.dtype)).nearest(part)

    def digest(self) -> str:
        joined = ",".join(str(int(x)) for book in self.books for x in book.ravel())
        return hashlib.sha256(joined.encode()).hexdigest()


def first_quantiser(kept: DataFrame, width: int, parts: int, entries: int, scale: int) -> Quantiser:
    """Codebooks of the ``entries`` smallest ids."""
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").toArrow()
    rows = whole_rows(seeds.column("x").combine_chunks(), width, scale).astype(np.int64)
    return Quantiser(np.split(rows, parts, axis=1), width, scale)


def refined(kept: DataFrame, quantiser: Quantiser) -> Quantiser:
    """Every used entry replaced by the floored mean of its parts; the others stay."""
    shared = kept.sparkSession.sparkContext.broadcast(quantiser)
    size = quantiser.width // len(quantiser.books)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value.books
        counts = np.zeros((len(books), len(books[0])), np.int64)
        sums = np.zeros((len(books), len(books[0]), size), np.int64)
        for batch in batches:
            for place, (part, entry, _) in enumerate(shared.value.assign(batch.column(0))):
                counts[place] += np.bincount(entry, minlength=counts.shape[1])
                np.add.at(sums[place], entry, part.astype(np.int64))
        place, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(place.astype(np.int32)), pa.array(entry.astype(np.int32)),
            pa.array(counts[place, entry]), pa.array(list(sums[place, entry]), pa.list_(pa.int64())),
        ], names=["place", "entry", "n", "sums"])

    folded = kept.select("x").mapInArrow(fold, "place int, entry int, n long, sums array<long>")
    totals = folded.groupBy("place", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(size)]).alias("sums")
    ).collect()  # at most one row per entry
    books = [book.copy() for book in quantiser.books]
    for row in totals:
        books[row.place][row.entry] = [total // row.n for total in row.sums]
    return Quantiser(books, quantiser.width, quantiser.scale)


def coded(kept: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(id, label, code, error): the entries in part order, and the squared distances summed."""
    shared = kept.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, errors = [], np.zeros(batch.num_rows, np.int64)
            for _, entry, distance in shared.value.assign(batch.column(2)):
                entries.append(entry)
                errors += distance.astype(np.int64)
            packed = np.column_stack(entries).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([row.tobytes().hex() for row in packed], pa.string()), pa.array(errors),
            ], names=schema.names)

    schema = T.StructType([kept.schema["id"], kept.schema["label"]]).add("code", "string").add(
        "error", "long")
    return kept.mapInArrow(run, schema)


def with_label_error(codes: DataFrame) -> DataFrame:
    """Stored codes with the error summed over their label, whatever its share of the rows."""
    totals = spool(
        codes.groupBy("label").agg(F.sum("error").alias("label_error"))
        .withColumnRenamed("label", "_label"), "label-errors",
    )
    if totals.count() <= BROADCAST_LABELS:
        return codes.join(F.broadcast(totals), codes["label"].eqNullSafe(totals["_label"]))
    salted = codes.withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
    spread = totals.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(
        spread, salted["label"].eqNullSafe(spread["_label"]) & (salted["_salt"] == spread["_other"])
    )


def train(
    kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Quantiser | None:
    """The quantiser of all vectors, or None if there are none."""
    longest = kept.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts)) * parts
    quantiser = first_quantiser(kept, width, parts, entries, scale)
    for _ in range(rounds):
        quantiser = refined(kept, quantiser)
    return quantiser


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Per kept vector: its id, code, error, the error of its label, and the codebooks' digest."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte per part")
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    quantiser = train(kept, parts, entries, rounds, scale)
    if quantiser is None:
        codes = kept.select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        made = codes.withColumn("label_error", F.col("error"))
    else:
        made = with_label_error(spool(coded(kept, quantiser), "codes"))
    return made.select(
        F.col("id").alias(id_col), "code", "error", "label_error",
        F.lit(quantiser.digest() if quantiser else "").alias("codebooks_sha256"),
    )


def decoded(code: str, quantiser: Quantiser) -> np.ndarray:
    """The scaled vector that a code stands for."""
    return np.concatenate([book[i] for book, i in zip(quantiser.books, bytes.fromhex(code), strict=True)])
