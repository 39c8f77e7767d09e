"""Block joins between query vectors and all vectors.

Both sides are dealt by a hash of the id into blocks of bounded size, and each pair of a query block
and a vector block is one group, so no task holds more than one block of each, whatever their
number.  A group returns the best matches of its queries; those of all groups are then ranked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm.common import blocks_for


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero_ok: bool) -> DataFrame:
    """(id, x) of vectors that are not NULL and have finite components only.  Floats stay floats, so
    that half the bytes are shuffled; tasks calculate in doubles."""
    finite = F.forall(
        "x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    )
    plain = vectors.schema[vector_col].dataType.simpleString() in ("array<float>", "array<double>")
    vector = F.col(vector_col) if plain else F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("x")).filter(
        F.col("id").isNotNull() & (F.size("x") > 0) & finite
    )
    return kept if zero_ok else kept.filter(F.exists("x", lambda c: c != 0.0))


def matrix_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group, one row per id: of rows that share an id the smallest stays.

    Vectors of unequal length are padded with zeros, which changes no inner product.
    """
    ids = table.column("id").to_numpy()
    lists = table.column("x").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    rows = np.zeros((len(ids), int(sizes.max(initial=0))))
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    if (ids[order][1:] == ids[order][:-1]).any():
        order = np.lexsort((*rows.T[::-1], ids))
    ids, rows = ids[order], rows[order]
    first = np.r_[True, ids[1:] != ids[:-1]]
    return ids[first], rows[first]


def ranked_search(
    queries: DataFrame, vectors: DataFrame, match: Callable, k: int, score_type: str,
    query_block: int, vector_block: int,
) -> DataFrame:
    """The ``k`` best (query_id, rank, vec_id, score).

    ``match(query_ids, query_rows, ids, rows)`` gives arrays (place of the query, id, score) of at
    most ``k`` matches per query.
    """
    n_queries = blocks_for(queries.count(), query_block)
    n_vectors = blocks_for(vectors.count(), vector_block)

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.withColumn("q", block(n_queries)).withColumn("b", every(n_vectors))
    right = vectors.withColumn("b", block(n_vectors)).withColumn("q", every(n_queries))
    kind = pa.int64() if score_type == "long" else pa.float64()
    names = ["query_id", "vec_id", "score"]

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        if not own.num_rows or not others.num_rows:
            made = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            query_ids, query_rows = matrix_of(own)
            ids, rows = matrix_of(others)
            width = max(query_rows.shape[1], rows.shape[1])
            query_rows, rows = (
                np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (query_rows, rows)
            )
            place, found, score = match(query_ids, query_rows, ids, rows)
            made = (query_ids[place], found, score)
        return pa.table([
            pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()),
            pa.array(made[2].astype(kind.to_pandas_dtype()), kind),
        ], names=names)

    found = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(
        run, f"query_id long, vec_id long, score {score_type}"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best, largest score first, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        kept = np.flatnonzero(score >= least)
    else:
        kept = np.arange(len(score))
    return kept[np.lexsort((ids[kept], -score[kept]))[:k]]
