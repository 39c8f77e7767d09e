"""Exact top-k by inner product: columnar branch and bound.

Within a block the vectors lie dimension by dimension, in the order of the dimensions' mass, so that the
remaining mass shrinks early.  For a group of similar queries, the products of one block of dimensions
after the other are added up, for all its queries at once; after each, a score can still grow by at most
the product of the two remaining norms (Cauchy-Schwarz), which are worked out once per block.  Vectors
whose bound stays below the k-th best lower bound of every query of the group are compacted away, and
the next dimensions are read for the survivors only.

Components are scaled and floored to integers.  Sums stay exact in double precision while they are
below 2**53; larger values are scored in Python integers.

Cases: vectors that are NULL, empty or hold NULL or non-finite components take no part, neither do
rows with NULL id; rows that repeat an id count once (the smallest vector); a query never finds
itself; ties go to the smaller id; fewer candidates than k give all of them; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from quern.llm.vectors import best_of, ranked_search, usable

SCALE = 1024
DIMENSIONS = 16
GROUP = 32
# Vectors are compacted if this share of them, or less, stays.
COMPACT = 0.8
EXACT = float(1 << 53)


class Block:
    """Vectors in vertical layout, with the norms of what follows each block of dimensions."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        mass = (rows * rows).sum(axis=0)
        self.order = np.argsort(-mass, kind="stable")
        self.ids, self.columns = ids, np.ascontiguousarray(rows.T[self.order])
        self.heads = range(0, rows.shape[1], DIMENSIONS)
        self.tails = self.tails_of(self.columns)
        self.products = 0

    def tails_of(self, columns: np.ndarray) -> np.ndarray:
        """Norms from each block of dimensions on; a row of zeros comes last."""
        squares = [(columns[h:h + DIMENSIONS] ** 2).sum(axis=0) for h in self.heads]
        sums = np.cumsum([np.zeros(columns.shape[1]), *squares[::-1]], axis=0)[::-1]
        return np.sqrt(sums)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """Places of vectors, and exact scores of all queries with them: every vector that may be
        among the k best of one of the queries.  A query's own vector scores minus infinity."""
        queries = queries[:, self.order]
        rest = self.tails_of(queries.T)
        alive = np.arange(len(self.ids))
        own = np.searchsorted(self.ids, query_ids)
        has = np.flatnonzero(self.ids[np.minimum(own, len(self.ids) - 1)] == query_ids)
        own = own[has]
        score = np.zeros((len(queries), len(alive)))
        score[has, own] = -np.inf
        for j, head in enumerate(self.heads):
            part = self.columns[head:head + DIMENSIONS]
            part = part if len(alive) == part.shape[1] else part[:, alive]
            self.products += len(queries) * part.size
            score += queries[:, head:head + DIMENSIONS] @ part
            if len(alive) <= k + len(queries) or j + 1 == len(self.heads):
                continue
            slack = rest[j + 1][:, None] * self.tails[j + 1][alive]
            lower = score - slack
            least = np.partition(lower, len(alive) - k, axis=1)[:, len(alive) - k]
            # A hair of tolerance covers rounding in the norms; scores themselves are exact.
            keep = (score + slack >= (least - 1e-6 * (1.0 + np.abs(least)))[:, None]).any(axis=0)
            if keep.mean() <= COMPACT:
                alive, score = alive[keep], score[:, keep]
        return alive, score


def _alike(queries: np.ndarray) -> np.ndarray:
    """An order that puts queries next to each other whose largest component is the same."""
    top = np.abs(queries).argmax(axis=1)
    sign = queries[np.arange(len(queries)), top] < 0
    return np.lexsort((sign, top))


def _in_integers(query_ids, query_rows, ids, rows, k: int):
    """The same for components beyond double precision: one product after the other."""
    places, found, scores = [], [], []
    whole = [[int(x) for x in row] for row in rows]
    for place, (query_id, query) in enumerate(zip(query_ids, query_rows, strict=True)):
        own = [int(x) for x in query]
        made = sorted(
            (-sum(a * b for a, b in zip(own, row, strict=True)), i)
            for i, row in zip(ids.tolist(), whole, strict=True) if i != query_id
        )[:k]
        places += [place] * len(made)
        found += [i for _, i in made]
        scores += [-s for s, _ in made]
    return np.array(places, np.int64), np.array(found, np.int64), np.array(scores, object)


def _match(k: int, scale: int | None = None):
    def run(query_ids, query_rows, ids, rows):
        if scale is not None:
            query_rows, rows = np.floor(query_rows * scale), np.floor(rows * scale)
        limit = np.abs(rows).max(initial=0) * np.abs(query_rows).max(initial=0) * rows.shape[1]
        if limit >= EXACT:
            return _in_integers(query_ids, query_rows, ids, rows, k)
        block = Block(ids, rows)
        order = _alike(query_rows)
        places, found, scores = [], [], []
        for start in range(0, len(order), GROUP):
            group = order[start:start + GROUP]
            alive, score = block.search(query_ids[group], query_rows[group], k)
            for place, line in zip(group, score, strict=True):
                others = np.flatnonzero(line > -np.inf)
                kept = others[best_of(line[others], ids[alive[others]], k)]
                places.append(np.full(len(kept), place))
                found.append(ids[alive[kept]])
                scores.append(line[kept])
        run.products = block.products
        return np.concatenate(places), np.concatenate(found), np.concatenate(scores)

    return run


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, id_col: str = "vec_id",
    vector_col: str = "embedding", query_block: int = 16_384, vector_block: int = 8192,
) -> DataFrame:
    """The ``k`` largest integer inner products of each query; ``is_query`` may use column ``id``."""
    kept = usable(vectors, id_col, vector_col, zero_ok=True)
    return ranked_search(
        kept.filter(is_query), kept, _match(k, scale), k, "long", query_block, vector_block
    )
