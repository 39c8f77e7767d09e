"""Approximate nearest neighbours with forests of random-projection trees.

The vectors are dealt by a hash of their id into shards of bounded size.  Each shard builds its own
forest over all of its rows: a tree splits a node at the hyperplane half way between two of its rows
chosen at random, and a node whose rows fall to one side (copies) is halved at random, so every row
is in one leaf of every tree.  A query searches all trees of a shard through one shared priority
queue, which always opens the nearest node of all trees, until the open leaves hold
``search_rows`` rows and ``search_share`` times the shard's rows more; their distinct rows are scored
exactly.  The shards' best rows are then ranked.

Trees split by angle.  Inner products of vectors of unequal length are led back to angles by one more
dimension that lifts all rows of a shard to the same length.

Cases: vectors that are NULL, zero, empty or hold NULL or non-finite components take no part, neither
do rows with NULL id; rows that repeat an id count once (the smallest vector); a query never finds
itself; ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame

from quern.llm.vectors import best_of, ranked_search, usable

TREES = 12
LEAF_ROWS = 128
SHARD_ROWS = 16_384
QUERY_BLOCK = 4_096
# Rows met per query and shard: as many as a sample of the shard's queries needs to find this share of
# their nearest rows, tried in these steps of the shard's rows.  (A row met in several trees counts
# each time, but is scored once.)  Vectors without any structure need a large part: on 64 independent
# dimensions about half of the rows must be scored for a recall of 0.9.
RECALL = 0.95
SAMPLE_QUERIES = 32
SHARES = (0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.85, 1.2, 2.0, 4.0)
SEARCH_ROWS = 500
MARGINS_AT_ONCE = 256


class Forest:
    """Trees over the rows of a shard, as arrays of nodes.

    ``normal[node]`` splits a node; its children are ``left[node]`` and ``right[node]``.  A child
    below zero is the leaf ``~child``.
    """

    def __init__(self, rows: np.ndarray, trees: int, leaf_rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.normals: list[np.ndarray] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaves: list[np.ndarray] = []
        self.roots = [self.grow(rows, leaf_rows, rng) for _ in range(trees)]
        self.normal = np.array(self.normals).reshape(len(self.normals), rows.shape[1])

    def grow(self, rows: np.ndarray, leaf_rows: int, rng) -> int:
        """One tree, grown from a list of open nodes: (rows of the node, parent, side)."""
        root, todo = None, [(np.arange(len(rows)), -1, 0)]
        while todo:
            members, parent, side = todo.pop()
            if len(members) <= leaf_rows:
                self.leaves.append(members)
                node = ~(len(self.leaves) - 1)
            else:
                node = len(self.normals)
                normal, below = self.split(rows, members, rng)
                self.normals.append(normal)
                self.left.append(0)
                self.right.append(0)
                todo.append((members[below], node, 0))
                todo.append((members[~below], node, 1))
            if parent < 0:
                root = node
            else:
                (self.left, self.right)[side][parent] = node
        return root

    @staticmethod
    def split(rows: np.ndarray, members: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(4):
            a, b = rows[rng.choice(members, 2, replace=False)]
            normal = a - b
            length = np.linalg.norm(normal)
            if length > 0:
                normal = normal / length
                below = rows[members] @ normal < 0
                if 0.05 < below.mean() < 0.95:
                    return normal, below
        # Copies: no plane divides them, so they are halved; both sides look equally near.
        below = np.zeros(len(members), bool)
        below[rng.permutation(len(members))[:len(members) // 2]] = True
        return np.zeros(rows.shape[1]), below

    def gather(self, margins: list[float], wanted: int, size: int) -> np.ndarray:
        """Rows of the leaves that the shared queue opens first, until ``wanted`` rows are met
        (those met in several trees count each time).

        A node's place in the queue is the sum of the squared margins of the far sides on its way.
        """
        left, right, leaves = self.left, self.right, self.leaves
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found, met = np.zeros(size, bool), 0
        while queue and met < wanted:
            cost, node = heapq.heappop(queue)
            while node >= 0:  # follow the near side down, keep the far side
                margin = margins[node]
                near, far = (left[node], right[node]) if margin < 0 else (right[node], left[node])
                heapq.heappush(queue, (cost + margin * margin, far))
                node = near
            leaf = leaves[~node]
            found[leaf] = True
            met += len(leaf)
        return np.flatnonzero(found)


def _lift(rows: np.ndarray) -> np.ndarray:
    """Rows of one length, with one more dimension."""
    squares = (rows**2).sum(axis=1)
    return np.column_stack([rows, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))])


def rows_to_meet(
    forest: Forest, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
    k: int, recall: float,
) -> int:
    """How many rows a search must meet so that the sampled queries find ``recall`` of their ``k``
    nearest rows of the shard, which are worked out by brute force."""
    sample = np.unique(np.linspace(0, len(queries) - 1, SAMPLE_QUERIES).astype(int))
    nearest_rows = []
    for i in sample:
        score = rows @ queries[i]
        score[ids == query_ids[i]] = -np.inf
        nearest_rows.append(np.argpartition(-score, min(k, len(score) - 1))[:k])
    margins = queries[sample] @ forest.normal[:, :-1].T
    for share in SHARES:
        wanted = max(k, int(share * len(rows)))
        hits = sum(
            np.isin(near, forest.gather(margin.tolist(), wanted, len(ids))).sum()
            for near, margin in zip(nearest_rows, margins, strict=True)
        )
        if hits >= recall * sum(map(len, nearest_rows)):
            return wanted
    return int(SHARES[-1] * len(rows)) + k


def _match(k: int, trees: int, leaf_rows: int, search_rows: int, search_share: float | None):
    def run(query_ids, query_rows, ids, rows):
        forest = Forest(_lift(rows), trees, leaf_rows)
        wanted = (
            rows_to_meet(forest, rows, ids, query_rows, query_ids, k, RECALL) if search_share is None
            else search_rows + int(search_share * len(rows))
        )
        places, found, scores = [], [], []
        run.scored = 0
        for start in range(0, len(query_ids), MARGINS_AT_ONCE):
            part = query_rows[start:start + MARGINS_AT_ONCE]
            margins = part @ forest.normal[:, :-1].T  # the lifted dimension of a query is zero
            for i, query in enumerate(part):
                near = forest.gather(margins[i].tolist(), wanted, len(ids))
                near = near[ids[near] != query_ids[start + i]]
                run.scored += len(near)
                score = rows[near] @ query
                kept = best_of(score, ids[near], k)
                places.append(np.full(len(kept), start + i))
                found.append(ids[near[kept]])
                scores.append(score[kept])
        return np.concatenate(places), np.concatenate(found), np.concatenate(scores)

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES,
    leaf_rows: int = LEAF_ROWS, search_rows: int = SEARCH_ROWS,
    search_share: float | None = None, id_col: str = "vec_id",
    vector_col: str = "embedding", query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """About the ``k`` largest inner products of each query; ``is_query`` may use column ``id``."""
    kept = usable(vectors, id_col, vector_col, zero_ok=False)
    return ranked_search(
        kept.filter(is_query), kept, _match(k, trees, leaf_rows, search_rows, search_share), k,
        "double", query_block, shard_rows,
    )
