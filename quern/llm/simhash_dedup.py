"""Near-duplicate groups by SimHash fingerprints and BK-trees.

A fingerprint has 64 bits; documents are linked if at most ``RADIUS`` bits differ, and a group is a
connected component of links.

Candidates.  The bits are cut into ``BLOCKS`` segments.  Two fingerprints that differ in at most two
bits agree on at least three of the five, so each distinct fingerprint joins one shard for each
choice of three segments: members of a shard agree on 38 or 39 bits, which bounds it.  In every
shard a BK-tree is built (children keyed by their Hamming distance to the parent), and the members
are searched in it with the radius, following only edges within it.  A shard then reports its
components as stars, one row per member at most, never pairs; that keeps every connection.

Shards travel by shuffle.  Broadcasting trees over all fingerprints to all tasks would visit a fixed
share of all pairs, which grows with the square of the corpus.

Components.  Stars of all shards are joined by hooking and pointer jumping on tables in the shared
folder; only counts reach the driver.  Exact copies share a fingerprint, so a group of them is one
node, whatever its size.

Cases: NULL and blank texts have fingerprint zero and are linked like any others; texts of one or
two words are one shingle; ids are integers; rows that share an id are one document, whose texts are
linked, and give a row each; a row with NULL id keeps its row and never names a group unless all ids
of it are NULL; texts are read whole; an empty table gives an empty result; other columns are ignored,
or kept if whole documents are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from quern.llm.common import unused_name
from quern.session import spool

BITS = 64
RADIUS = 2
SHINGLE = 3
BLOCKS = 5
AGREED = BLOCKS - RADIUS
SEED = 42

_U = np.uint64
_shingle_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE:
        return _shingle_hash(b" ".join(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    hashes = np.fromiter(map(_shingle_hash, shingles), _U, len(words) - SHINGLE + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start:start + (1 << 16)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(text) for text in batch.column(1).to_pylist()], _U)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made.view(np.int64))], names=[id_col, "fp"]
            )

    chosen = docs.select(id_col, text_col)
    return chosen.mapInArrow(run, T.StructType([chosen.schema[id_col]]).add("fp", "long"))


# ---------------------------------------------------------------- shards


def shard_masks(blocks: int = BLOCKS, agreed: int = AGREED) -> list[int]:
    """Bit masks of each choice of segments, as signed numbers."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(parts, agreed)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in masks]


def bk_components(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Component label (smallest place) of each distinct fingerprint under links within ``radius``.

    The BK-tree is built and searched together: a node splits its members by their distance to it,
    and a searching member follows the children whose distance is within the radius of its own.
    """
    label = np.arange(len(values))
    stack = [(np.arange(len(values)), np.arange(len(values)))]
    while stack:
        members, seekers = stack.pop()
        root = members[0]
        near = np.bitwise_count(values[seekers] ^ values[root])
        linked = seekers[near <= radius]
        if len(linked):
            names = np.unique(np.r_[label[linked], label[root]])
            if len(names) > 1:
                label[np.isin(label, names[1:])] = names[0]
        rest = members[1:]
        if not len(rest):
            continue
        apart = np.bitwise_count(values[rest] ^ values[root])
        order = np.argsort(apart, kind="stable")
        rest, apart = rest[order], apart[order].astype(np.int64)
        heads = np.flatnonzero(np.r_[True, apart[1:] != apart[:-1]])
        for child in np.split(np.arange(len(rest)), heads[1:]):
            edge = apart[child[0]]
            going = seekers[np.abs(near.astype(np.int64) - edge) <= radius]
            if len(going) > 1:  # the members themselves are always among them
                stack.append((rest[child], going))
    return label


def _shard_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard: (shard choice, agreed bits, fp, rep).  Gives (v, m), v > m."""
    names = ["v", "m"]
    held: list[np.ndarray] = []

    def stars(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        heads = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        sizes = np.diff(np.r_[heads, len(rows)])
        made = []
        for head, size in zip(heads[sizes > 1], sizes[sizes > 1], strict=True):
            part = rows[head:head + size]
            label = bk_components(part[:, 2].view(_U))
            least = np.full(len(part), np.iinfo(np.int64).max)
            np.minimum.at(least, label, part[:, 3])
            target = least[label]
            off = part[:, 3] != target
            made.append((part[off, 3], target[off]))
        return made

    def out(made) -> Iterator[pa.RecordBatch]:
        if made:
            v, m = (np.concatenate(x) for x in zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(m)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
        held.append(rows)
        if (rows[0, :2] == rows[-1, :2]).all():
            continue  # one shard goes on through the whole batch
        rows = np.concatenate(held)
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))[-1] + 1
        held = [rows[last:].copy()]
        yield from out(stars(rows[:last]))
    if held:
        yield from out(stars(np.concatenate(held)))


def stars_of(reps: DataFrame) -> DataFrame:
    """Links between the representatives (fp, rep) of distinct fingerprints, as (v, m) with v > m."""
    keys = F.array(*[
        F.struct(F.lit(i).cast("long").alias("c"), F.col("fp").bitwiseAND(F.lit(mask)).alias("k"))
        for i, mask in enumerate(shard_masks())
    ])
    sharded = reps.select(F.explode(keys).alias("s"), "fp", "rep").select("s.c", "s.k", "fp", "rep")
    return (
        sharded.repartition("c", "k").sortWithinPartitions("c", "k", "rep")
        .mapInArrow(_shard_stars, "v long, m long").distinct()
    )


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each v of edges (v, m) with v > m; ``root`` is the smallest node it reaches.

    Each round points every node to its smallest neighbour below it, hooks the other neighbours
    there, and lets pointers jump.  Tables of a round are written to the shared folder.
    """
    edges = spool(edges, "links")
    while True:
        parent = spool(edges.groupBy("v").agg(F.min("m").alias("p")), "parents")
        # (m, p): the other, larger neighbours of a node now lead to its parent.
        hooks = edges.join(parent, "v").filter("m > p").select(F.col("m").alias("v"), F.col("p").alias("m"))
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumps = parent.join(up, "p", "left").select(
            "v", F.coalesce("pp", "p").alias("m"), F.col("pp").isNotNull().alias("moved")
        )
        moved = spool(
            jumps.unionByName(hooks.withColumn("moved", F.lit(True))).groupBy("v", "m")
            .agg(F.max("moved").alias("moved")), "round",
        )
        if not moved.filter("moved").limit(1).count():
            return parent.select("v", F.col("p").alias("root"))
        edges = moved.select("v", "m")


def _links_of_ids(made: DataFrame, id_col: str) -> DataFrame:
    """Links (v, m) with v > m between the fingerprints of rows that share an id."""
    several = made.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.min("fp").alias("m"), F.max("fp").alias("most")
    ).filter("m < most").select("_id", "m")
    return several.join(made, made[id_col] == several["_id"]).filter("fp > m").select(
        F.col("fp").alias("v"), "m"
    ).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, ``fp`` and ``component_id``, the smallest id of its group.

    The nodes are the distinct fingerprints themselves, so that one whose ids are all NULL links too.
    """
    made = spool(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = spool(made.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    stars = stars_of(reps.select("fp", F.col("fp").alias("rep")))
    roots = components(stars.unionByName(_links_of_ids(made, id_col)))
    nodes = spool(
        reps.join(roots, reps["fp"] == roots["v"], "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("node")), "nodes",
    )
    names = nodes.groupBy("node").agg(F.min("least").alias("component_id"))
    named = spool(nodes.join(names, "node").select("fp", "component_id"), "groups")
    return made.join(named, "fp").select(id_col, "fp", "component_id")


def fingerprint_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = near_duplicates(docs, id_col, text_col)
    return found.select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with its own columns.  Rows are told apart by a stored number, not by id.

    The smallest id heads a group; NULL comes last, and of one id the first row.
    """
    row = unused_name(docs, "row")
    rows = spool(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows, row, text_col).select(F.col(row).alias("n"), F.col("component_id").alias("node"))
    named = rows.select(F.col(row).alias("n"), F.col(id_col).alias("id")).join(found, "n")
    heads = named.groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "n")).alias("head"))
    return rows.join(heads.select(F.col("head.n").alias(row)), row, "left_semi").select(*[
        F.col(f"`{name}`") for name in docs.columns])
