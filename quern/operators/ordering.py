"""First-wins deduplication, top-k per group and row numbers that survive hot keys.

None of them puts a whole key group into one task: copies are folded on the map side, top-k runs
per group and task first, and row numbers come from range partitions plus offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.session import spool

# Key rows of a range partition.
SHARD_ROWS = 1_000_000
# Rows of well under 200 bytes each.
BROADCAST_SHARDS = 1_000_000


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the smallest order key (which should be unique).

    An aggregate, not a window: a key with a third of all rows shrinks to one row per map task
    before the shuffle.  A NULL order key comes before all others.
    """
    rest = [c for c in df.columns if c not in by]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*by).agg(first).select(*by, "_first.*").select(*df.columns)


def keep_first_text(df: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """``keep_first`` on an exact text; a 64-bit hash in front makes sorting cheap."""
    hashed = df.withColumn("_hash", F.xxhash64(text))
    return keep_first(hashed, ["_hash", text], order).drop("_hash")


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank",
    spread: int = 64,
) -> DataFrame:
    """The first ``k`` rows of each group with their rank, 1 to k.

    Ranking happens twice: first within (group, slot), where the slot follows the input partition,
    then within the group.  Up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 unless
    set) Spark puts a group limit before each shuffle, so a task sends at most ``k`` rows per
    group.  The last step sees at most ``k * spread`` rows per group.
    """
    if k <= 0:
        return df.withColumn(rank, F.lit(0)).limit(0)
    slot = F.pmod(F.spark_partition_id(), F.lit(spread))
    first = Window.partitionBy(*group, "_slot").orderBy(*order)
    last = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_slot", slot)
        .withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k)
        .withColumn(rank, F.row_number().over(last)).filter(F.col(rank) <= k)
        .drop("_slot", "_n")
    )


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(max(n, 0))


def add_offsets(
    spooled: DataFrame, shard: Sequence[str], within: str, name: str, max_shards: int | None = None
) -> DataFrame:
    """Global 1-based number from a row's place in its shard.

    ``within`` grows along each shard by one per row but may start anywhere.  The table of shard
    sizes has one row per shard (input block or range partition).  It is broadcast if their
    number, counted unless a bound is known, allows it; beyond that both sides are shuffled by
    shard, which is even, since a shard is never larger than an input split or partition.
    """
    before = Window.orderBy(*shard).rowsBetween(Window.unboundedPreceding, -1)
    sizes = spooled.groupBy(*shard).agg(F.count(F.lit(1)).alias("_n"), F.min(within).alias("_low"))
    shifts = sizes.select(
        *shard, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low") + 1).alias("_shift")
    )
    if max_shards is None:
        shifts = spool(shifts, "shifts")
        max_shards = shifts.count()
    if max_shards <= BROADCAST_SHARDS:
        shifts = F.broadcast(shifts)
    numbered = spooled.join(shifts, list(shard)).withColumn(name, F.col(within) + F.col("_shift"))
    return numbered.drop(*shard, within, "_shift")


def before_totals(counts: DataFrame, order: Sequence[str], n: str, name: str) -> DataFrame:
    """A stored table (order, total of ``n`` over all rows before).  It has one row per input range."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return spool(
        counts.select(*order, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(name)), "totals")


def number_rows(
    df: DataFrame, order: Sequence[str], name: str = "row_no", rows: int | None = None
) -> DataFrame:
    """1-based position of each row in the given order, without sorting in one task.

    Callers that know the number of rows (of a stored table) pass it; range partitions then hold
    about ``SHARD_ROWS`` rows, however many there are.
    """
    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        shards = max(shards, -(-rows // SHARD_ROWS))
    placed = (
        df.repartitionByRange(shards, *order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_shard", F.shiftright("_place", 33))
    )
    return add_offsets(spool(placed, "numbered"), ["_shard"], "_place", name, shards)
