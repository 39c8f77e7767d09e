"""Incremental runs: new files arrive as parquet, each distinct text leaves once.

Two queries run one after the other.  The first lands what has arrived: it cleans a micro-batch and
writes it, with a hash of every text, into a folder of the batch's own number.  The second reads the
landed hashes as a stream into keyed state: a RocksDB store, partitioned by hash, holds for each hash
the first landing that had it.  A micro-batch looks up and writes the keys it brings and no others,
so it costs what arrived, not what is known, and a file that arrives late is treated like any other.

A batch replaces the folders of its number when it is repeated, and state goes back to the version
before it, so a run that was cut off repeats without doubling rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from quern.operators.cleaning import PASSED, clean, rejects
from quern.operators.ordering import keep_first
from quern.session import make_folder

BATCH = "batch"
LANDED = "landed"
ORDER = ["arrived_at", "file_path"]

_STATE = "spark.sql.streaming.stateStore."
KEYED_STATE = {
    f"{_STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A commit then uploads the keys that changed, not the whole store.
    f"{_STATE}rocksdb.changelogCheckpointing.enabled": "true",
}


def read_arrivals(spark: SparkSession, files: str, schema: T.StructType) -> DataFrame:
    """Parquet files that match a glob, or all files in the folders that match."""
    return spark.readStream.schema(schema).parquet(files)


def _write_batch(df: DataFrame, path: str, number: int) -> None:
    """The batch's own folder, whether there are rows or not, so the table can always be read."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")


def _read_batch(spark: SparkSession, schema: T.StructType, path: str, number: int) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{BATCH}={number}")


def run_available(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process what is there and stop.  A run that was cut off continues from its checkpoint."""
    query = (
        stream.writeStream.foreachBatch(step).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


# ------------------------------------------------------------- landing


def land_step(text: str, out: str) -> Callable[[DataFrame, int], None]:
    """Rows as they arrive, with the hash of their text."""
    def step(batch: DataFrame, number: int) -> None:
        _write_batch(batch.withColumn("code_hash", F.md5(text)), f"{out}/{LANDED}", number)
    return step


def clean_step(out: str) -> Callable[[DataFrame, int], None]:
    """Cleans a batch of (file_path, source, read_error, original_size, arrived_at).  All rows land,
    those that passed with the hash of their text; what did not pass also goes to ``rejects``, and
    the number of rows of every outcome to ``outcomes``."""
    def step(batch: DataFrame, number: int) -> None:
        made = clean(batch, keep=("arrived_at",)).drop("outline").withColumn(
            "code_hash", F.when(F.col("outcome") == PASSED, F.md5("source"))
        )
        _write_batch(made, f"{out}/{LANDED}", number)
        cleaned = _read_batch(batch.sparkSession, made.schema, f"{out}/{LANDED}", number)
        _write_batch(rejects(cleaned), f"{out}/rejects", number)
        counts = cleaned.groupBy("outcome").agg(F.count(F.lit(1)).alias("files"))
        _write_batch(counts, f"{out}/outcomes", number)
    return step


# ------------------------------------------------------------- keyed state


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The settings of the state store, for queries that start inside."""
    before = {name: spark.conf.get(name, None) for name in KEYED_STATE}
    for name, value in KEYED_STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def first_landings(landed: DataFrame) -> DataFrame:
    """The first and the last landing of every hash: the aggregate that the state store keeps."""
    return landed.groupBy("code_hash").agg(F.min(BATCH).alias("first"), F.max(BATCH).alias("last"))


def new_texts_step(
    schema: T.StructType, order: list[str], columns: list[str], out: str
) -> Callable[[DataFrame, int], None]:
    """Takes the hashes a micro-batch touched, with their first landing, and writes one row of each
    hash that no landing before had: the first by landing, then ``order``.

    ``covered`` says up to which landing a micro-batch went.  Only its own landings are read.
    """
    def step(touched: DataFrame, number: int) -> None:
        spark = touched.sparkSession
        _write_batch(touched, f"{out}/touched", number)
        touched = _read_batch(spark, touched.schema, f"{out}/touched", number)
        before = -1
        if number:
            before = _read_batch(spark, "upto int", f"{out}/covered", number - 1).first()[0]
        landed = spark.read.schema(schema).parquet(f"{out}/{LANDED}").filter(F.col(BATCH) > before)
        new = touched.filter(F.col("first") > before).select("code_hash")
        same = landed["code_hash"].eqNullSafe(new["code_hash"])
        rows = keep_first(landed.join(new, same, "left_semi"), ["code_hash"], [BATCH, *order])
        _write_batch(rows.select("code_hash", *columns), f"{out}/files", number)
        upto = touched.agg(F.coalesce(F.max("last"), F.lit(before)).cast("int").alias("upto"))
        _write_batch(upto, f"{out}/covered", number)
    return step


def run_new_texts(
    spark: SparkSession, schema: T.StructType, order: list[str], columns: list[str], out: str,
    checkpoint: str, where: str = "true",
) -> StreamingQuery:
    """Each distinct text of ``landed`` once, in ``files``.  ``schema`` is that of what landed."""
    numbered = T.StructType([*schema.fields]).add(BATCH, "integer")
    make_folder(spark, f"{out}/{LANDED}")  # nothing may have arrived yet
    landed = read_arrivals(spark, f"{out}/{LANDED}", numbered).filter(where)
    step = new_texts_step(numbered, order, columns, out)
    with keyed_state(spark):
        return run_available(
            first_landings(landed.select("code_hash", BATCH)), step, checkpoint, "update")


# ------------------------------------------------------------- whole runs


def run_distinct(stream: DataFrame, text: str, order: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Rows of new texts."""
    run_available(stream, land_step(text, out), f"{checkpoint}/landing")
    schema = T.StructType([*stream.schema.fields]).add("code_hash", "string")
    return run_new_texts(
        stream.sparkSession, schema, order, stream.columns, out, f"{checkpoint}/texts")


def run_clean(sources: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Cleaned files with new texts, rejects and outcomes of what has arrived."""
    run_available(sources, clean_step(out), f"{checkpoint}/landing")
    schema = T.StructType.fromDDL(
        "file_path string, outcome string, source string, arrived_at timestamp, code_hash string")
    return run_new_texts(
        sources.sparkSession, schema, ORDER, ["file_path", "source", "arrived_at"], out,
        f"{checkpoint}/texts", f"outcome = '{PASSED}'",
    )
