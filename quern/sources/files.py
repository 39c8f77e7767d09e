"""Readers: source trees, JSON lines with line numbers, stored stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quern import schemas
from quern.functions.text import strip
from quern.operators.ordering import add_offsets
from quern.session import spool
from quern.sources import lines, trees

CORRUPT = "_corrupt"
JSON_SPACES = " \t\n\r"


def source_tree(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """All files below ``root`` whose name matches: (file_path relative to root, content).

    From a store that Arrow doesn't read, Spark's own source reads them, which leaves out empty files
    and those whose name begins with ``_`` or ``.``.
    """
    uri = lines.qualified(spark, root)
    if lines.readable(uri):
        spark.dataSource.register(trees.Tree)
        return spark.read.format(trees.Tree.name()).option("path", uri).option("pattern", pattern).load()
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root)
    )
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(folder).toString().rstrip("/") + "/"
    relative = F.substr("path", F.lit(len(base) + 1))
    return files.select(relative.alias("file_path"), "content")


def holds_parquet(spark: SparkSession, path: str) -> bool:
    """Whether a folder is a parquet table, by the names of its files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(folder) and any(
        status.getPath().getName().endswith(".parquet") for status in system.listStatus(folder))


def json_samples(spark: SparkSession, path: str, schema: T.StructType = schemas.SAMPLE) -> DataFrame:
    """JSON lines with a declared schema, so the files are read once."""
    return spark.read.schema(schema).json(path)


def numbered_text(spark: SparkSession, path: str, name: str = "source_line") -> DataFrame:
    """(value, line number from 1 on over all files in path order).

    Stores that Arrow reads are read twice, once to count lines, and nothing is stored but one row
    per range.  From others, which only Spark reads, the lines are stored with their place in an
    input block; a line's number is that plus the lines of all blocks before.
    """
    uri = lines.qualified(spark, path)
    if lines.readable(uri):
        return lines.numbered_lines(spark, uri, name)
    placed = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
    )
    return add_offsets(spool(placed, "lines"), ["_file", "_block"], "_place", name)


def json_lines(spark: SparkSession, path: str, schema: T.StructType = schemas.SAMPLE) -> DataFrame:
    """JSON lines with their 1-based line number over all files in path order.

    Blank lines (Unicode white space) are dropped but counted; a line that is not exactly one JSON
    object keeps NULL fields and its text in ``_corrupt``.
    """
    numbered = numbered_text(spark, path)
    # A line is one object if it parses as the only element of an array: text after the object
    # or a second object on the line breaks the array or makes it longer.
    value = F.trim("value", F.lit(JSON_SPACES))
    items = F.from_json(
        F.concat(F.lit("["), value, F.lit("]")), T.ArrayType(schema), {"allowSingleQuotes": "false"}
    )
    one = F.startswith(value, F.lit("{")) & (F.size("items") == 1)
    return (
        numbered.filter(strip("value") != "").withColumn("items", items)
        .withColumn("item", F.when(one, F.get("items", F.lit(0))))
        .select(
            "source_line", "item.*", F.when(F.col("item").isNull(), F.col("value")).alias(CORRUPT)
        )
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).parquet(path)


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """Token ids by source line, as the token job writes them."""
    return spark.read.schema(schemas.TOKENISED).parquet(path)
