"""Cleaning of Python sources: check, redact, tidy, check again, describe."""

from __future__ import annotations

import platform
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import pysource
from quern.functions.text import redact, unify_newlines, utf8_text

MIN_CODE_LINES = 10
PASSED = "passed"
# Every outcome a file can have, in report order.
OUTCOMES = [PASSED, "syntax_error", "too_short", "cleaning_error"]
OUTLINE = ["line_count", "function_count", "imports", "docstring", "functions", "classes"]


def read_sources(raw: DataFrame) -> DataFrame:
    """(file_path, content) to (file_path, source, read_error, original_size).

    Plain UTF-8 without a byte order mark or an encoding declaration is decoded natively; only
    other files go through Python.
    """
    content = F.col("content")
    # A declaration may stand in one of the first two lines only.
    head = F.substring_index(utf8_text(content), "\n", 2)
    plain = (
        F.is_valid_utf8(content.cast("string"))
        & ~F.startswith(F.hex(F.substring(content, 1, 3)), F.lit("EFBBBF"))
        & ~F.rlike(head, F.lit(r"coding[:=]"))
    )
    declared = F.when(~plain, content)
    return (
        raw.withColumn("_declared", pysource.decode_by_declaration(declared))
        .select(
            "file_path",
            F.when(plain, unify_newlines(utf8_text(content)))
            .otherwise(F.col("_declared.text")).alias("source"),
            F.col("_declared.error").alias("read_error"),
            F.octet_length(content).cast("bigint").alias("original_size"),
        )
    )


def as_sources(
    table: DataFrame, path: str, text: str, keep: Sequence[str] = ()
) -> DataFrame:
    """A table that holds source text already."""
    return table.select(
        F.col(path).alias("file_path"), F.col(text).alias("source"),
        F.lit(None).cast("string").alias("read_error"),
        F.octet_length(text).cast("bigint").alias("original_size"), *keep,
    )


def lint_sources(sources: DataFrame) -> DataFrame:
    return sources.withColumn("lint", pysource.lint(F.col("source")))


def clean(
    sources: DataFrame, min_code_lines: int = MIN_CODE_LINES, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per file with its outcome; cleaned text and facts where it passed.  ``keep`` names
    further columns to carry along.  A file without text is a cleaning error.

    Redaction is native and comes first, so that one Python stage does the rest.  Unchanged texts
    cross to Python once and do not come back.
    """
    redacted = sources.withColumn("_redacted", redact("source"))
    changed = F.when(F.col("_redacted") != F.col("source"), F.col("_redacted"))
    done = redacted.withColumn("_done", pysource.clean(F.col("source"), changed, min_code_lines))
    outcome = (
        F.when(F.col("source").isNull() | F.col("_done.failed"), "cleaning_error")
        .when(~F.col("_done.syntax_ok"), "syntax_error")
        .when(F.col("_done.code_lines") < min_code_lines, "too_short")
        .when(F.col("_done.syntax_ok"), PASSED)
        .otherwise("cleaning_error")
    )
    return done.withColumn("outcome", outcome).select(
        "file_path", "outcome", "original_size",
        F.col("_done.error_line").alias("error_line"),
        F.coalesce(
            "read_error", "_done.error", F.when(F.col("source").isNull(), "no text")
        ).alias("error"),
        F.col("_done.code_lines").alias("code_lines"),
        F.when(F.col("outcome") == PASSED, F.coalesce("_done.text", "source")).alias("source"),
        F.struct(*[F.col(f"_done.{name}") for name in OUTLINE]).alias("outline"),
        *keep,
    )


def passed(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col("outcome") == PASSED)


def cleaned_files(cleaned: DataFrame) -> DataFrame:
    return passed(cleaned).drop(
        "outcome", "original_size", "error_line", "error", "code_lines"
    )


def manifest(cleaned: DataFrame) -> DataFrame:
    """One row per passed file.  The Python version is kept since syntax rules depend on it."""
    return passed(cleaned).select(
        "file_path", "original_size",
        F.octet_length("source").cast("bigint").alias("cleaned_size"),
        F.col("outline.line_count").alias("line_count"),
        F.col("outline.function_count").alias("function_count"),
        F.col("outline.imports").alias("imports"),
        F.current_timestamp().alias("cleaned_at"),
        F.lit(platform.python_version()).alias("python_version"),
    )


def rejects(cleaned: DataFrame) -> DataFrame:
    """Files that did not pass, with the reason and what is known about it."""
    detail = (
        F.when(F.col("outcome") == "too_short", F.format_string("%s code lines", "code_lines"))
        .when(F.col("outcome") == "syntax_error",
              F.format_string("line %s: %s", "error_line", "error"))
        .otherwise(F.col("error"))
    )
    return cleaned.filter(F.col("outcome") != PASSED).select(
        F.lit("clean").alias("stage"), F.col("file_path").alias("key"),
        F.col("outcome").alias("reason"), detail.alias("detail"),
        F.current_timestamp().alias("at"),
    )


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def outcome_totals() -> list[Column]:
    """Totals per outcome; outcomes that did not occur show up with 0."""
    outcome = F.col("outcome")
    return [
        F.count(F.lit(1)).alias("total"),
        *[_count(outcome == name).alias(name) for name in OUTCOMES],
        _count(outcome != PASSED).alias("skipped"),
    ]


def outcome_counts(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(*outcome_totals())


def import_counts(cleaned: DataFrame) -> DataFrame:
    """Number of files that import each top-level module."""
    roots = passed(cleaned).select(F.explode("outline.imports").alias("module"))
    return roots.groupBy("module").agg(F.count(F.lit(1)).alias("files"))
