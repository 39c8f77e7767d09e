"""Instruction/code samples from cleaned sources: whole files, functions and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.functions import pysource
from quern.functions.naming import class_instruction, file_instruction, function_instruction
from quern.functions.text import (
    bind, collapse_spaces, filled, sample_json_length, seeded_rank, strip, text_or_empty,
    with_end_marker,
)
from quern.operators.ordering import keep_first

SAMPLE_TYPE = "code_comment"
MAX_SAMPLE_CHARS = 4096
MIN_FILE_CHARS = 200
MAX_FILE_CHARS = 2 * MAX_SAMPLE_CHARS
MIN_CODE_CHARS = 30
MIN_INSTRUCTION_CHARS = 5
FUNCTIONS_PER_FILE = 5
CLASSES_PER_FILE = 3
SEED = 42
ORDER = ["file_path", "kind_rank", "node_ord"]


def with_outline(files: DataFrame) -> DataFrame:
    """Adds the outline for sources that come without one."""
    return files.withColumn("outline", pysource.outline(F.col("source")))


def _picked(defs: Column, limit: int, seed: int, kind: str) -> Column:
    """At most ``limit`` definitions of a file, drawn by a seeded key; needs no shuffle."""
    keyed = F.transform(defs, lambda d: F.struct(
        seeded_rank(seed, F.col("file_path"), F.lit(kind), d["ord"]).alias("key"), d.alias("d"),
    ))
    drawn = F.slice(F.array_sort(keyed, lambda a, b: (
        F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    )), 1, limit)
    return F.transform(F.when(F.size(defs) > limit, drawn).otherwise(keyed), lambda k: k["d"])


def _segment(d: Column) -> Column:
    return strip(F.substr(F.col("source"), d["start"] + 1, d["length"]))


def _sample(kind: str, rank: int, ord_: Column, instruction: Column, code: Column, top: Column,
            reason: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(rank).alias("kind_rank"),
        ord_.cast("int").alias("node_ord"), instruction.alias("instruction"),
        code.alias("code"), top.alias("top"), reason.cast("string").alias("reason"),
    )


def _file_sample() -> Column:
    source, docstring = F.col("source"), F.col("outline.docstring")
    reason = (
        F.when(text_or_empty(source) == "", "empty_or_unreadable_file")
        .when(F.col("outline.error").isNotNull(), "ast_parse_failed")
        .when(F.length(strip(source)) < MIN_FILE_CHARS, "file_too_small")
        .when(F.length(source) > MAX_FILE_CHARS, "file_too_large")
    )
    instruction = F.coalesce(filled(docstring), file_instruction("file_path"))
    return _sample("file", 0, F.lit(0), instruction, source, F.lit(True), reason)


def _function_sample(d: Column) -> Column:
    named = function_instruction(d["name"], d["args"])
    told = collapse_spaces(F.coalesce(filled(d["docstring"]), filled(d["comments"]), named))
    instruction = bind(told, lambda text: F.when(
        F.length(text) < MIN_INSTRUCTION_CHARS, named
    ).otherwise(text))
    return _sample("function", 1, d["ord"], instruction, _segment(d), d["top"], F.lit(None))


def _class_sample(d: Column) -> Column:
    told = F.coalesce(filled(d["docstring"]), class_instruction(d["name"], d["methods"]))
    return _sample("class", 2, d["ord"], collapse_spaces(told), _segment(d), d["top"], F.lit(None))


def extract(
    files: DataFrame, functions_per_file: int = FUNCTIONS_PER_FILE,
    classes_per_file: int = CLASSES_PER_FILE, seed: int = SEED,
) -> DataFrame:
    """All samples of each file in one explode.  A file that gives no whole-file sample keeps a
    row with the reason, so the counts need no second pass."""
    if "outline" not in files.columns:
        files = with_outline(files)
    if "error" not in files.schema["outline"].dataType.names:
        files = files.withColumn(
            "outline", F.col("outline").withField("error", F.lit(None).cast("string"))
        )
    none = F.array()
    functions = _picked(F.coalesce("outline.functions", none), functions_per_file, seed, "function")
    classes = _picked(F.coalesce("outline.classes", none), classes_per_file, seed, "class")
    return (
        files.withColumn("_functions", functions).withColumn("_classes", classes)
        .select("file_path", F.explode(F.concat(
            F.array(_file_sample()),
            F.transform("_functions", _function_sample),
            F.transform("_classes", _class_sample),
        )).alias("s"))
        .select("file_path", "s.*")
    )


def check(samples: DataFrame, max_chars: int = MAX_SAMPLE_CHARS) -> DataFrame:
    """First failing rule per sample in ``reason``; survivors get the end marker and a hash.

    Top-level definitions and whole files of a parsed source parse on their own, so only nested
    ones that pass the native rules are parsed again.
    """
    kind, code, instruction = F.lit(SAMPLE_TYPE), F.col("code"), F.col("instruction")
    native = F.coalesce("reason", (
        F.when(sample_json_length(kind, instruction, code) > max_chars, "too_long_skipped")
        .when(F.length(strip(text_or_empty(code))) < MIN_CODE_CHARS, "code_too_short")
        .when(F.length(strip(text_or_empty(instruction))) < MIN_INSTRUCTION_CHARS,
              "instruction_too_short")
    ))
    parsed = (
        samples.withColumn("type", kind).withColumn("reason", native)
        .withColumn("_ok", pysource.parses(
            F.when(F.col("reason").isNull() & ~F.col("top"), F.col("code"))
        ))
        .withColumn("reason", F.coalesce(
            "reason", F.when(~F.col("_ok"), "invalid_python_after_build")
        ))
    )
    return (
        parsed.withColumn("code", F.when(F.col("reason").isNull(), with_end_marker("code")))
        .withColumn("code_hash", F.md5("code"))
        .select(*ORDER, "kind", "type", "instruction", "code", "code_hash", "reason")
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNull()).drop("reason")


def distinct_samples(checked: DataFrame) -> DataFrame:
    """Accepted samples, one per code; the first in file order wins whatever its instruction."""
    return keep_first(accepted(checked), ["code_hash"], ORDER)


def build_samples(files: DataFrame, **limits: int) -> DataFrame:
    return distinct_samples(check(extract(files, **limits)))


FILE_REASONS = ["empty_or_unreadable_file", "ast_parse_failed", "file_too_small", "file_too_large"]
REASONS = [
    *FILE_REASONS, "too_long_skipped", "code_too_short", "instruction_too_short",
    "invalid_python_after_build",
]


def reason_totals() -> list[Column]:
    """Checked rows by reason, for ``counts_of``."""
    reason = F.col("reason")
    return [
        F.count_if(reason.isNull()).alias("accepted"),
        *[F.count_if(reason == name).alias(name) for name in REASONS],
    ]


def counts_of(spark: SparkSession, totals: dict[str, int], written: int) -> DataFrame:
    """``sample_counts`` from totals by reason and the number of distinct samples."""
    told = {name: totals[name] for name in REASONS} | {
        "written": written, "duplicate": totals["accepted"] - written,
        "generated": sum(n for name, n in totals.items() if name not in FILE_REASONS),
    }
    rows = [(SAMPLE_TYPE, outcome, n) for outcome, n in told.items() if n]
    return spark.createDataFrame(rows, "type string, outcome string, samples long")


def sample_counts(checked: DataFrame) -> DataFrame:
    """Generated, written and skipped counts per type and reason, from one pass."""
    folded = checked.groupBy("type", "reason", "code_hash").agg(F.count(F.lit(1)).alias("n"))
    copies = F.col("n") - 1
    per_reason = folded.withColumn("outcomes", F.array(
        F.struct(F.coalesce("reason", F.lit("written")).alias("outcome"),
                 F.when(F.col("reason").isNull(), 1).otherwise(F.col("n")).alias("n")),
        F.struct(F.lit("duplicate").alias("outcome"),
                 F.when(F.col("reason").isNull(), copies).otherwise(0).alias("n")),
        F.struct(F.lit("generated").alias("outcome"),
                 F.when(F.coalesce("reason", F.lit("")).isin(FILE_REASONS), 0)
                 .otherwise(F.col("n")).alias("n")),
    ))
    return (
        per_reason.select("type", F.explode("outcomes").alias("o")).select("type", "o.*")
        .groupBy("type", "outcome").agg(F.sum("n").alias("samples"))
        .filter(F.col("samples") > 0)
    )


def rejects(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull()).select(
        F.lit("samples").alias("stage"), F.col("file_path").alias("key"), "reason",
        F.format_string("%s %s", "kind", "node_ord").alias("detail"),
        F.current_timestamp().alias("at"),
    )
