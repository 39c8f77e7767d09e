"""Audits of token tables: round trip, format tokens, the trained part; small samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import bytes as byte_tokens
from quern.functions.text import col, seeded_rank
from quern.operators.ordering import first_rows
from quern.operators.tokens import MAX_TOKENS

INDENT = "    "


def roundtrip(texts: DataFrame, key: Sequence[str], text: str, limit: int = MAX_TOKENS) -> DataFrame:
    """Decode what was encoded and compare, row by row.  ``same`` compares with the whole text,
    ``kept_same`` with the bytes within the limit; a text that reaches it counts as cut."""
    ids = byte_tokens.encode(text, limit, add_eos=False)
    decoded = texts.select(*key, text, ids.alias("ids")).withColumn(
        "decoded", byte_tokens.decode("ids")
    )
    kept = F.substring(F.encode(F.col(text), "UTF-8"), 1, limit)
    return decoded.select(
        *key, F.length(text).alias("text_chars"), F.size("ids").alias("n_tokens"),
        F.length("decoded").alias("decoded_chars"), (F.size("ids") >= limit).alias("cut"),
        (F.col("decoded") == F.col(text)).alias("same"),
        (F.col("decoded") == F.make_valid_utf8(kept.cast("string"))).alias("kept_same"),
        F.contains("decoded", F.lit("\n")).alias("has_newline"),
        F.contains("decoded", F.lit(INDENT)).alias("has_indent"),
    )


def roundtrip_totals() -> list[Column]:
    counted = ("same", "kept_same", "cut", "has_newline", "has_indent")
    return [
        F.count(F.lit(1)).alias("texts"), *[F.count_if(name).alias(name) for name in counted],
        F.round(F.avg(F.when(~F.col("cut"), F.col("same").cast("int"))), 6).alias("same_share"),
    ]


def roundtrip_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*roundtrip_totals())


def format_token_counts(tokens: Column | str) -> Column:
    """Newline, blank and indentation tokens among byte-pair token strings."""
    tokens = col(tokens)

    def has(*needles: str):
        def test(t: Column) -> Column:
            found = F.lit(False)
            for needle in needles:
                found = found | F.contains(t, F.lit(needle))
            return found
        return test

    def blank(t: Column) -> Column:
        return has("Ġ")(t) | F.startswith(t, F.lit("▁")) | (t == " ")

    def indent(t: Column) -> Column:
        blanks = F.length(t) - F.length(F.replace(t, F.lit("Ġ"), F.lit("")))
        return has("ĊĠ", "ĊĊ")(t) | (blanks >= 4)

    def count(test) -> Column:
        return F.size(F.filter(tokens, test))
    return F.struct(
        count(has("Ċ", "\n")).alias("newline_tokens"), count(blank).alias("space_tokens"),
        count(indent).alias("indent_tokens"),
    )


def _indents(text: str) -> Column:
    """Runs of blanks and newlines that look like indentation: four blanks or more, a newline with
    a blank after it, or an empty line."""
    return F.regexp_count(F.col(text), F.lit("\n[\n ][\n ]*| {4,}"))


def trained_part(masked: DataFrame, key: Sequence[str]) -> DataFrame:
    """Text of the ids that carry a label, and whether it holds newlines and indentation."""
    pairs = F.arrays_zip(F.col("input_ids").alias("id"), F.col("labels").alias("label"))
    kept = F.filter(pairs, lambda p: p["label"] != byte_tokens.IGNORED)
    trained = masked.select(*key, F.transform(kept, lambda p: p["id"]).alias("ids"))
    text = trained.withColumn("text", byte_tokens.decode("ids"))

    def count(code: int) -> Column:
        return F.size(F.filter("ids", lambda i: i == code))
    return text.select(
        *key, F.size("ids").alias("trained"), F.contains("text", F.lit("\n")).alias("has_newline"),
        F.contains("text", F.lit(INDENT)).alias("has_indent"),
        count(ord("\n")).alias("newline_tokens"), count(ord(" ")).alias("space_tokens"),
        _indents("text").alias("indent_tokens"),
        F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")).alias("ids_md5"),
    )


def random_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return first_rows(df, [seeded_rank(seed, key), key], n)
