"""Training texts from instruction/code samples, and completion masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import bytes as byte_tokens
from quern.functions.prompts import (
    FENCE_CLOSE, both_filled, drop_end_marker, fenced_text, prompt,
)
from quern.functions.text import CODE_END, strip, text_or_empty
from quern.operators.tokens import MAX_TOKENS

SAMPLE_TYPE = "code_comment"


def of_type(samples: DataFrame, sample_type: str = SAMPLE_TYPE) -> DataFrame:
    return samples.filter(F.col("type") == sample_type)


def of_other_type(samples: DataFrame, sample_type: str = SAMPLE_TYPE) -> DataFrame:
    """What ``of_type`` leaves out, a type of NULL included."""
    return samples.filter(~F.col("type").eqNullSafe(F.lit(sample_type)))


def _or_empty(samples: DataFrame, **texts: Column) -> DataFrame:
    filled_in = both_filled("instruction", "code")
    return samples.withColumns(
        {name: F.when(filled_in, text).otherwise("") for name, text in texts.items()}
    )


def prompt_completion(samples: DataFrame, system: bool = False) -> DataFrame:
    """Prompt and completion; both are empty if the instruction or the code is."""
    return _or_empty(
        of_type(samples), prompt=prompt(text_or_empty("instruction"), system=system),
        completion=F.concat(strip(text_or_empty("code")), F.lit("\n")),
    )


def single_text(samples: DataFrame) -> DataFrame:
    """Prompt and fenced code as one text."""
    return _or_empty(
        of_type(samples), text=fenced_text(text_or_empty("instruction"), text_or_empty("code"))
    )


def marked_text(samples: DataFrame, eos: str = "", strip_marker: bool = False) -> DataFrame:
    """``single_text`` with the end marker and the end token.  Code from sample building ends
    with a marker already and then shows it twice, unless ``strip_marker``."""
    code = text_or_empty("code")
    code = drop_end_marker(code) if strip_marker else code
    ending = f"\n{CODE_END}{eos}"
    return _or_empty(
        of_type(samples), text=fenced_text(text_or_empty("instruction"), code, ending)
    )


def drop_empty(formatted: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        formatted = formatted.filter(strip(F.col(name)) != "")
    return formatted


def empty_rejects(formatted: DataFrame, key: str, *columns: str) -> DataFrame:
    """What ``drop_empty`` leaves out."""
    empty = F.lit(False)
    for name in columns:
        empty = empty | (strip(F.col(name)) == "")
    return formatted.filter(empty).select(
        F.lit("format").alias("stage"), F.col(key).cast("string").alias("key"),
        F.lit("empty_text").alias("reason"), F.lit(None).cast("string").alias("detail"),
    )


def format_totals(*columns: str) -> list[Column]:
    """Rows before, skipped and kept by ``drop_empty``."""
    kept = F.lit(True)
    for name in columns:
        kept = kept & (strip(F.col(name)) != "")
    return [
        F.count(F.lit(1)).alias("before"), F.count_if(~kept).alias("skipped"),
        F.count_if(kept).alias("kept"),
    ]


def format_counts(formatted: DataFrame, *columns: str) -> DataFrame:
    return formatted.agg(*format_totals(*columns))


def require_some(kept: int) -> None:
    """Fails if nothing is left to train on."""
    if not kept:
        raise ValueError("no sample with both an instruction and code is left")


def require_rows(formatted: DataFrame) -> DataFrame:
    require_some(not formatted.isEmpty())
    return formatted


def completion_masks(
    samples: DataFrame, key: Sequence[str] = (), limit: int = MAX_TOKENS
) -> DataFrame:
    """ids, labels (-100 over the prompt) and mask of the fenced text, plus a prefix check."""
    head = prompt(text_or_empty("instruction"), fence=True)
    whole = F.concat(head, strip(text_or_empty("code")), F.lit(FENCE_CLOSE))
    encoded = of_type(samples).select(
        *key, head.alias("_head"), byte_tokens.encode(whole, limit, add_eos=False).alias("input_ids"),
        F.least(byte_tokens.byte_length(head), F.lit(limit)).alias("prompt_tokens"),
    )
    prompt_ids = byte_tokens.encode("_head", limit, add_eos=False)
    return encoded.select(
        *key, "input_ids", "prompt_tokens",
        byte_tokens.completion_labels("input_ids", F.col("prompt_tokens")).alias("labels"),
        F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"),
        byte_tokens.starts_with("input_ids", prompt_ids).alias("prompt_is_prefix"),
    )


def mask_counts(
    masked: DataFrame, key: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Sizes of ids, labels and mask.  ``keep`` names further columns to carry along."""
    trained = F.filter("labels", lambda label: label != byte_tokens.IGNORED)
    return masked.select(
        *key, F.size("input_ids").alias("n_ids"), "prompt_tokens",
        F.size(trained).alias("trained"), (F.size("labels") - F.size(trained)).alias("masked"),
        F.size("attention_mask").alias("mask_length"), "prompt_is_prefix", *keep,
    )
