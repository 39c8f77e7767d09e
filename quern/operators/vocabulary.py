"""Labels, windows and audits of token tables on a merging vocabulary.

The byte-level counterparts are in ``formats``, ``tokens`` and ``audit``; those stay in the JVM.  Here
ids come from a vocabulary file, so tokens can span the end of a prompt, a cut can split a character,
and a text may not come back as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import vocabulary
from quern.functions.bytes import IGNORED
from quern.functions.prompts import FENCE_CLOSE, prompt
from quern.functions.text import col, strip, text_or_empty
from quern.operators.audit import INDENT
from quern.operators.formats import of_type
from quern.operators.tokens import MAX_TOKENS, tokenise_with

FORMAT_TOKENS = ("newline_tokens", "space_tokens", "indent_tokens")


def tokenise(
    samples: DataFrame, path: str, eos: str, key: Sequence[str] = (), limit: int = MAX_TOKENS
) -> DataFrame:
    """Ids of every sample with text, with the end token."""
    eos_id = vocabulary.token_id(path, eos)
    return tokenise_with(samples, lambda: vocabulary.encoder(path), eos_id, key, limit)


def labels(
    texts: DataFrame, path: str, key: Sequence[str], prompt_text: Column | str,
    completion: Column | str, limit: int = MAX_TOKENS, rule: str = vocabulary.MASK,
) -> DataFrame:
    """ids, labels (-100 over the prompt), mask, prefix check and straddling tokens of each row."""
    made = vocabulary.completion_labels(path, col(prompt_text), col(completion), limit, rule)
    # The column must not be evaluated once per field that is read.
    rows = texts.select(*key, made.alias("_made")).filter(F.col("_made").isNotNull())
    return rows.select(
        *key, "_made.*", F.array_repeat(F.lit(1), F.size("_made.input_ids")).alias("attention_mask")
    )


def completion_masks(
    samples: DataFrame, path: str, key: Sequence[str] = (), limit: int = MAX_TOKENS,
    rule: str = vocabulary.MASK,
) -> DataFrame:
    """``labels`` of fenced texts: the prompt is the instruction, the completion is the code."""
    head = prompt(text_or_empty("instruction"), fence=True)
    rest = F.concat(strip(text_or_empty("code")), F.lit(FENCE_CLOSE))
    return labels(of_type(samples), path, key, head, rest, limit, rule)


def trained_part(masked: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """Text and format tokens of the ids that carry a label."""
    pairs = F.arrays_zip(F.col("input_ids").alias("id"), F.col("labels").alias("label"))
    kept = F.transform(F.filter(pairs, lambda p: p["label"] != IGNORED), lambda p: p["id"])
    rows = masked.select(*key, kept.alias("ids")).withColumn("_made", vocabulary.decoded(path, F.col("ids")))
    return rows.select(
        *key, F.size("ids").alias("trained"), F.col("_made.text").alias("text"),
        F.contains("_made.text", F.lit("\n")).alias("has_newline"),
        F.contains("_made.text", F.lit(INDENT)).alias("has_indent"),
        *[F.col(f"_made.{name}").alias(name) for name in FORMAT_TOKENS],
    )


def windows(
    texts: DataFrame, path: str, key: Sequence[str], text: Column | str, size: int = MAX_TOKENS
) -> DataFrame:
    """One row per window of ``size`` ids of each text: its place, ids and share of the text.  The
    shares of a text add up to it, also where a character's bytes fall into two windows."""
    cut = texts.select(*key, F.posexplode(vocabulary.windows(path, col(text), size)).alias("place", "_w"))
    return cut.select(*key, "place", "_w.ids", "_w.text")


def roundtrip(
    texts: DataFrame, path: str, key: Sequence[str], text: str, limit: int = MAX_TOKENS
) -> DataFrame:
    """Encode, cut, decode and compare, row by row; format tokens by the vocabulary's own pieces.

    ``same`` compares with the whole text.  ``kept_same`` asks if what was kept is how the text
    begins, apart from a character that the cut split, which ``partial`` tells.
    """
    rows = texts.filter(F.col(text).isNotNull()).select(
        *key, text, vocabulary.roundtrip(path, F.col(text), limit).alias("_made")
    )
    return rows.select(
        *key, F.length(text).alias("text_chars"), "_made.n_tokens",
        F.length("_made.decoded").alias("decoded_chars"), "_made.cut", "_made.partial",
        (F.col("_made.decoded") == F.col(text)).alias("same"), "_made.kept_same",
        F.contains("_made.decoded", F.lit("\n")).alias("has_newline"),
        F.contains("_made.decoded", F.lit(INDENT)).alias("has_indent"),
        *[F.col(f"_made.{name}").alias(name) for name in FORMAT_TOKENS],
    )
