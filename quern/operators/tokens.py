"""Token ids, their statistics, masks and padded batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions.bytes import byte_length, encode
from quern.functions.slices import slices
from quern.functions.text import filled, strip, text_or_empty
from quern.operators.ordering import number_rows

MAX_TOKENS = 2048
BATCH_ROWS = 4


def code_by_type() -> Column:
    """The text to train on: some sample types carry it in another column."""
    code = text_or_empty("code")
    return (
        F.when(F.col("type") == "completion", F.coalesce(filled("original_code"), code))
        .when(F.col("type") == "bug_fix", F.coalesce(filled("fixed_code"), code))
        .otherwise(code)
    )


def with_code(samples: DataFrame) -> DataFrame:
    return samples.withColumn("code", code_by_type()).withColumn(
        "is_blank", strip(F.col("code")) == ""
    )


def _reject(key: str, reason: Column | str, detail: Column) -> list[Column]:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return [
        F.lit("tokens").alias("stage"), F.col(key).cast("string").alias("key"),
        reason.alias("reason"), detail.alias("detail"),
    ]


def _about() -> Column:
    return F.concat_ws(": ", "type", F.substring("instruction", 1, 80))


def blank_total() -> Column:
    """How many samples have no text."""
    return F.count_if(strip(code_by_type()) == "").alias("skipped")


def blank_rejects(samples: DataFrame, key: str) -> DataFrame:
    return with_code(samples).filter("is_blank").select(*_reject(key, "blank_code", _about()))


def line_rejects(samples: DataFrame, key: str, corrupt: str) -> DataFrame:
    """``blank_rejects`` of parsed lines, and the lines that are no JSON object."""
    bad = F.col(corrupt).isNotNull()
    return blank_rejects(samples.filter(~bad), key).unionByName(samples.filter(bad).select(
        *_reject(key, "json_decode_error", F.substring(corrupt, 1, 80))
    ))


def rejects_of(samples: DataFrame, key: str, stage: str, reason: str) -> DataFrame:
    """Rejects of ``stage`` for all of ``samples``, with one reason."""
    return samples.select(*_reject(key, reason, _about())).withColumn("stage", F.lit(stage))


def undecodable_rejects(lines: DataFrame, key: str, corrupt: str, stage: str) -> DataFrame:
    """The lines that are no JSON object."""
    return lines.filter(F.col(corrupt).isNotNull()).select(
        *_reject(key, "json_decode_error", F.substring(corrupt, 1, 80))
    ).withColumn("stage", F.lit(stage))


def token_rejects(tokenised: DataFrame, key: str) -> DataFrame:
    """Samples the tokenizer failed on, and samples that were cut (those stay in the table)."""
    failed = failed_rows(tokenised)
    detail = F.col("error") if "error" in tokenised.columns else F.lit(None).cast("string")
    reason = F.when(failed, "tokenizer_error").when(F.col("truncated"), "cut_to_limit")
    cut = F.format_string("%s of %s tokens", "n_tokens", "original_tokens")
    return tokenised.select(
        *_reject(key, reason, F.when(failed, detail).otherwise(cut))
    ).filter(F.col("reason").isNotNull())


def tokenise(
    samples: DataFrame, key: Sequence[str] = (), limit: int = MAX_TOKENS, keep_eos: bool = False,
) -> DataFrame:
    """Byte-level ids of every sample with text.  ``original_tokens`` counts before the cut."""
    total = byte_length("code") + 1
    return with_code(samples).filter(~F.col("is_blank")).select(
        *key,
        F.coalesce("type", F.lit("unknown")).alias("type"),
        encode("code", limit, keep_eos=keep_eos).alias("input_ids"),
        filled("instruction").alias("instruction"),
        F.least(total, F.lit(limit)).alias("n_tokens"),
        total.alias("original_tokens"),
        (total > limit).alias("truncated"),
    )


def tokenise_with(
    samples: DataFrame, load: Callable[[], Callable[[str], list[int]]], eos_id: int | None,
    key: Sequence[str] = (), limit: int = MAX_TOKENS,
) -> DataFrame:
    """As ``tokenise`` with any tokenizer.  ``load`` runs once per worker task and returns a
    function from text to ids.  Rows on which it fails have no ids and tell why in ``error``;
    ``token_rejects`` records them."""
    if eos_id is None:
        raise ValueError("the tokenizer has no end-of-text id")

    def batches(parts):
        encode_text = load()

        def ids(text):
            if text is None:
                return None
            try:
                return {"ids": [*encode_text(text), eos_id]}
            except Exception as exc:
                return {"error": f"{type(exc).__name__}: {exc}"}
        for part in parts:
            for (few,) in slices(part):
                yield pa.array([ids(text) for text in few.to_pylist()], type=made)

    from collections.abc import Iterator
    batches.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = pa.struct([("ids", pa.list_(pa.int32())), ("error", pa.string())])
    full = F.arrow_udf(batches, "struct<ids: array<int>, error: string>").asNondeterministic()
    return (
        with_code(samples).filter(~F.col("is_blank")).withColumn("_made", full(F.col("code")))
        .withColumn("_full", F.col("_made.ids")).select(
            *key, F.coalesce("type", F.lit("unknown")).alias("type"),
            F.slice("_full", 1, limit).alias("input_ids"),
            filled("instruction").alias("instruction"),
            F.size(F.slice("_full", 1, limit)).alias("n_tokens"),
            F.size("_full").alias("original_tokens"),
            (F.size("_full") > limit).alias("truncated"), F.col("_made.error").alias("error"),
        )
    )


def sizes(samples: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """What the statistics need, without building ids: a byte-level length is a byte count."""
    total = byte_length("code") + 1
    return with_code(samples).select(
        F.coalesce("type", F.lit("unknown")).alias("type"), "is_blank",
        F.least(total, F.lit(limit)).alias("n_tokens"), (total > limit).alias("truncated"),
    )


def stat_totals(blank: Column, failed: Column) -> list[Column]:
    """Count, total, longest, shortest and mean length; skipped, failed and cut rows."""
    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0))
    kept = F.when(~blank & ~failed, F.col("n_tokens"))
    return [
        F.count(kept).alias("samples"), zero(F.sum(kept)).alias("total_tokens"),
        zero(F.max(kept)).alias("max_tokens"), zero(F.min(kept)).alias("min_tokens"),
        F.round(zero(F.avg(kept)), 2).alias("avg_tokens"),
        F.count_if(blank).alias("skipped"), F.count_if(failed).alias("errors"),
        F.count_if(F.col("truncated") & kept.isNotNull()).alias("truncated"),
    ]


def failed_rows(tokenised: DataFrame) -> Column:
    """Rows the tokenizer failed on; the byte-level one never does."""
    return F.col("error").isNotNull() if "error" in tokenised.columns else F.lit(False)


def token_stats(sized: DataFrame) -> DataFrame:
    blank = F.col("is_blank") if "is_blank" in sized.columns else F.lit(False)
    return sized.agg(*stat_totals(blank, failed_rows(sized)))


def type_counts(sized: DataFrame) -> DataFrame:
    kept = sized.filter(~F.col("is_blank")) if "is_blank" in sized.columns else sized
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("samples"))


def length_report(tokenised: DataFrame) -> DataFrame:
    """Lengths of a stored token table."""
    n = F.size("input_ids")
    return tokenised.agg(
        F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_tokens"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_tokens"),
        F.round(F.coalesce(F.avg(n), F.lit(0)), 2).alias("avg_tokens"),
    )


def model_inputs(tokenised: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """ids and mask only.  A mask of another length than the ids is replaced by ones."""
    ids = F.coalesce("input_ids", F.array().cast("array<int>"))
    ones = F.array_repeat(F.lit(1), F.size(ids))
    mask = ones
    if "attention_mask" in tokenised.columns:
        given = F.col("attention_mask")
        mask = F.when(F.size(given) == F.size(ids), given).otherwise(ones)
    kept = tokenised.select(*key, ids.alias("input_ids"), mask.alias("attention_mask"))
    return kept.filter(F.size("input_ids") > 0)


def padded_batches(
    tokenised: DataFrame, key: str, rows: int = BATCH_ROWS, pad_id: int = 0,
    total: int | None = None,
) -> DataFrame:
    """Batches of consecutive rows, each padded to its longest row.

    Row numbers and batch lengths are worked out on (key, length) alone; the ids move once, to
    meet their target length.  ``total`` is the number of rows, if it is known.
    """
    length = F.col("n_tokens") if "n_tokens" in tokenised.columns else F.size("input_ids")
    lengths = tokenised.select(key, length.alias("n_tokens"))
    batch = F.floor((F.col("row_no") - 1) / rows)
    numbered = number_rows(lengths, [key], rows=total).select(key, "n_tokens", batch.alias("batch_id"))
    longest = F.max("n_tokens").over(Window.partitionBy("batch_id"))
    plan = numbered.select(key, "batch_id", longest.alias("pad_to"))
    padding = F.col("pad_to") - F.size("input_ids")
    return tokenised.join(plan, key).select(
        key, "batch_id", "pad_to", padding.alias("padding"),
        F.concat("input_ids", F.array_repeat(F.lit(pad_id), padding)).alias("input_ids"),
        F.concat(
            F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), padding)
        ).alias("attention_mask"),
    )
