"""The default tokenizer: one id per UTF-8 byte, and 256 for the end of the text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quern.functions.text import col

EOS_ID = 256
IGNORED = -100


def byte_length(text: Column | str) -> Column:
    return F.octet_length(col(text))


def _byte_values(binary: Column) -> Column:
    # Under ISO-8859-1 every byte is one character whose code point is the byte's value.
    chars = F.split(F.decode(binary, "ISO-8859-1"), "")
    return F.transform(chars, lambda c: F.ascii(c))


def encode(text: Column | str, limit: int, add_eos: bool = True, keep_eos: bool = False) -> Column:
    """Ids of the text, cut to ``limit``.  The cut may drop the end id unless ``keep_eos``."""
    raw = F.encode(col(text), "UTF-8")
    room = limit - 1 if add_eos and keep_eos else limit
    some = (F.length(col(text)) > 0) & F.lit(room > 0)
    ids = F.when(some, _byte_values(F.substring(raw, 1, room))).otherwise(
        F.array().cast("array<int>")
    )
    if not add_eos:
        return ids
    return F.slice(F.concat(ids, F.array(F.lit(EOS_ID))), 1, limit)


def decode(ids: Column | str) -> Column:
    """Text of the ids; ids outside 0..255 are skipped, a character cut in two becomes U+FFFD."""
    kept = F.filter(col(ids), lambda i: (i >= 0) & (i < EOS_ID))
    chars = F.array_join(F.transform(kept, lambda i: F.char(i.cast("bigint"))), "")
    return F.make_valid_utf8(F.encode(chars, "ISO-8859-1").cast("string"))


def completion_labels(ids: Column | str, prompt_length: Column) -> Column:
    """The ids with the prompt's share replaced by -100."""
    ids = col(ids)
    n = F.size(ids)
    masked = F.least(F.greatest(prompt_length, F.lit(0)), n).cast("int")
    return F.concat(F.array_repeat(F.lit(IGNORED), masked), F.slice(ids, masked + 1, n))


def starts_with(ids: Column | str, prompt_ids: Column | str) -> Column:
    ids, prompt_ids = col(ids), col(prompt_ids)
    return F.slice(ids, F.lit(1), F.size(prompt_ids)) == prompt_ids
