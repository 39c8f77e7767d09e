"""Ids of a merging vocabulary: a file of the ``tokenizers`` library at a path that every worker has.

All functions are Arrow-batched columns.  The vocabulary is loaded once per worker process.  NULL
texts give NULL.  Special strings inside texts are taken as the library takes them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quern.functions.bytes import IGNORED
from quern.functions.slices import slices

# What happens to a token that begins in the prompt and ends in the completion.
MASK, TRAIN, COUNT = "mask", "train", "count"
RULES = (MASK, TRAIN, COUNT)
BROKEN = "�"
# The longest character has four bytes, so at most three tokens can be waiting for its end.
WAITING = 3


@lru_cache(maxsize=4)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the parallel tasks
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def token_id(path: str, token: str) -> int:
    """The id of a token that must be there."""
    found = load(path).token_to_id(token)
    if found is None:
        raise ValueError(f"the vocabulary has no token {token!r}")
    return found


def encoder(path: str) -> Callable[[str], list[int]]:
    """From text to ids, without added tokens."""
    made = load(path)
    return lambda text: made.encode(text, add_special_tokens=False).ids


def _column(schema: str, rows: Callable[..., dict | None], *columns: Column) -> Column:
    """A struct column from ``rows`` of the values of a row; a row with a NULL gives NULL."""
    kind = to_arrow_type(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            arrays = batch if several else (batch,)
            for part in slices(*arrays):
                values = zip(*(array.to_pylist() for array in part), strict=True)
                made = [None if None in row else rows(*row) for row in values]
                yield pa.array(made, type=kind)

    several = len(columns) > 1
    given = Iterator[tuple[pa.Array, ...]] if several else Iterator[pa.Array]
    run.__annotations__ = {"batches": given, "return": Iterator[pa.Array]}
    return F.arrow_udf(run, f"struct<{schema}>").asNondeterministic()(*columns)


# Where a text can be cut so that its head has the tokens that it has in the whole: before a blank between
# letters or digits, at which the byte-level vocabularies always end a piece.
CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
# Characters of a head for each token wanted; a head that holds too few tokens is doubled.
CHARACTERS_PER_TOKEN = 4


@lru_cache(maxsize=4)
def splits_at_blanks(path: str) -> bool:
    """If ``CUT`` holds for a vocabulary: it takes texts as they are, in pieces of its own byte-level
    pattern, and has no further token that could span a blank."""
    made = json.loads(load(path).to_str())
    pieces = made["pre_tokenizer"] or {}
    return (
        made["normalizer"] is None and pieces.get("type") == "ByteLevel" and made["model"]["type"] == "BPE"
        and pieces.get("use_regex", True) and not pieces.get("add_prefix_space", True)
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"]
            for t in made["added_tokens"])
    )


def encode_head(path: str, text: str, limit: int):
    """The library's encoding of ``text``, of which more than the first ``limit`` tokens may be missing:
    there are more than ``limit`` if the text has more.  Long texts are not encoded to their end."""
    size = limit * CHARACTERS_PER_TOKEN
    while size < len(text) and splits_at_blanks(path):
        cut = CUT.search(text, size)
        if cut is None:
            break
        made = load(path).encode(text[:cut.start()], add_special_tokens=False)
        if len(made) > limit:
            return made
        size = 2 * cut.start()
    return load(path).encode(text, add_special_tokens=False)


# ------------------------------------------------------------- labels


def masked_tokens(ends: list[tuple[int, int]], border: int, rule: str) -> list[bool]:
    """Which tokens carry no label, from their stretches of the text and where the prompt ends."""
    if rule == TRAIN:
        return [end <= border for _, end in ends]
    return [start < border for start, _ in ends]


def labelled(path: str, prompt: str, completion: str, limit: int, rule: str) -> dict:
    whole = encode_head(path, prompt + completion, limit)
    ids, places = whole.ids[:limit], whole.offsets[:limit]
    head = encode_head(path, prompt, limit).ids[:limit]
    border = len(prompt)
    if rule == COUNT:
        masked = [i < len(head) for i in range(len(ids))]
    else:
        masked = masked_tokens(places, border, rule)
    return {
        "input_ids": ids, "labels": [IGNORED if m else i for i, m in zip(ids, masked, strict=True)],
        "prompt_tokens": len(head), "prompt_is_prefix": ids[:len(head)] == head,
        "straddling": sum(start < border < end for start, end in places),
    }


def completion_labels(
    path: str, prompt: Column, completion: Column, limit: int, rule: str = MASK
) -> Column:
    """Ids of prompt and completion as one text, and labels that are -100 over the prompt.

    Encoded alone, the prompt may end in other tokens than in the whole text: its last characters
    merge with the completion.  ``prompt_is_prefix`` is false then.  A label is decided by where the
    token lies in the text, and a token that ``straddles`` the border by the rule: ``mask`` it, as
    part of the prompt, or ``train`` it.  ``count`` masks as many tokens as the prompt alone has.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {', '.join(RULES)}")
    schema = (
        "input_ids array<int>, labels array<int>, prompt_tokens int, prompt_is_prefix boolean, "
        "straddling int"
    )
    return _column(schema, lambda p, c: labelled(path, p, c, limit, rule), prompt, completion)


# ------------------------------------------------------------- decoding


def decoded_windows(path: str, windows: list[list[int]]) -> list[str]:
    """The text of each window of consecutive ids.

    A character whose bytes are cut by a border belongs to the window that completes it: up to
    three ids wait until it is whole.  What never becomes whole, in the middle or at the end, is
    shown as U+FFFD.
    """
    decode = load(path).decode
    made, waiting = [], []
    for number, window in enumerate(windows):
        ids = waiting + window
        held = 0
        text = decode(ids, skip_special_tokens=False)
        while number < len(windows) - 1 and text.endswith(BROKEN) and held < min(WAITING, len(ids)):
            held += 1
            text = decode(ids[:len(ids) - held], skip_special_tokens=False)
        if held and text.endswith(BROKEN):
            # Not a character in the making but a broken one: nothing waits for it.
            held, text = 0, decode(ids, skip_special_tokens=False)
        made.append(text)
        waiting = ids[len(ids) - held:]
    return made


def windows(path: str, text: Column, size: int) -> Column:
    """``windows``: the ids of a text in windows of ``size``, each with its own share of the text."""
    def rows(value: str) -> dict:
        ids = load(path).encode(value, add_special_tokens=False).ids
        parts = [ids[at:at + size] for at in range(0, len(ids), size)]
        texts = decoded_windows(path, parts)
        return {"windows": [{"ids": i, "text": t} for i, t in zip(parts, texts, strict=True)]}

    return _column("windows array<struct<ids: array<int>, text: string>>", rows, text)["windows"]


def format_pieces(tokens: list[str]) -> dict:
    """Newline, blank and indentation tokens by the vocabulary's own pieces."""
    return {
        "newline_tokens": sum("Ċ" in t or "\n" in t for t in tokens),
        "space_tokens": sum("Ġ" in t or t.startswith("▁") or t == " " for t in tokens),
        "indent_tokens": sum("ĊĠ" in t or "ĊĊ" in t or t.count("Ġ") >= 4 for t in tokens),
    }


FORMAT = "newline_tokens int, space_tokens int, indent_tokens int"


def roundtrip(path: str, text: Column, limit: int) -> Column:
    """What becomes of a text that is encoded, cut to ``limit`` ids and decoded."""
    def rows(value: str) -> dict:
        whole = encode_head(path, value, limit)
        ids = whole.ids[:limit]
        back = load(path).decode(ids, skip_special_tokens=False)
        partial = len(whole) > limit and back.endswith(BROKEN) and not value.startswith(back)
        kept = back.rstrip(BROKEN) if partial else back
        return {
            "n_tokens": len(ids), "decoded": back, "cut": len(ids) >= limit, "partial": partial,
            "kept_same": value.startswith(kept) if len(whole) > limit else value == back,
            **format_pieces(whole.tokens[:limit]),
        }

    schema = f"n_tokens int, decoded string, cut boolean, partial boolean, kept_same boolean, {FORMAT}"
    return _column(schema, rows, text)


def decoded(path: str, ids: Column) -> Column:
    """Text and format tokens of lists of ids."""
    def rows(value: list[int]) -> dict:
        made = load(path)
        return {
            "text": made.decode(value, skip_special_tokens=False),
            **format_pieces([made.id_to_token(i) or "" for i in value]),
        }

    return _column(f"text string, {FORMAT}", rows, ids)
