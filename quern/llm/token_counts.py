"""Token counts with a whole-token shortcut.

Before any text is counted, each string of the vocabulary is encoded alone; those that come back as
exactly one token form the table of whole tokens.  A pre-token of that table counts as one without
merging, and only the others are merged by the library's model.

A text is cut before each blank that follows a character other than white space.  No pre-token
spans such a place and none looks back over it, so the parts have the pre-tokens of the text.
Parts of common Latin characters are cut into pre-tokens by the same expression here, all others by
the library's own pre-tokeniser, whose character classes may be of another Unicode version.  Counts
of short parts are kept in a bounded memo, since most parts recur.

Cases: NULL is the empty text (0 tokens); a text that holds a special string is encoded whole by
the library, which turns it into the special token; long texts are never cut short; repeated rows
give repeated rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import Memo, map_texts, tokenizer_path

_CUT = re.compile(r"(?<=\S)(?= )")
_BLANK_AFTER_SPACE = re.compile(r"\s ")
_COMMON = re.compile("[\n\x20-\x7e\xa1-\u024f]*")
# Fixed value: the pre-token expression of byte-level vocabularies.
_PRE_TOKEN = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)


def byte_alphabet() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in visible]
    return {byte: chr(byte) for byte in visible} | {
        byte: chr(256 + place) for place, byte in enumerate(others)
    }


class TokenCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [token.content for token in added]
        self.alphabet = {byte: char for byte, char in byte_alphabet().items()}
        self.whole = self.whole_tokens()
        self.merged = Memo(self.count_merged)
        self.first = Memo(self.count_part)
        self.later = Memo(lambda part: self.count_part(" " + part))

    def whole_tokens(self) -> set[str]:
        """Texts of the vocabulary that are proven to encode alone as one token."""
        byte_of = {char: byte for byte, char in self.alphabet.items()}
        pieces, texts = [], []
        for piece in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                texts.append(bytes(byte_of[char] for char in piece).decode())
            except (KeyError, UnicodeDecodeError):
                continue  # not a text by itself
            pieces.append(piece)
        encoded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return {
            text for text, piece, made in zip(texts, pieces, encoded, strict=True)
            if made.tokens == [piece]
        }

    def count_merged(self, pre_token: str) -> int:
        written = pre_token.encode().decode("latin-1").translate(self.alphabet)
        return len(self.tokenizer.model.tokenize(written))

    def pre_tokens(self, part: str) -> list[str]:
        if _COMMON.fullmatch(part):
            return _PRE_TOKEN.findall(part)
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(part)
        return [part[start:end] for _, (start, end) in found]

    def count_part(self, part: str) -> int:
        whole, merged = self.whole, self.merged
        return sum(1 if token in whole else merged[token] for token in self.pre_tokens(part))

    def count(self, text: str) -> int:
        if any(token in text for token in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if _BLANK_AFTER_SPACE.search(text):
            return sum(map(self.first.__getitem__, _CUT.split(text)))
        head, *rest = text.split(" ")
        return self.first[head] + sum(map(self.later.__getitem__, rest))


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024,
    id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
) -> DataFrame:
    """Per document: ``n_bytes`` (UTF-8), ``n_tokens`` and whether there are over ``limit``."""
    path = path or tokenizer_path(vocabulary)

    def rows(texts: list[str]) -> list[list]:
        count = counter(path).count
        return [[len(text.encode()) for text in texts], [count(text) for text in texts]]

    counted = map_texts(
        docs, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long",
        rows, id_col, text_col,
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
