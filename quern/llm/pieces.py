"""A public SentencePiece vocabulary as a lattice of pieces.

Texts are normalised as the vocabulary's own settings say: a blank is put in front, blanks become
the visible mark, nothing else changes.  No piece of the vocabulary holds the mark after another
character (checked when it is loaded), so a text falls apart into segments before each mark that
follows another character, and no piece spans two segments.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MARK = "▁"
UNKNOWN_PENALTY = 10.0
SHORT = 24


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.size = size
        self.pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.scores = [self.model.get_score(i) for i in range(size)]
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if self.model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.ids[piece] = i
        self.byte_of = {i: bytes([byte]) for byte, i in enumerate(self.byte_ids)}
        # What each id is written as, for decoding many at once.
        self.written = np.array(
            [self.byte_of.get(i, piece.replace(MARK, " ").encode()) for i, piece in enumerate(self.pieces)],
            object,
        )
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece of this vocabulary spans blanks inside")
        self.longest = max(map(len, self.ids))
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        # Neighbours inside a piece.  Between two characters that are no such pair every
        # segmentation has a boundary.
        self.pairs = {piece[i:i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        # Every beginning of a piece: its id, or -1 if it is no piece itself.  A walk over longer and
        # longer substrings ends at the first that begins no piece.
        self.beginnings: dict[str, int] = {
            piece[:size]: -1 for piece in self.ids for size in range(1, len(piece))
        } | self.ids

    def edges(self, segment: str) -> list[list[tuple[int, int]]]:
        """Per start: (end, id) of each piece there; id -1 is a character without a piece."""
        n, beginnings = len(segment), self.beginnings
        made = []
        for i in range(n):
            here = []
            for end in range(i + 1, n + 1):
                found = beginnings.get(segment[i:end])
                if found is None:
                    break
                if found >= 0:
                    here.append((end, found))
            if not here or here[0][0] != i + 1:
                here.insert(0, (i + 1, -1))
            made.append(here)
        return made

    def atoms(self, segment: str) -> list[str]:
        """The segment cut where no piece can span: everywhere in a long one, at the end of a
        short one (a word and the mark after it)."""
        pairs = self.pairs
        if len(segment) <= SHORT and "\n" not in segment:
            if len(segment) > 1 and segment[-2:] not in pairs:
                return [segment[:-1], segment[-1]]
            return [segment]
        made, start = [], 0
        for end in range(1, len(segment)):
            if segment[end - 1:end + 1] not in pairs:
                made.append(segment[start:end])
                start = end
        made.append(segment[start:])
        return made

    def unknown_ids(self, char: str) -> list[int]:
        return [self.byte_ids[byte] for byte in char.encode()]


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts of one length, a row each."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    return flat.reshape(len(texts), -1)


class PieceFinder:
    """Finds pieces in many strings at once, by 64-bit hashes of their substrings."""

    def __init__(self, words: Vocabulary):
        pieces = sorted(words.ids, key=len)
        hashes = np.empty(len(pieces), np.uint64)
        self.lengths, self.longest, self.none = set(map(len, pieces)), words.longest, words.size
        for length in self.lengths:
            chosen = [i for i, piece in enumerate(pieces) if len(piece) == length]
            value = np.zeros(len(chosen), np.uint64)
            for column in _mixed(_codes([pieces[i] for i in chosen])).T:
                value = value * _BASE + column
            hashes[chosen] = value
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.piece_ids = np.array([words.ids[pieces[i]] for i in order])

    def find(self, strings: list[str]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Of strings of one length, their code points and, per length, the id of the piece that
        starts at each place; ``none`` stands for no piece."""
        codes = _codes(strings)
        mixed, found = _mixed(codes), {}
        hashes = np.zeros_like(mixed)
        for length in range(1, min(codes.shape[1], self.longest) + 1):
            hashes = hashes[:, :codes.shape[1] - length + 1] * _BASE + mixed[:, length - 1:]
            if length in self.lengths or length == 1:
                at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                found[length] = np.where(self.hashes[at] == hashes, self.piece_ids[at], self.none)
        return codes, found


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def segments_of(text: str) -> list[str]:
    """The normalised text in segments, each of them blanks and then other characters."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return [MARK + part for part in parts]
    made, marks = [], MARK
    for part in parts:
        if part:
            made.append(marks + part)
            marks = MARK
        else:
            marks += MARK
    if len(marks) > 1:
        made.append(marks[:-1])
    return made
