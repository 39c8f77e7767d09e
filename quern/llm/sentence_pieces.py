"""SentencePiece encoding with the N best segmentations, and decoding.

The lattice of a segment has an edge for every piece of the vocabulary; an edge weighs the piece's
score, and a character without a piece is one edge of a low score that is spelled in byte pieces.
A forward Viterbi pass gives the best score from the start to each position.  These are exact
heuristics for a backward A* search from the end: it always extends the partial path whose best
completion scores most, so complete paths come out in order, best first, without search in vain.

A text falls apart into segments that no piece spans.  Its N best segmentations take the best of
almost every segment: each segment's loss to its second best is known, and only the N - 1 segments
with the smallest losses can take part in an alternative, so those alone are expanded further and
combined best-first.  Segments recur, so their searches are kept, up to a bound.

Scores of the public vocabulary are whole numbers, so sums are exact.  Among equal scores the order
is fixed by the lattice (later boundaries first), and the same in every run.

Cases: NULL gives NULL arrays, and in the digest what the empty text gives: one segmentation without pieces; texts with fewer
than N segmentations give all; very long texts and texts without blanks are searched whole; decoding
gives back the text (the visible blank mark itself, if a text holds it, comes back as a blank); repeated rows give
repeated rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quern.llm.common import LONG_KEY, Memo, tokenizer_path
from quern.llm.pieces import MARK, PieceFinder, Vocabulary, segments_of, vocabulary

N_BEST = 8
MEMO = 400_000


def _best_paths(words: Vocabulary, segment: str) -> Iterator[tuple[float, list[int]]]:
    """The segmentations of a segment, best first."""
    size, scores = len(segment), words.scores
    best = [0.0] + [float("-inf")] * size
    arriving: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
    for start, edges in enumerate(words.edges(segment)):
        so_far = best[start]
        for end, piece in edges:
            weight = scores[piece] if piece >= 0 else words.unknown_score
            arriving[end].append((start, piece, weight))
            if so_far + weight > best[end]:
                best[end] = so_far + weight
    # A state: (minus the best total through it, position, order, score behind it, path behind it).
    queue: list = [(-best[size], size, 0, 0.0, None)]
    pushed = 0
    while queue:
        total, at, _, behind, path = heapq.heappop(queue)
        if at == 0:
            yield -total, _ids_of(words, segment, path)
            continue
        for start, piece, weight in arriving[at]:
            pushed += 1
            heapq.heappush(queue, (
                -(best[start] + weight + behind), start, pushed, weight + behind,
                (piece, start, path),
            ))


def _ids_of(words: Vocabulary, segment: str, path) -> list[int]:
    ids: list[int] = []
    while path is not None:
        piece, start, path = path
        if piece >= 0:
            ids.append(piece)
        else:
            ids += words.unknown_ids(segment[start])
    return ids


def _best_and_loss(words: Vocabulary, segment: str) -> tuple[float, bytes, float]:
    """Score and packed ids of the best path, and the loss of the second best.

    The forward pass keeps the two best scores of each position, and prefers the smaller start as
    the search does.
    """
    size, find, scores = len(segment), words.beginnings.get, words.scores
    nothing = float("-inf")
    best, second = [0.0] + [nothing] * size, [nothing] * (size + 1)
    back: list = [None] * (size + 1)
    for start in range(size):
        one, two, alone = best[start], second[start], True
        for end in range(start + 1, size + 1):
            piece = find(segment[start:end])
            if piece is None:
                break
            if piece < 0:
                continue
            if end == start + 1:
                alone = False
            total = one + scores[piece]
            if total > best[end]:
                other = two + scores[piece]
                second[end] = best[end] if best[end] > other else other
                best[end], back[end] = total, (start, piece)
            elif total > second[end]:
                second[end] = total
        if alone:
            end, total = start + 1, one + words.unknown_score
            if total > best[end]:
                second[end] = max(best[end], two + words.unknown_score)
                best[end], back[end] = total, (start, -1)
            elif total > second[end]:
                second[end] = total
    path, at = [], size
    while at:
        at, piece = back[at]
        path.append(words.unknown_ids(segment[at]) if piece < 0 else [piece])
    found = [i for part in reversed(path) for i in part]
    return best[size], np.array(found, "<i4").tobytes(), best[size] - second[size]


def _best_and_losses(
    words: Vocabulary, finder: PieceFinder, strings: list[str]
) -> list[tuple[float, bytes, float]]:
    """``_best_and_loss`` of many strings of one length, which advance together."""
    codes, found = finder.find(strings)
    count, size = codes.shape
    nothing = float("-inf")
    # Two more ids: no piece, and a character that is spelled in bytes.
    scores = np.array([*words.scores, nothing, words.unknown_score])
    strange = found[1] == finder.none
    found[1][strange] = finder.none + 1
    best, second = np.full((size + 1, count), nothing), np.full((size + 1, count), nothing)
    piece, step = np.zeros((size + 1, count), np.int32), np.zeros((size + 1, count), np.int32)
    best[0] = 0.0
    for end in range(1, size + 1):
        one, two = best[end], second[end]
        for length in range(min(end, finder.longest), 0, -1):  # smaller starts first
            ids = found[length][:, end - length] if length in found else None
            if ids is None or (ids == finder.none).all():
                continue
            total = best[end - length] + scores[ids]
            other = second[end - length] + scores[ids]
            better = total > one
            two[:] = np.where(better, np.maximum(one, other), np.maximum(two, total))
            one[better] = total[better]
            piece[end, better], step[end, better] = ids[better], length
    row, at = np.arange(count), np.full(count, size)
    ids, used = np.zeros((count, size), "<i4"), np.zeros(count, np.int64)
    while (at > 0).any():
        going = at > 0
        used[going] += 1
        ids[row[going], size - used[going]] = piece[at[going], row[going]]
        at = at - np.where(going, step[at, row], 0)
    packed = [ids[i, size - n:].tobytes() for i, n in enumerate(used.tolist())]
    for i in np.flatnonzero(strange.any(axis=1)).tolist():
        packed[i] = _best_and_loss(words, strings[i])[1]
    return list(zip(best[size].tolist(), packed, (best[size] - second[size]).tolist(), strict=True))


class Encoder:
    def __init__(self, path: str):
        self.words = vocabulary(path)
        self.finder = PieceFinder(self.words)
        self.searches: dict[int, Memo] = {}
        self.written = self.words.written.tolist()
        self.forget()

    def search(self, n: int) -> Memo:
        """The n best (score, packed ids) of a segment.  Each path is checked to spell it."""
        def best(segment: str) -> list[tuple[float, bytes]]:
            made, plain = [], segment.replace(MARK, " ").encode()
            for score, ids in islice(_best_paths(self.words, segment), n):
                if b"".join(map(self.written.__getitem__, ids)) != plain:
                    raise ValueError("a path does not spell its segment")
                made.append((score, np.array(ids, "<i4").tobytes()))
            return made
        return self.searches.setdefault(n, Memo(best, 60_000))

    def forget(self) -> None:
        self.atoms: dict[str, tuple[float, bytes, float]] = {}
        self.firsts: dict[str, tuple[float, bytes, float]] = {}

    def learn(self, segments: set[str]) -> None:
        """Puts the best paths of new segments into the memo.  Nothing spans two atoms of a
        segment, so its best path joins theirs."""
        if len(self.firsts) > MEMO:
            self.forget()
        cut = {segment: self.words.atoms(segment) for segment in segments if segment not in self.firsts}
        by_length: dict[int, list[str]] = {}
        for atom in {atom for atoms in cut.values() for atom in atoms if atom not in self.atoms}:
            by_length.setdefault(len(atom), []).append(atom)
        for size, strings in by_length.items():
            if size > LONG_KEY:
                self.atoms.update((atom, _best_and_loss(self.words, atom)) for atom in strings)
                continue
            for start in range(0, len(strings), 10_000):
                part = strings[start:start + 10_000]
                made = _best_and_losses(self.words, self.finder, part)
                self.atoms.update(zip(part, made, strict=True))
        for segment, atoms in cut.items():
            if len(atoms) == 1:
                self.firsts[segment] = self.atoms[atoms[0]]
            else:
                scores, ids, losses = zip(*map(self.atoms.__getitem__, atoms), strict=True)
                self.firsts[segment] = sum(scores), b"".join(ids), min(losses)

    def encode_all(self, texts: list[str], n: int = N_BEST) -> list[list[tuple[float, bytes]]]:
        """The ``n`` best (score, packed ids) of each text."""
        cut = [segments_of(text) for text in texts]
        segments = set().union(*cut)
        gc.disable()  # the memos hold no cycles, and looking for some takes a tenth of the time
        try:
            self.learn(segments)
            made = [self.encode_segments(found, n) for found in cut]
        finally:
            gc.enable()
        for segment in segments:
            if len(segment) > LONG_KEY:  # long strings are not kept
                self.firsts.pop(segment, None)
                for atom in self.words.atoms(segment):
                    self.atoms.pop(atom, None)
        return made

    def encode(self, text: str, n: int = N_BEST) -> list[tuple[float, bytes]]:
        return self.encode_all([text], n)[0]

    def encode_segments(self, segments: list[str], n: int) -> list[tuple[float, bytes]]:
        firsts = [self.firsts[segment] for segment in segments]
        total = sum([first[0] for first in firsts])
        parts = [first[1] for first in firsts]
        if n == 1 or not segments:
            return [(total, b"".join(parts))]
        losses = [first[2] for first in firsts]
        smallest = heapq.nsmallest(n - 1, range(len(segments)), key=losses.__getitem__)
        chosen = sorted(i for i in smallest if losses[i] != float("inf"))
        search = self.search(n)
        paths = [search[segments[i]] for i in chosen]
        made = []
        for loss, ranks in _combine([[p[0][0] - score for score, _ in p] for p in paths], n):
            for i, options, rank in zip(chosen, paths, ranks, strict=True):
                parts[i] = options[rank][1]
            made.append((total - loss, b"".join(parts)))
        return made


def _combine(losses: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` choices of one rank per list with the smallest sums of losses.

    Ranks are raised from left to right only, so each choice is met once.
    """
    queue = [(0.0, (0,) * len(losses), 0)]
    made = []
    while queue and len(made) < n:
        loss, choice, first = heapq.heappop(queue)
        made.append((loss, choice))
        for i in range(first, len(losses)):
            rank = choice[i] + 1
            if rank < len(losses[i]):
                more = loss + losses[i][rank] - losses[i][rank - 1]
                heapq.heappush(queue, (more, (*choice[:i], rank, *choice[i + 1:]), i))
    return made


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def decode(words: Vocabulary, ids: list[int]) -> str:
    """The text of a list of ids; runs of byte pieces are read as UTF-8."""
    parts: list[bytes] = []
    for i in ids:
        byte = words.byte_of.get(i)
        parts.append(words.pieces[i].replace(MARK, " ").encode() if byte is None else byte)
    return b"".join(parts).decode(errors="replace")[1:]


def encode_documents(
    docs: DataFrame, n: int = N_BEST, vocabulary_file: str = "piece_bpe_32k.model",
    id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
) -> DataFrame:
    """Per document: ``ids`` and ``scores`` of its n best segmentations, best first."""
    path = path or tokenizer_path(vocabulary_file)

    def rows(texts: list[str | None]) -> list[list]:
        made = encoder(path).encode_all([text or "" for text in texts], n)
        ids = [[np.frombuffer(ids, "<i4") for _, ids in paths] for paths in made]
        scores = [[score for score, _ in paths] for paths in made]
        return [
            [None if text is None else x for text, x in zip(texts, column, strict=True)]
            for column in (ids, scores)
        ]

    kinds = [pa.list_(pa.list_(pa.int32())), pa.list_(pa.float64())]
    return _per_document(docs, rows, ["ids", "scores"], kinds, id_col, text_col)


def decode_documents(
    coded: DataFrame, ids_col: str = "ids", id_col: str = "doc_id",
    vocabulary_file: str = "piece_bpe_32k.model", path: str | None = None,
) -> DataFrame:
    """(id, text) of lists of ids; NULL stays NULL."""
    path = path or tokenizer_path(vocabulary_file)

    def rows(lists: list[list[int] | None]) -> list[list]:
        words = vocabulary(path)
        return [[None if ids is None else decode(words, ids) for ids in lists]]

    return _per_document(coded, rows, ["text"], [pa.string()], id_col, ids_col)


def encoding_digest(
    docs: DataFrame, n: int = N_BEST, vocabulary_file: str = "piece_bpe_32k.model",
    id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
) -> DataFrame:
    """Per document: number and CRC-32 of the best ids, the n best scores, a CRC-32 of all n id
    lists, and whether the best ones decode to the text.  (Paths of the others are checked segment by
    segment when they are found.)"""
    path = path or tokenizer_path(vocabulary_file)

    def rows(texts: list[str | None]) -> list[list]:
        plain = [(text or "").replace(MARK, " ") for text in texts]
        words, made = encoder(path).words, encoder(path).encode_all(plain, n)
        return [
            [len(paths[0][1]) // 4 for paths in made],
            [zlib.crc32(paths[0][1]) for paths in made],
            [[score for score, _ in paths] for paths in made],
            [zlib.crc32(b"".join(ids for _, ids in paths)) for paths in made],
            [
                decode_packed(words, paths[0][1]) == text
                for text, paths in zip(plain, made, strict=True)
            ],
        ]

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.bool_()]
    names = ["n_pieces", "ids_crc32", "scores", "nbest_crc32", "round_trip"]
    return _per_document(docs, rows, names, kinds, id_col, text_col)


def decode_packed(words: Vocabulary, ids: bytes) -> str:
    found = words.written[np.frombuffer(ids, "<i4")]
    return b"".join(found.tolist()).decode(errors="replace")[1:]


def _per_document(df, rows, names, kinds, id_col, value_col) -> DataFrame:
    """``rows`` turns a list of values into one list per column."""
    from pyspark.sql.pandas.types import from_arrow_type

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                made = rows(part.column(1).to_pylist())
                arrays = [pa.array(c, k) for c, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[id_col, *names])

    chosen = df.select(F.col(id_col), F.col(value_col))
    schema = T.StructType([chosen.schema[id_col]])
    for name, kind in zip(names, kinds, strict=True):
        schema = schema.add(name, from_arrow_type(kind))
    return chosen.mapInArrow(run, schema)
