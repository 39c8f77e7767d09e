"""Packing of documents into sequences with little padding.

1. *Tokens.*  Every document becomes its ids and an end id, cut into full windows and one rest.
2. *Histogram.*  Only the number of pieces of each length (at most ``WINDOW`` bins) reaches the
   driver.
3. *Plan.*  Shallow combinations of one to three lengths that fill a window exactly are enumerated.
   How often each is used solves a non-negative least squares problem against the histogram; the
   counts are rounded down.  What is left is packed greedily: the largest length, then the largest
   that still fits, as often as the histogram allows, if that fills a window.  Lengths that no
   combination fills are laid end to end and cut at the windows' borders, so only the very last
   sequence is shorter than a window.
4. *Places.*  The plan says, per length, which ranks go where.  Ranks of a length are counted per
   task while tokens are made, and shifted by the counts of earlier tasks, so a length that a third
   of all documents share is never gathered.

Cases: NULL is the empty text, whose only id is the end id; texts are tokenised whole, also very
long ones; repeated rows are packed each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from quern.llm.common import LONG_KEY, tokenizer_path
from quern.llm.token_counts import byte_alphabet
from quern.session import spool

WINDOW = 2048
END_ID = 1
ROUNDS = 150
# Bytes of text whose words are made distinct together, and pre-tokens of one merging call.
BLOCK_BYTES = 8 << 20
MERGED = 1000
# Marks that are a pre-token of their own after a word.
MARKS = tuple(".,;:!?")

_COMMON = re.compile("[\x21-\x7e\xa1-ɏ]*")
# Fixed value: the pre-token expression of the vocabulary, for lower-case text without white space.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


# ---------------------------------------------------------------- tokens


class Halves:
    """Keeps values in two dictionaries: when the newer one is full it replaces the older one, so what
    is in use stays.  Long keys are never kept."""

    def __init__(self, limit: int):
        self.half, self.new, self.old = limit // 2, {}, {}

    def known(self, keys: list[str]) -> list[bytes | None]:
        found = list(map(self.new.get, keys))
        if self.old:
            for i, value in enumerate(found):
                if value is None and (value := self.old.get(keys[i])) is not None:
                    found[i] = value
                    self.keep(keys[i], value)
        return found

    def keep(self, key: str, value: bytes) -> None:
        if len(key) <= LONG_KEY:
            if len(self.new) >= self.half:
                self.old, self.new = self.new, {}
            self.new[key] = value


class WordTokens:
    """Ids of a vocabulary that drops white space.

    Words between blanks and line ends are independent.  Those of a block of texts are made distinct
    in Arrow; what is not known yet is cut into pre-tokens (words of common Latin letters; others go
    to the library whole), and all missing pre-tokens are merged in a few calls.  What a block
    holds once is not kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = byte_alphabet()
        self.line_end = self.alphabet[ord("\n")]
        self.merger = Tokenizer(self.tokenizer.model)  # takes pre-tokens in the visible alphabet
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.pre_tokens = Halves(350_000), Halves(350_000)

    def whole_ids(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merged(self, pre_tokens: list[str]) -> list[bytes]:
        """Ids of each pre-token; its last id is the only one that ends a word."""
        made: list[bytes] = []
        for start in range(0, len(pre_tokens), MERGED):
            part = "\n".join(pre_tokens[start:start + MERGED]).encode().decode("latin-1")
            part = part.translate(self.alphabet).split(self.line_end)
            encoded = self.merger.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4")
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            made += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return made

    def word_ids(self, words: list[str], counts: list[int]) -> list[bytes]:
        """Ids of distinct words, which occur so often in the block."""
        table = self.words.known(words)
        missing = [i for i, ids in enumerate(table) if ids is None]
        single: list[tuple[int, str]] = []
        several: list[tuple[int, list[str]]] = []
        for i in missing:
            word = words[i]
            if word.isascii() and word.isalpha():
                single.append((i, word.lower()))
            elif not _COMMON.fullmatch(word):
                table[i] = self.whole_ids(word)
            elif word.isalpha():
                single.append((i, word.lower()))
            elif word[-1:] in MARKS and word[:-1].isalpha():
                several.append((i, [word[:-1].lower(), word[-1]]))
            else:
                several.append((i, _PRE_TOKEN.findall(word.lower())))
        uses = Counter(chain(
            map(itemgetter(1), single), chain.from_iterable(map(itemgetter(1), several))))
        for i, name in single:
            uses[name] += counts[i] - 1
        names = list(uses)
        made = self.pre_tokens.known(names)
        new = [i for i, ids in enumerate(made) if ids is None]
        for i, ids in zip(new, self.merged([names[i] for i in new]), strict=True):
            made[i] = ids
            if uses[names[i]] > 1:
                self.pre_tokens.keep(names[i], ids)
        known = dict(zip(names, made, strict=True))
        for i, name in single:
            table[i] = known[name]
        for i, parts in several:
            table[i] = b"".join([known[part] for part in parts])
        for i in missing:
            if counts[i] > 1:
                self.words.keep(words[i], table[i])
        return table

    def block_ids(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a block of bounded size; the texts are not NULL."""
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), pa.scalar("", texts.type), texts)
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        words = coded.dictionary.to_pylist()
        table = self.word_ids(words, np.bincount(index, minlength=len(words)).tolist())
        sizes = np.array([len(ids) for ids in table], np.int64) // 4
        length = sizes[index]
        ends = np.cumsum(length)
        ids = np.frombuffer(b"".join(table), "<u4")
        begin = (np.cumsum(sizes) - sizes)[index]
        ids = ids[np.repeat(begin - ends + length, length) + np.arange(length.sum())].tobytes()
        edge = (np.r_[0, ends][split.offsets.to_numpy()] * 4).tolist()
        return [
            self.whole_ids(texts[row].as_py()) if special[row] else ids[a:b]
            for row, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))
        ]

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, NULL being the empty one, in blocks of bounded size."""
        texts = texts.fill_null("")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(texts):
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + BLOCK_BYTES, side="right")))
            yield from self.block_ids(texts.slice(start, stop - start))
            start = stop


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def token_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, window: int) -> DataFrame:
    """Pieces of all documents: full windows and a rest.

    ``part`` and ``place`` name a piece among those of its length: the task, and its place there.
    Rests keep their ids, since some are cut later.
    """
    end = packed([END_ID])

    def run(batches):
        tokens = word_tokens(path)
        part, counts = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            owners = []
            for row, ids in enumerate(tokens.ids(batch.column(1))):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start:4 * (start + window)]
                    length = len(piece) // 4
                    rows.append((
                        start, length, zlib.crc32(piece), total, part, counts[length],
                        piece if length < window else None,
                    ))
                    counts[length] += 1
                    owners.append(row)
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), *arrays], names=schema.names
            )

    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
    chosen = docs.select(F.col(id_col), F.col(text_col))
    schema = T.StructType([chosen.schema[id_col]])
    for name, kind in (("start", "long"), ("length", "long"), ("ids_crc32", "long"),
                       ("doc_tokens", "long"), ("part", "integer"), ("place", "long"), ("ids", "binary")):
        schema = schema.add(name, kind)
    return chosen.mapInArrow(run, schema)


# ---------------------------------------------------------------- the plan


def combinations_of(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to three lengths, zero-padded, that fill a window exactly: for a window of 2048
    at most 350,000, whatever the corpus."""
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    rows = [(window, 0, 0)] if has[window] else []
    rows += [(a, window - a, 0) for a in lengths if 2 * a <= window and has[window - a]]
    for a in lengths:
        if 3 * a > window:
            break
        second = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        second = second[has[window - a - second]]
        rows += [(a, b, window - a - b) for b in second]
    return np.array(rows, np.int64).reshape(-1, 3)


def solve_counts(combos: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares of ``sum(x * combo) = counts`` by accelerated projected gradients."""
    used = (combos > 0).astype(float)

    def spread(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(counts))
        for j in range(combos.shape[1]):
            total += np.bincount(combos[:, j], x * used[:, j], len(counts))
        return total

    def gather(r: np.ndarray) -> np.ndarray:
        return (r[combos] * used).sum(axis=1)

    probe = np.ones(len(combos))
    for _ in range(12):  # the largest eigenvalue bounds the step
        probe = gather(spread(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 1.0 / (1.05 * norm)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * gather(spread(y) - counts), 0.0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


class Plan:
    """Where the ranks of each length go: parallel lists of stretches of ranks.

    A stretch (length, first rank) either gives each rank its own sequence at one offset, or lays
    the pieces end to end from a place in the stream of rests.
    """

    def __init__(self, histogram: dict[int, int], window: int):
        self.window = window
        self.left = np.zeros(window + 1, np.int64)
        for length, count in histogram.items():
            self.left[length] = count
        self.taken = np.zeros(window + 1, np.int64)
        self.rows: list[tuple[int, int, bool, int, int]] = []
        self.sequences = 0
        self.fill()
        self.lay_out()

    def use(self, combo: list[int], times: int) -> None:
        """``times`` sequences that hold one piece of each length of the combination."""
        offset = 0
        for length in combo:
            self.rows.append((length, int(self.taken[length]), False, self.sequences, offset))
            self.taken[length] += times
            self.left[length] -= times
            offset += length
        self.sequences += times

    def most(self, combo: list[int], wanted: int) -> int:
        need = Counter(combo)
        return min([wanted, *(int(self.left[length]) // n for length, n in need.items())])

    def fill(self) -> None:
        lengths = np.flatnonzero(self.left)
        combos = combinations_of(lengths, self.window)
        if len(combos):
            x = solve_counts(combos, self.left.astype(float))
            for i in np.argsort(-x, kind="stable"):
                if x[i] < 1:
                    break
                combo = [int(length) for length in combos[i] if length]
                times = self.most(combo, int(x[i]))
                if times:
                    self.use(combo, times)
        for length in np.flatnonzero(self.left)[::-1].tolist():
            while self.left[length]:
                combo, room = [length], self.window - length
                need = Counter(combo)
                while room:
                    fits = [s for s in np.flatnonzero(self.left[:room + 1])[::-1] if self.left[s] > need[s]]
                    if not fits:
                        break
                    combo.append(int(fits[0]))
                    need[int(fits[0])] += 1
                    room -= int(fits[0])
                if room:
                    break
                self.use(combo, self.most(combo, int(self.left[length])))

    def lay_out(self) -> None:
        at = 0
        for length in np.flatnonzero(self.left).tolist():
            self.rows.append((length, int(self.taken[length]), True, self.sequences, at))
            at += length * int(self.left[length])
        self.left[:] = 0

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Sorted keys (length, first rank) and, in their order, first rank, kind, base, offset."""
        rows = sorted(self.rows)
        length, rank, stream, base, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        return length << 44 | rank, rank, stream.astype(bool), base, offset


# ---------------------------------------------------------------- places


def pack_documents(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", window: int = WINDOW,
    id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = spool(
        token_pieces(docs, path or tokenizer_path(vocabulary), id_col, text_col, window), "pieces"
    )
    per_task = spool(
        pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts"
    )
    sizes = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most window rows
    out = [F.col(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if not sizes:
        return pieces.select(
            *out[:5], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
        )
    plan = pieces.sparkSession.sparkContext.broadcast(
        Plan({row.length: row.n for row in sizes}, window).arrays()
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = spool(
        per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")),
        "piece-shifts",
    )

    def place(batches):
        keys, ranks, stream, base, offset = plan.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            far = offset[at] + (rank - ranks[at]) * length  # in the stream of rests
            sequence = base[at] + np.where(stream[at], far // window, rank - ranks[at])
            begin = np.where(stream[at], far % window, offset[at])
            fits = np.minimum(window - begin, length)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(begin), pa.array(fits)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset", "fits"],
            )

    ranked = pieces.drop("ids").join(shifts, ["length", "part"]).withColumn(
        "rank", F.col("place") + F.col("shift")).drop("shift")
    placed_schema = T.StructType(ranked.drop("rank").schema.fields).add("sequence_id", "long").add(
        "offset", "long").add("fits", "long")
    placed = spool(ranked.mapInArrow(place, placed_schema), "placed")
    whole = placed.filter("fits = length").select(*out)

    def cut(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                ids, first = row.pop("ids"), row.pop("fits")
                for a, b in ((0, first), (first, row["length"])):
                    rows.append(row | {
                        "start": row["start"] + a, "length": b - a,
                        "ids_crc32": zlib.crc32(ids[4 * a:4 * b]),
                        "sequence_id": row["sequence_id"] + (a > 0),
                        "offset": 0 if a else row["offset"],
                    })
            yield pa.RecordBatch.from_pylist(rows, schema=cut_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    cut_arrow = to_arrow_schema(whole.schema)
    split = placed.filter("fits < length").join(
        pieces.select("length", "part", "place", "ids").filter("ids is not null"),
        ["length", "part", "place"],
    ).select(*out, "fits", "ids").mapInArrow(cut, whole.schema)
    return whole.unionByName(split)
