"""Words and pairs of words of many texts, as numbers in packed arrays.

Texts are dealt into chunks of bounded size in the order they come.  A chunk numbers its words and
sends each once to a bucket of words, which numbers and counts those of all chunks; then it sends
each of its pairs once, as two numbers in 64 bits, to a bucket of pairs, which counts them.  A bucket
answers every chunk in the order of what the chunk sent, so an answer needs no keys.  Rows are one
per chunk and bucket.  A word that a third of all words are, is one entry per chunk like any other.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle

from quern.functions.slices import slices

# Bytes of text in a chunk, and of all texts for each bucket.
CHUNK_BYTES = 8 << 20
WORD_BYTES = 32 << 20
PAIR_BYTES = 8 << 20
# The word before the first one of a text.
START = ""
# What a word or pair bucket counts for all chunks stands beside its answers.
CODED = "chunk long, codes binary, bucket int, words binary"
NUMBERED = "chunk long, bucket int, place binary, seen binary, total binary, n long, known long"
COUNTED = ("chunk long, bucket int, seen binary, word_bucket int, stats binary, "
           "kinds long, once long, twice long")
STATS = "chunk long, bucket int, followers binary, precursors binary"

_U = np.uint64
_HALF = _U(32)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with the first bytes of all entries first, then the second ones and so on, compressed:
    most entries are small.  Shuffles would compress them as they are, to twice that size."""
    raw = b"".join(
        part for array in arrays for part in (
            np.uint64(array.nbytes).tobytes(), array.view(np.uint8).reshape(-1, array.itemsize).T.tobytes()))
    return np.uint64(len(raw)).tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(packed: bytes, *kinds: str) -> list[np.ndarray]:
    size = int.from_bytes(packed[:8], "little")
    raw = pa.Codec("zstd").decompress(memoryview(packed)[8:], size, asbytes=True)
    arrays, at = [], 0
    for kind in map(np.dtype, kinds):
        size = int.from_bytes(raw[at:at + 8], "little")
        planes = np.frombuffer(raw, np.uint8, size, at + 8).reshape(kind.itemsize, -1)
        arrays.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += 8 + size
    return arrays


def _steps(ascending: np.ndarray) -> np.ndarray:
    """From each entry to the next, from 0 on; ``np.cumsum`` turns it back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _unpacked(column: Sequence[bytes], kind: str) -> np.ndarray:
    return _joined([unpack(packed, kind)[0] for packed in column], kind)


def _joined(parts: Sequence[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    changed = np.zeros(len(keys[0]), bool)
    changed[0] = True
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changed)


def _runs(heads: np.ndarray, size: int) -> np.ndarray:
    return np.diff(np.append(heads, size))


def _sections(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    heads = _heads(buckets)
    for head, size in zip(heads.tolist(), _runs(heads, len(buckets)).tolist(), strict=True):
        yield int(buckets[head]), slice(head, head + size)


def _by_bucket(buckets: np.ndarray) -> np.ndarray:
    """A stable order by bucket; in 16 bits, if they are enough, it is a radix sort."""
    if len(buckets) and buckets.max() < 1 << 16:
        buckets = buckets.astype(np.uint16)
    return np.argsort(buckets, kind="stable")


def _table(schema: pa.Schema, rows: Sequence[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _columns(table: pa.Table, order: Sequence[str], *names: str) -> list[tuple]:
    """Rows of the named columns, sorted by those of ``order``."""
    rows = zip(*(table.column(name).to_pylist() for name in (*order, *names)), strict=True)
    chosen = sorted(rows, key=lambda row: row[:len(order)])
    return list(zip(*chosen, strict=True)) or [()] * (len(order) + len(names))


# ---------------------------------------------------------------- chunks


class Chunk:
    """Texts whose words are numbered as they come, after ``START``."""

    def __init__(self):
        self.ids = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[START]
        self.keys, self.codes, self.sizes, self.flags, self.bytes = [], [], [], [], 0

    def add(self, text: bytes | None, scored: bool, fitted: bool) -> None:
        words = (text or b"").decode("utf-8", "replace").split()
        self.codes.append(np.fromiter(map(self.ids.__getitem__, words), np.uint32, len(words)))
        self.sizes.append(len(words))
        self.flags.append(scored + 2 * fitted)
        self.bytes += len(text or b"")

    def rows(self, chunk: int, buckets: int, schema: pa.Schema) -> pa.RecordBatch:
        raw = [word.encode() for word in self.ids]
        bucket = np.fromiter(map(crc32, raw), np.uint32, len(raw)) % np.uint32(buckets)
        texts = Texts(
            np.array(self.sizes, np.uint32), np.array(self.flags, np.uint8), _joined(self.codes, "u4"), bucket)
        fitted = texts.fitted()
        seen = np.bincount(texts.codes[fitted], minlength=len(raw)).astype(np.uint32)
        total = np.bincount(texts.before()[fitted], minlength=len(raw)).astype(np.uint32)
        sizes, order, made = np.fromiter(map(len, raw), np.uint32, len(raw)), _by_bucket(bucket), []
        for number, part in _sections(bucket[order]):
            own = order[part]
            words = np.frombuffer(b"".join([raw[i] for i in own.tolist()]), np.uint8)
            made.append((number, pack(sizes[own], words, seen[own], total[own])))
        keys, kind, none = pa.concat_arrays(self.keys), schema.field("keys").type, [None] * len(made)
        held = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys).cast(kind)
        return pa.RecordBatch.from_arrays([
            pa.array([chunk] * (1 + len(made)), pa.int64()),
            pa.array([texts.packed(), *none], pa.binary()),
            pa.array([None, *(number for number, _ in made)], pa.int32()),
            pa.array([None, *(words for _, words in made)], pa.binary()),
            pa.concat_arrays([held, pa.nulls(len(made), kind)]),
        ], schema=schema)


class Texts:
    """The words of a chunk's texts, one after another, as the chunk's numbers; the buckets of words."""

    def __init__(self, sizes: np.ndarray, flags: np.ndarray, codes: np.ndarray, buckets: np.ndarray):
        self.sizes, self.flags, self.codes, self.buckets = sizes, flags, codes, buckets

    @classmethod
    def of(cls, docs: pa.Table) -> Texts:
        return cls(*unpack(docs.column("codes")[0].as_py(), "<u4", "u1", "<u4", "<u4"))

    def packed(self) -> bytes:
        return pack(self.sizes, self.flags, self.codes, self.buckets)

    def by_word(self, told: Sequence[bytes], kind: str) -> np.ndarray:
        """The buckets' answers, in the order of buckets, as one entry per word."""
        made = np.empty(len(self.buckets), kind)
        made[_by_bucket(self.buckets)] = _unpacked(told, kind)
        return made

    def fitted(self) -> np.ndarray:
        """Which words are of texts of the corpus."""
        return np.repeat(self.flags >= 2, self.sizes)

    def before(self) -> np.ndarray:
        """The word before each."""
        prev = np.empty_like(self.codes)
        prev[1:] = self.codes[:-1]
        prev[(np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[self.sizes > 0]] = 0
        return prev

    def summed(self, cost: np.ndarray, known: bool, keys: pa.Array, schema: pa.Schema) -> pa.Table:
        """(key, cost, n, unknown) of the texts that are asked for, from the cost of each word."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        costs = np.bincount(owner, weights=cost, minlength=len(self.sizes))
        asked = np.flatnonzero(self.flags & 1)
        n = self.sizes[asked].astype(np.int64)
        return pa.table([
            keys.take(pa.array(asked)), pa.array(costs[asked]), pa.array(n),
            pa.array(np.zeros_like(n) if known else n),
        ], schema=schema)


def coded(batches: Iterator[pa.RecordBatch], buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunks of rows (key, text as bytes, scored, fitted)."""
    first, number, chunk = TaskContext.get().partitionId() << 32, 0, Chunk()
    for batch in batches:
        for keys, texts, scored, fitted in slices(*batch.columns):
            at = 0
            for i, row in enumerate(zip(*(x.to_pylist() for x in (texts, scored, fitted)), strict=True)):
                chunk.add(*row)
                if chunk.bytes >= CHUNK_BYTES:
                    chunk.keys.append(keys.slice(at, i + 1 - at))
                    yield chunk.rows(first + number, buckets, schema)
                    at, number, chunk = i + 1, number + 1, Chunk()
            if at < len(keys):
                chunk.keys.append(keys.slice(at))
    if chunk.keys:
        yield chunk.rows(first + number, buckets, schema)


# ---------------------------------------------------------------- words


def numbered(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Each chunk's words of a bucket: their places among the bucket's, how often they are seen in the
    corpus, and how often as the word before."""
    chunks, packed = _columns(table, ["chunk"], "words")
    parts = [unpack(words, "<u4", "u1", "<u4", "<u4") for words in packed]
    sizes, data, seen, total = (np.concatenate(column) for column in zip(*parts, strict=True))
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    place = words.dictionary_encode().indices.to_numpy().astype(np.uint32)
    seen, total = (np.bincount(place, weights=n).astype(np.int64) for n in (seen, total))
    bucket, at = table.column("bucket")[0].as_py(), 0
    rows = [{"n": int(seen.sum()), "known": int((seen > 0).sum())}]
    for chunk, part in zip(chunks, parts, strict=True):
        own = place[at:at + len(part[0])]
        at += len(own)
        rows.append({"chunk": chunk, "bucket": bucket, "place": pack(own), "seen": pack(seen[own]),
                     "total": pack(total[own])})
    return _table(schema, rows)


def word_costs(docs: pa.Table, answers: pa.Table, mass: int, schema: pa.Schema) -> pa.Table:
    """Costs of texts under add-one smoothed counts of words."""
    if not docs.num_rows:
        return schema.empty_table()
    texts = Texts.of(docs)
    seen = texts.by_word(_columns(answers, ["bucket"], "seen")[1], "<i8")
    cost = -np.log((seen + 1) / mass) if mass else np.zeros(len(seen))
    return texts.summed(cost[texts.codes], mass > 0, docs.column("keys")[0].values, schema)


# ---------------------------------------------------------------- pairs


class Pairs:
    """The distinct pairs of a chunk, as their words' numbers among all, in 32 bits each."""

    def __init__(self, docs: pa.Table, places: Sequence[bytes], word_buckets: int):
        self.texts = Texts.of(docs)
        self.prev = self.texts.before()
        number = self.texts.by_word(places, "<u4").astype(_U) * _U(word_buckets) + self.texts.buckets
        if number.max() >> _HALF:
            raise OverflowError("more than 32 bits of words")
        codes = (number[self.prev] << _HALF) | number[self.texts.codes]
        self.order = np.argsort(codes)
        codes = codes[self.order]
        self.heads = _heads(codes)
        self.codes = codes[self.heads]

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        mixed = (self.codes ^ (self.codes >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        bucket = (mixed >> _HALF) % _U(buckets)
        order = _by_bucket(bucket)
        return order, bucket[order].astype(np.int64)


def sent_pairs(
    docs: pa.Table, answers: pa.Table, word_buckets: int, buckets: int, schema: pa.Schema
) -> pa.Table:
    """A chunk's pairs by bucket, with how often texts of the corpus have them."""
    if not docs.num_rows:
        return schema.empty_table()
    pairs = Pairs(docs, _columns(answers, ["bucket"], "place")[1], word_buckets)
    if not len(pairs.codes):
        return schema.empty_table()
    fitted = pairs.texts.fitted()[pairs.order]
    seen = np.add.reduceat(fitted, pairs.heads, dtype=np.uint32)
    order, bucket = pairs.by_bucket(buckets)
    codes, seen, chunk = pairs.codes[order], seen[order], docs.column("chunk")[0].as_py()
    return _table(schema, [
        {"chunk": chunk, "bucket": number, "pairs": pack(_steps(codes[part]), seen[part])}
        for number, part in _sections(bucket)])


def counted_pairs(table: pa.Table, word_buckets: int, schema: pa.Schema) -> pa.Table:
    """For each chunk how often the corpus has its pairs of a bucket; for the buckets of words how many
    kinds of pairs their words begin and end."""
    chunks, packed = _columns(table, ["chunk"], "pairs")
    parts = [unpack(pairs, "<u8", "<u4") for pairs in packed]
    codes = np.concatenate([np.cumsum(steps) for steps, _ in parts])
    seen = np.concatenate([seen for _, seen in parts])
    order = np.argsort(codes)
    codes = codes[order]
    heads = _heads(codes)
    count = np.add.reduceat(seen[order], heads, dtype=np.int64)
    told = np.empty(len(codes), np.int64)
    told[order] = np.repeat(count, _runs(heads, len(codes)))
    known = codes[heads][count > 0]
    rows = [{"kinds": len(known), "once": int((count == 1).sum()), "twice": int((count == 2).sum())}]
    bucket, at = table.column("bucket")[0].as_py(), 0
    for chunk, part in zip(chunks, parts, strict=True):
        rows.append({"chunk": chunk, "bucket": bucket, "seen": pack(told[at:at + len(part[0])])})
        at += len(part[0])
    begun, ended = (_kinds(words, word_buckets) for words in (known >> _HALF, np.sort(known & _U(0xFFFFFFFF))))
    for number in sorted(begun.keys() | ended.keys()):
        none = (np.zeros(0, np.uint32),) * 2
        rows.append({"word_bucket": number, "stats": pack(*begun.get(number, none), *ended.get(number, none))})
    return _table(schema, rows)


def _kinds(words: np.ndarray, word_buckets: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By bucket the places of the sorted words, and how often they come."""
    heads = _heads(words)
    n, words = _runs(heads, len(words)).astype(np.uint32), words[heads]
    bucket = words % _U(word_buckets)
    order = _by_bucket(bucket)
    place, n = (words // _U(word_buckets)).astype(np.uint32)[order], n[order]
    return {number: (_steps(place[part]), n[part]) for number, part in _sections(bucket[order])}


def told_stats(words: pa.Table, stats: pa.Table, schema: pa.Schema) -> pa.Table:
    """For each chunk's words of a bucket how many words follow and precede them."""
    buckets, chunks, places = _columns(words, ["bucket", "chunk"], "place")
    places = [unpack(place, "<u4")[0] for place in places]
    size = max((int(place.max()) + 1 for place in places if len(place)), default=0)
    parts = [unpack(packed, *["<u4"] * 4) for packed in stats.column("stats").to_pylist()]

    def summed(at: int) -> np.ndarray:
        where = _joined([np.cumsum(part[at], dtype=np.uint32) for part in parts], "u4")
        n = _joined([part[at + 1] for part in parts], "u4")
        return np.bincount(where, weights=n, minlength=size).astype(np.uint32)
    followers, precursors = summed(0), summed(2)
    return _table(schema, [
        {"chunk": chunk, "bucket": bucket, "followers": pack(followers[place]),
         "precursors": pack(precursors[place])}
        for bucket, chunk, place in zip(buckets, chunks, places, strict=True)])


def pair_costs(
    docs: pa.Table, answers: pa.Table, word_buckets: int, buckets: int, kinds: int, known: int,
    discount: float, schema: pa.Schema,
) -> pa.Table:
    """Costs of texts under interpolated Kneser-Ney: a seen pair gives up the discount, which the word
    before deals out by how many words a word has followed.  That in turn gives up the discount to all
    known words and one unknown one."""
    if not docs.num_rows:
        return schema.empty_table()
    told = {name: answers.filter(answers.column(name).is_valid()) for name in ("place", "seen", "followers")}
    _, places, total = _columns(told["place"], ["bucket"], "place", "total")
    pairs = Pairs(docs, places, word_buckets)
    texts, keys = pairs.texts, docs.column("keys")[0].values
    if not kinds or not len(pairs.codes):
        return texts.summed(np.zeros(len(texts.codes)), kinds > 0, keys, schema)
    total = texts.by_word(total, "<i8")
    _, *stats = _columns(told["followers"], ["bucket"], "followers", "precursors")
    followers, precursors = (texts.by_word(column, "<u4") for column in stats)
    _, seen = _columns(told["seen"], ["bucket"], "seen")
    count = np.empty(len(pairs.codes), np.int64)
    count[pairs.by_bucket(buckets)[0]] = _unpacked(seen, "<i8")

    first = pairs.order[pairs.heads]
    prev, token = pairs.prev[first], texts.codes[first]
    lower = ((np.maximum(precursors - discount, 0) + discount * known / (known + 1)) / kinds)[token]
    total = total[prev]
    higher = (np.maximum(count - discount, 0) + discount * followers[prev] * lower) / np.maximum(total, 1)
    kind_cost = -np.log(np.where(total > 0, higher, lower))
    cost = np.empty(len(texts.codes))
    cost[pairs.order] = np.repeat(kind_cost, _runs(pairs.heads, len(cost)))
    return texts.summed(cost, True, keys, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
