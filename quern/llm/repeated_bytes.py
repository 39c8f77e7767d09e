"""Removal of byte strings that occurred before, by prefix-free parsing.

A byte is removed if a string of ``LENGTH`` bytes covers it that also starts earlier: in a document with
a smaller id, or in the same document at a smaller place.

Prefix-free parsing.  A hash that rolls over every ``WORD`` bytes triggers a cut at one place in
``SPACING``; the phrases between cuts overlap by the triggering bytes, so no suffix of a phrase is the
beginning of another one.  Equal strings have equal triggers, wherever they lie.

1. *Contexts.*  A string whose first trigger stands in its first half holds the ``SIDE`` bytes from the
   trigger on; otherwise it holds the ``SIDE`` bytes up to the trigger's end.  Each batch of documents
   sends 32-bit hashes of these contexts; a bucket answers with those that occur twice, and how often.
2. *Phrases.*  For every trigger with a shared context, the strings whose first trigger it is make up
   one extended phrase.  Equal extended phrases meet in a bucket: all but the first repeat as a whole.
   Its first holder is done as well if its contexts occur no more often than it does.
3. *Corpus order.*  Strings of the other first holders may repeat in part.  A batch sorts them: the
   suffix array of the dictionary of phrases ranks the part up to the next trigger, the suffix array of
   the parse ranks what follows, and both ranks together give the order of the text suffixes.
   Neighbours are compared byte by byte; runs that agree in ``LENGTH`` bytes are one string, which the
   batch sends once, with its earliest place.  A bucket answers with those that start earlier elsewhere.
4. *Finish.*  A batch removes what the three steps named.

Strings without any trigger (runs of one character, or by chance) skip step 2 and are told apart in
step 3 by hash.  Across batches strings are equal if 64 bits of hash and the bucket, which stems from
further bits, agree.  Parcels are folded per batch first, so a passage in a third of all documents
sends one entry per batch; no group holds documents, and nothing but the sum of the sizes and the
number of very large ids passes through the driver.

Cases: NULL and empty texts have no bytes; texts below ``LENGTH`` bytes lose nothing; rows that share
an id are one document, whose strings start earlier only at a smaller place, and give a row each; a
NULL id counts as larger than all others; ids are integers; very long texts are processed whole; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.llm.batches import (
    BUCKET_BYTES, LAST_ID, PARCEL, above_least, copied, deal, ids_above, opened, pack, parcels, runs, sections,
)
from quern.llm.common import blocks_for

LENGTH = 100
WORD = 8
SPACING = 20
REACH = LENGTH - WORD  # a string holds the triggers from its start up to this place
HALF = REACH // 2
SIDE = HALF + WORD
CHUNK = 1 << 17

CONTEXT, PHRASE, STRING, OWN = range(4)
_U = np.uint64
_CUT = _U((1 << 64) // SPACING)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 on; equal keys share one."""
    order = np.argsort(keys, kind="stable")
    made = np.zeros(len(keys), np.int64)
    ordered = keys[order]
    made[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else 0
    return made


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of stretches, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _covered(start: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places a stretch [start, stop) covers."""
    steps = np.bincount(start, minlength=size + 1) - np.bincount(stop, minlength=size + 1)
    return np.cumsum(steps[:size]) > 0


class Batch:
    """The texts of a batch end to end, by id, then text, so a batch is the same each time."""

    def __init__(self, docs: pa.Table):
        ids = docs.column("id").combine_chunks()
        ids = ids.cast(pa.int64()).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
        texts = docs.column("text").cast(pa.large_binary()).combine_chunks().fill_null(b"")
        order = np.argsort(ids, kind="stable")
        if (np.diff(ids[order]) == 0).any():
            plain = texts.to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], plain[i])), np.int64)
        self.order, self.ids = order, ids[order]
        texts = texts.take(pa.array(order))
        self.sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.end = np.cumsum(self.sizes)
        self.begin = self.end - self.sizes
        self.n = int(self.sizes.sum())
        self.bytes = np.zeros(self.n + LENGTH + 2 * WORD, np.uint8)
        if self.n:
            first = np.frombuffer(texts.buffers()[1], "<i8", 1, 8 * texts.offset)[0]
            self.bytes[:self.n] = np.frombuffer(texts.buffers()[2], np.uint8, self.n, int(first))
        self.eight = np.ndarray((self.n + LENGTH + WORD,), "<u8", self.bytes, 0, (1,))
        self.rank = np.cumsum(np.r_[True, self.ids[1:] != self.ids[:-1]]) if len(ids) else self.ids
        self.trigger = self._triggers()
        self.doc = self.doc_of(self.trigger)
        before = np.r_[-1, self.trigger[:-1]][:len(self.trigger)]
        before = np.maximum(before, self.begin[self.doc] - 1)
        # Strings [first, last] are those whose first trigger this one is; by the place of the
        # trigger in them, they hold its right or its left context.
        self.first = np.maximum(before + 1, self.trigger - REACH)
        self.last = np.minimum(self.trigger, self.end[self.doc] - LENGTH)
        some = self.last >= self.first
        self.right = some & (self.last >= self.trigger - HALF)
        self.context = self.trigger + SIDE <= self.end[self.doc]
        self.left = some & (self.first <= self.trigger - HALF)

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, place, side="right")

    def _triggers(self) -> np.ndarray:
        found = [
            start + np.flatnonzero(
                self.eight[start:min(start + CHUNK, self.n)] * _U(0x9E3779B97F4A7C15) < _CUT)
            for start in range(0, self.n, CHUNK)
        ]
        place = np.concatenate(found) if found else np.zeros(0, np.int64)
        return place[place + WORD <= self.end[self.doc_of(place)]]

    def hash(self, place: np.ndarray, size: int, salt: int) -> np.ndarray:
        value = np.full(len(place), salt, _U)
        for step in [*range(0, size - WORD, WORD), size - WORD]:
            value = (value ^ self.eight[place + step]) * _U(0x9FB21C651E98DF25)
            value ^= value >> _U(32)
        return _mix(value)

    def blind(self) -> np.ndarray:
        """Strings that hold no trigger."""
        start = np.union1d(self.begin[self.sizes > 0], self.trigger + 1)
        start = start[start < self.n]
        following = np.r_[self.trigger, self.n + LENGTH][np.searchsorted(self.trigger, start)]
        stop = np.minimum(following - REACH, self.end[self.doc_of(start)] - LENGTH + 1)
        return _places(start, np.maximum(stop - start, 0))

    def position(self, place: np.ndarray) -> np.ndarray:
        """Orders strings of the batch by id and start."""
        doc = self.doc_of(place)
        return self.rank[doc] << 40 | (place - self.begin[doc])

    def named(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = self.doc_of(place)
        return self.ids[doc], (place - self.begin[doc]).astype("<u4")


# ---------------------------------------------------------------- step 1: contexts


def _contexts(batch: Batch) -> tuple[np.ndarray, ...]:
    """Strings without a trigger, and 64-bit keys of right contexts, left ones and these strings."""
    blind = batch.blind()
    return (
        blind, batch.hash(batch.trigger[batch.context], SIDE, 1),
        batch.hash(batch.trigger[batch.left] - HALF, SIDE, 2), batch.hash(blind, LENGTH, 3),
    )


def _joined(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, key in the lower 32 bits."""
    return ((keys >> _U(32)) % _U(buckets)) << _U(32) | (keys & _U(0xFFFFFFFF))


def _probe(docs: pa.Table, buckets: int) -> pa.Table:
    batch = Batch(docs)
    keys = np.sort(_joined(np.concatenate(_contexts(batch)[1:]), buckets))
    heads = runs(keys)
    count = np.diff(np.r_[heads, len(keys)])
    keys, rows = keys[heads], []
    for bucket, part in sections((keys >> _U(32)).astype(np.int64)):
        key, n = keys[part].astype("<u4"), count[part].astype("<u4")
        rows.append((CONTEXT, bucket, docs.column("batch")[0].as_py(), pack([key[n == 1], key[n > 1], n[n > 1]])))
    return parcels(rows)


def _answer_contexts(table: pa.Table) -> pa.Table:
    """For each batch its contexts that occur at least twice, with their number."""
    held = opened(table, CONTEXT, ["<u4"] * 3)
    keys = [np.r_[one, more] for _, _, (one, more, _) in held]
    count = np.concatenate([np.r_[np.ones(len(one), np.int64), n] for _, _, (one, _, n) in held])
    owner = np.repeat(np.arange(len(held)), [len(k) for k in keys])
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    heads = runs(key[order])
    total = np.repeat(np.add.reduceat(count[order], heads), np.diff(np.r_[heads, len(key)]))
    shared = total > 1
    order, total = order[shared], np.minimum(total[shared], 0xFFFFFFFF)
    rows = []
    by_owner = np.argsort(owner[order], kind="stable")
    for place, part in sections(owner[order][by_owner]):
        chosen = by_owner[part]
        rows.append((CONTEXT, held[place][0], held[place][1],
                     pack([key[order[chosen]], total[chosen].astype("<u4")])))
    return parcels(rows)


# ---------------------------------------------------------------- step 2: phrases


def _extended(batch: Batch, chosen: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and hash of the extended phrases of the chosen triggers.  The strings at both ends
    overlap, so with the distance they fix all of it."""
    first, last = batch.first[chosen], batch.last[chosen]
    ends = [(batch.hash(first, LENGTH, salt), batch.hash(last, LENGTH, salt)) for salt in (4, 5)]
    one, two = (_mix(a * _U(3) + _mix(b) + (last - first).astype(_U)) for a, b in ends)
    return (two % _U(buckets)).astype(np.int64), one


def _folded(batch: Batch, place: np.ndarray, *keys: np.ndarray):
    """Order that sorts entries by keys and position, where runs begin, and their lengths."""
    order = np.lexsort((batch.position(place), *keys[::-1]))
    heads = runs(*(key[order] for key in keys))
    return order, heads, np.diff(np.r_[heads, len(order)])


def _phrases(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not docs.num_rows or not answers.num_rows:
        return parcels([])
    batch, name = Batch(docs), docs.column("batch")[0].as_py()
    known = opened(answers, CONTEXT, ["<u4", "<u4"])
    keys = np.concatenate([_U(b) << _U(32) | key.astype(_U) for b, _, (key, _) in known])
    total = np.concatenate([n for _, _, (_, n) in known]).astype(np.int64)
    order = np.argsort(keys)
    keys, total = keys[order], total[order]

    def occurs(context: np.ndarray) -> np.ndarray:
        wanted = _joined(context, buckets)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, total[at], 1)

    blind, right_keys, left_keys, blind_keys = _contexts(batch)
    most = np.zeros(len(batch.trigger), np.int64)
    most[batch.context] = occurs(right_keys)
    most[~batch.right] = 0  # the context lies in no string of its own
    most[batch.left] = np.maximum(most[batch.left], occurs(left_keys))
    chosen = np.flatnonzero(most > 1)
    rows = [(OWN, -1 - name, name, pack([chosen.astype("<u4"), blind[occurs(blind_keys) > 1].astype("<i8")]))]
    bucket, one = _extended(batch, chosen, buckets)
    order, heads, count = _folded(batch, batch.first[chosen], bucket, one)
    head = order[heads]
    ids, start = batch.named(batch.first[chosen[head]])
    for place, part in sections(bucket[head]):
        n = count[part]
        rows.append((PHRASE, place, name, pack([
            one[head[part]], *above_least(ids[part]), start[part], most[chosen[head[part]]].astype("<u4"),
            np.flatnonzero(n > 1).astype("<u4"), n[n > 1].astype("<u4"),
        ])))
    return parcels(rows)


def _own(table: pa.Table) -> list[tuple]:
    """Parcels that a batch sends to itself pass through the bucket step as they are."""
    rows = zip(*(table.column(n).to_pylist() for n in ("kind", "bucket", "batch", "packed")), strict=True)
    return [row for row in rows if row[0] == OWN]


DONE, OPEN = 1, 2


def _answer_phrases(table: pa.Table) -> pa.Table:
    """Per entry, in the order it was sent: repeats as a whole, may repeat in part, or neither."""
    rows = _own(table)
    held = opened(table, PHRASE, ["<u8", "<i8", "<u4", "<u8", "<u4", "<u4", "<u4", "<u4"])
    if not held:
        return parcels(rows)
    sizes = [len(arrays[0]) for _, _, arrays in held]
    one, start, most = (np.concatenate([arrays[i] for _, _, arrays in held]) for i in (0, 4, 5))
    ids = np.concatenate([ids_above(*arrays[1:4]) for _, _, arrays in held])
    count = np.ones(len(one), np.int64)
    for at, (_, _, arrays) in zip(np.cumsum([0, *sizes]), held):
        count[at + arrays[6].astype(np.int64)] = arrays[7]
    order = np.lexsort((start, ids, one))
    heads = runs(one[order])
    spread = np.diff(np.r_[heads, len(order)])
    total = np.repeat(np.add.reduceat(count[order], heads), spread)
    first = order[np.repeat(heads, spread)]
    later = (ids[order] > ids[first]) | (start[order] > start[first])
    verdict = np.zeros(len(one), np.uint8)
    verdict[order] = np.where(later, DONE, np.where(most[order] > total, OPEN, 0))
    for (bucket, batch, _), part in zip(held, np.split(verdict, np.cumsum(sizes)[:-1]), strict=True):
        rows.append((PHRASE, bucket, batch, pack([part])))
    return parcels(rows)


# ---------------------------------------------------------------- step 3: corpus order


class CorpusOrder:
    """The order of given strings among all text suffixes, from the parse of their surroundings."""

    def __init__(self, batch: Batch, place: np.ndarray):
        self.batch = batch
        filled = batch.begin[batch.sizes > 0]
        starts = np.union1d(filled, batch.trigger)
        doc = batch.doc_of(starts)
        last = np.r_[doc[1:] != doc[:-1], True][:len(starts)]
        stops = np.where(last, batch.end[doc], np.r_[starts[1:], 0][:len(starts)] + WORD)
        held = np.searchsorted(starts, place, side="right") - 1
        until = np.searchsorted(starts, place + LENGTH - 1, side="right") - 1
        needed = np.flatnonzero(_covered(held, until + 1, len(starts)))
        self.dictionary_ranks(starts[needed], stops[needed])
        depth = int((until - held).max(initial=0))
        follows = np.r_[(np.diff(needed) == 1) & ~last[needed[:-1]], False]
        parse = self.parse_ranks(follows, depth)
        at = np.searchsorted(needed, held)
        # Up to the next trigger the dictionary ranks a string, from there on the parse does.
        self.upto = self.rank[self.offset[at] + place - starts[held]]
        self.after = np.where(follows[at], parse[np.minimum(at + 1, len(parse) - 1)], 0)
        self.order = np.lexsort((self.after, self.upto))
        ordered = place[self.order]
        same = np.ones(max(len(place) - 1, 0), bool)
        for step in [*range(0, LENGTH - WORD, WORD), LENGTH - WORD]:
            same &= batch.eight[ordered[1:] + step] == batch.eight[ordered[:-1] + step]
        self.label = np.zeros(len(place), np.int64)
        self.label[self.order] = np.cumsum(np.r_[True, ~same])

    def dictionary_ranks(self, start: np.ndarray, stop: np.ndarray) -> None:
        """The suffix array of all distinct phrases, to the depth of a string, by doubling."""
        raw = memoryview(self.batch.bytes)
        known: dict[bytes, int] = {}
        size, offset = 0, []
        for a, b in zip(start.tolist(), stop.tolist(), strict=True):
            phrase = bytes(raw[a:b])
            if phrase not in known:
                known[phrase] = size
                size += b - a
            offset.append(known[phrase])
        self.offset = np.array(offset, np.int64)
        text = np.frombuffer(b"".join(known) + bytes(WORD), np.uint8)
        lengths = np.array([len(phrase) for phrase in known], np.int64)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(size)
        eight = np.ndarray((size,), ">u8", text, 0, (1,)).astype(_U)
        unused = (np.maximum(WORD - left, 0) * 8).astype(_U)
        rank = _dense(eight >> unused << unused)
        for step in (8, 16, 32, LENGTH - 64):
            ahead = np.zeros(size, np.int64)
            fits = np.flatnonzero(left > step)
            ahead[fits] = rank[fits + step]
            rank = _dense(rank << 32 | ahead)
        self.rank = rank

    def parse_ranks(self, follows: np.ndarray, depth: int) -> np.ndarray:
        """The suffix array of the parse, phrases in place of letters, by doubling."""
        rank = _dense(self.rank[self.offset])
        stretch = np.cumsum(np.r_[True, ~follows[:-1]])[:len(rank)]
        step = 1
        while step <= depth:
            ahead = np.zeros(len(rank), np.int64)
            fits = np.flatnonzero(stretch[:-step] == stretch[step:]) if step < len(rank) else []
            ahead[fits] = rank[np.asarray(fits, np.int64) + step]
            rank = _dense(rank << 32 | ahead)
            step *= 2
        return rank


def _string_hash(batch: Batch, place: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (batch.hash(place, LENGTH, 7) % _U(buckets)).astype(np.int64)
    return bucket, batch.hash(place, LENGTH, 6)


def _strings(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not docs.num_rows or not answers.num_rows:
        return parcels([])
    batch, name = Batch(docs), docs.column("batch")[0].as_py()
    ((_, _, (chosen, blind)),) = opened(answers, OWN, ["<u4", "<i8"])
    bucket, one = _extended(batch, chosen, buckets)
    order, heads, count = _folded(batch, batch.first[chosen], bucket, one)
    verdicts = [arrays[0] for _, _, arrays in opened(answers, PHRASE, ["u1"])]
    verdict = np.repeat(np.concatenate([np.zeros(0, np.uint8), *verdicts]), count)
    where = batch.position(batch.first[chosen])[order]
    later = where > np.repeat(where[heads], count)
    whole = chosen[order[later | (verdict == DONE)]]
    partly = chosen[order[~later & (verdict == OPEN)]]
    stretches = [(batch.first[whole], batch.last[whole] + LENGTH)]

    size = np.maximum(batch.last[partly] - batch.first[partly] + 1, 0)
    place = _places(batch.first[partly], size)
    # The last trigger whose right context lies in the string must have a shared context too.
    lacking = batch.right.copy()
    lacking[chosen] = False
    final = np.searchsorted(batch.trigger, place + HALF, side="right") - 1
    place = place[(final < 0) | (batch.trigger[final] < place) | ~lacking[final]]

    heads_of = []
    for strings, label in (
        (place, CorpusOrder(batch, place).label if len(place) else place),
        (blind, _dense(_mix(batch.hash(blind, LENGTH, 6)) ^ batch.hash(blind, LENGTH, 7))),
    ):
        order, heads, count = _folded(batch, strings, label)
        where = batch.position(strings)[order]
        later = where > np.repeat(where[heads], count)
        gone = strings[order[later]]
        stretches.append((gone, gone + LENGTH))
        heads_of.append(strings[order[heads]])
    head = np.concatenate(heads_of)
    bucket, one = _string_hash(batch, head, buckets)
    order = np.lexsort((one, bucket))
    bucket, one, head = bucket[order], one[order], head[order]
    ids, start = batch.named(head)
    rows = [
        (STRING, place, name, pack([one[part], *above_least(ids[part]), start[part]]))
        for place, part in sections(bucket)
    ]
    gone = _covered(*(np.concatenate(x) for x in zip(*stretches, strict=True)), batch.n)
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    rows.append((OWN, -1 - name, name, pack([edges[::2].astype("<i8"), edges[1::2].astype("<i8")])))
    return parcels(rows)


def _answer_strings(table: pa.Table) -> pa.Table:
    """For each batch the strings that start earlier elsewhere: hash, id and start."""
    rows = _own(table)
    held = opened(table, STRING, ["<u8", "<i8", "<u4", "<u8", "<u4"])
    if not held:
        return parcels(rows)
    sizes = [len(arrays[0]) for _, _, arrays in held]
    one, start = (np.concatenate([arrays[i] for _, _, arrays in held]) for i in (0, 4))
    ids = np.concatenate([ids_above(*arrays[1:4]) for _, _, arrays in held])
    order = np.lexsort((start, ids, one))
    heads = runs(one[order])
    first = order[np.repeat(heads, np.diff(np.r_[heads, len(order)]))]
    later = np.zeros(len(one), bool)
    later[order] = (ids[order] > ids[first]) | (start[order] > start[first])
    edges = np.cumsum([0, *sizes])
    for (bucket, batch, _), a, b in zip(held, edges[:-1], edges[1:], strict=True):
        part = a + np.flatnonzero(later[a:b])
        if len(part):
            rows.append((STRING, bucket, batch, pack([one[part], *above_least(ids[part]), start[part]])))
    return parcels(rows)


# ---------------------------------------------------------------- step 4: finish


def _removed(docs: pa.Table, answers: pa.Table) -> tuple[Batch, np.ndarray]:
    """The batch, and which of its bytes are removed."""
    batch = Batch(docs)
    starts, stops = [], []
    for _, _, (a, b) in opened(answers, OWN, ["<i8", "<i8"]):
        starts.append(a)
        stops.append(b)
    for _, _, arrays in opened(answers, STRING, ["<u8", "<i8", "<u4", "<u8", "<u4"]):
        one, ids, start = arrays[0], ids_above(*arrays[1:4]), arrays[4].astype(np.int64)
        low = np.searchsorted(batch.ids, ids)
        rows = np.searchsorted(batch.ids, ids, side="right") - low
        doc = _places(low, rows)
        one, start = np.repeat(one, rows), np.repeat(start, rows)
        fits = start + LENGTH <= batch.sizes[doc]
        place = (batch.begin[doc] + start)[fits]
        # Of rows that share the id, those that hold the string there.
        place = place[batch.hash(place, LENGTH, 6) == one[fits]]
        starts.append(place)
        stops.append(place + LENGTH)
    if not starts:
        return batch, np.zeros(batch.n, bool)
    return batch, _covered(np.concatenate(starts), np.concatenate(stops), batch.n)


def _sums(flags: np.ndarray, batch: Batch) -> np.ndarray:
    before = np.r_[0, np.cumsum(flags)]
    return before[batch.end] - before[batch.begin]


def _kept(batch: Batch, gone: np.ndarray, removed: np.ndarray) -> list[bytes]:
    return [
        (batch.bytes[a:b][~gone[a:b]] if n else batch.bytes[a:b]).tobytes()
        for a, b, n in zip(batch.begin.tolist(), batch.end.tolist(), removed.tolist(), strict=True)
    ]


def _digest(docs: pa.Table, answers: pa.Table) -> dict[str, list]:
    batch, gone = _removed(docs, answers)
    rises = gone & ~np.r_[False, gone[:-1]][:batch.n]
    rises[batch.begin[batch.sizes > 0]] = gone[batch.begin[batch.sizes > 0]]
    removed = _sums(gone, batch)
    made = docs.take(pa.array(batch.order))
    return {
        "id": made.column("id"), "copies": made.column("copies"), "n_bytes": batch.sizes,
        "n_removed": removed, "n_spans": _sums(rises, batch),
        "kept_sha256": [hashlib.sha256(kept).hexdigest() for kept in _kept(batch, gone, removed)],
    }


def _cut(docs: pa.Table, answers: pa.Table) -> dict[str, list]:
    batch, gone = _removed(docs, answers)
    removed = _sums(gone, batch)
    made = docs.take(pa.array(batch.order))
    texts = [
        (None if text is None else text if not n else kept.decode(errors="ignore"))
        for text, kept, n in zip(
            made.column("text").to_pylist(), _kept(batch, gone, removed), removed.tolist(), strict=True)
    ]
    return {"row": made.column("row"), "copies": made.column("copies"), "kept": texts}


# ---------------------------------------------------------------- the plan


def _run(dealt: DataFrame, total: int, finish, schema: T.StructType) -> DataFrame:
    buckets = blocks_for(total, BUCKET_BYTES)
    by_batch = dealt.groupBy("batch")

    def asked(step, answers: DataFrame) -> DataFrame:
        return by_batch.cogroup(answers.groupBy("batch")).applyInArrow(
            lambda docs, told: step(docs, told, buckets), PARCEL)

    def told(answer, asking: DataFrame) -> DataFrame:
        return asking.groupBy("bucket").applyInArrow(answer, PARCEL)

    contexts = told(_answer_contexts, by_batch.applyInArrow(lambda docs: _probe(docs, buckets), PARCEL))
    phrases = told(_answer_phrases, asked(_phrases, contexts))
    strings = told(_answer_strings, asked(_strings, phrases))
    arrow = to_arrow_schema(schema)

    def done(docs: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.table(finish(docs, answers), schema=arrow) if docs.num_rows else arrow.empty_table()

    return by_batch.cogroup(strings.groupBy("batch")).applyInArrow(done, schema)


def byte_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs, and a digest of what stays."""
    dealt, total = deal(docs, id_col, text_col)
    schema = T.StructType([dealt.schema["id"]]).add("copies", "long")
    counts = ["n_bytes", "n_removed", "n_spans"]
    for name in counts:
        schema = schema.add(name, "long")
    made = _run(dealt, total, _digest, schema.add("kept_sha256", "string"))
    return copied(made, F.col("id").alias(id_col), *counts, "kept_sha256")


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns without the repeated bytes.  Bytes that no longer make up a character
    are dropped too, since a text is UTF-8."""
    dealt, total = deal(docs, id_col, text_col, whole=True)
    schema = T.StructType([dealt.schema["row"]]).add("copies", "long").add("kept", "string")
    made = _run(dealt, total, _cut, schema)
    return copied(made, *[
        F.col("kept").alias(name) if name == text_col else F.col("row").getField(name).alias(name)
        for name in docs.columns
    ])
