"""Removal of passages that an earlier document already holds.

A window is ``WINDOW`` consecutive words.  A word is removed if a window covers it whose words also
start somewhere in a document with a smaller id.

Fixed-block anchors.  Every document is indexed at its non-overlapping blocks of ``BLOCK`` words.
Because ``WINDOW >= 2 * BLOCK - 1``, a window that two documents share holds a whole indexed block
of each of them, so the block's hash is met when the other document is probed with every rolling
window of ``BLOCK`` words.  Only around such hits are repeats extended: the full windows there are
compared across documents, and runs of windows that repeat add up to maximal repeats.

How it runs.  Documents are dealt once, by a hash of their id, into batches of bounded text; three
steps read that one exchange.  Rows of an id (or of NULL) that fills a batch alone are folded if they
are equal and spread over the batches, which compare by id.

1. *Probe*: a batch sends the distinct hashes of its rolling blocks, split by hash into buckets;
   each says if it is an indexed block and if two documents of the batch hold it.  A bucket answers
   each batch with the hashes that are indexed somewhere and held by two documents.
2. *Extend*: a batch sends its distinct windows around hits, with the smallest document id that
   holds each.  A bucket answers with the windows that a smaller document of another batch holds.
3. *Finish*: a batch removes windows named in the answer, and those that a smaller document of the
   same batch holds.

Hashes travel as packed arrays, one row per batch and bucket, and are folded per batch first, so a
passage in a third of all documents sends one entry per batch.  No pairs of documents are formed,
and nothing passes through the driver but one sum and if such an id exists.  Windows are compared by 96 bits of hash.

Cases: NULL or blank texts have no words; texts shorter than a window lose nothing; equal ids
(repeated rows) are one document and never remove from each other; a NULL id counts as larger than
all others; very long texts are processed whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.llm.batches import BUCKET_BYTES, LAST_ID, copied, deal
from quern.llm.common import blocks_for

WINDOW = 13
BLOCK = 7

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_PACKED = "_bucket int, _batch int, _packed binary"
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _rolling(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on."""
    count = len(words) - size + 1
    value = np.zeros(max(count, 0), _U)
    if count > 0:
        for k in range(size):
            value = value * _U(base) + words[k:k + count]
    return _mix(value)


class Batch:
    """The words of a batch of documents, one after another."""

    def __init__(self, docs: pa.Table):
        self.ids = np.array(
            [LAST_ID if i is None else i for i in docs.column("id").to_pylist()], np.int64
        )
        self.words = [(text or "").encode().split() for text in docs.column("text").to_pylist()]
        self.sizes = np.array([len(words) for words in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.hashes = np.fromiter(
            (h for words in self.words for h in map(xxhash.xxh64_intdigest, words)),
            _U, int(self.sizes.sum()),
        )

    def starts(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a stretch of ``size`` words fits into one document, and which document."""
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = np.arange(len(doc))
        fits = place + size <= self.ends[doc]
        return place[fits], doc[fits]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place, document and the two hash lanes (64 and 32 bits) of every window."""
        place, doc = self.starts(WINDOW)
        return (
            place, doc, _rolling(self.hashes, WINDOW, 0x9E3779B97F4A7C15)[place],
            _rolling(_mix(self.hashes), WINDOW, 0xD6E8FEB86659FD93)[place].astype(np.uint32),
        )


def _block_keys(batch: Batch, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    place, doc = batch.starts(BLOCK)
    hashes = _rolling(batch.hashes, BLOCK, 0xC2B2AE3D27D4EB4F)[place]
    bucket = (hashes >> _U(32)) % _U(buckets)
    return place, doc, bucket.astype(np.int64), (hashes & _U(0xFFFFFFFF)).astype(np.uint32)


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    changed = np.zeros(len(sorted_keys[0]), bool)
    changed[0] = True
    for key in sorted_keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changed)


def _rows(batch: int, buckets: np.ndarray, pack, total: int) -> pa.Table:
    """One row per bucket of the entries, which are sorted by bucket."""
    heads = _runs(buckets)
    tails = np.append(heads, total)[1:]
    return pa.table({
        "_bucket": pa.array(buckets[heads], pa.int32()),
        "_batch": pa.array(np.full(len(heads), batch), pa.int32()),
        "_packed": pa.array(
            [pack(slice(a, b)) for a, b in zip(heads, tails, strict=True)], pa.binary()
        ),
    })


# ---------------------------------------------------------------- step 1: probe


def _probe(docs: pa.Table, buckets: int) -> pa.Table:
    batch = Batch(docs)
    place, doc, bucket, key = _block_keys(batch, buckets)
    first = (batch.ends - batch.sizes)[doc]
    joined = (bucket.astype(_U) << _U(32)) | key.astype(_U)
    order = np.argsort(joined)
    joined, doc = joined[order], batch.ids[doc[order]]
    indexed = ((place - first) % BLOCK == 0)[order]
    heads = _runs(joined)
    if not len(heads):
        return _rows(0, heads, None, 0)
    shared = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
    flags = np.logical_or.reduceat(indexed, heads).astype(np.uint8) | (shared.astype(np.uint8) << 1)
    bucket, key = (joined[heads] >> _U(32)).astype(np.int64), joined[heads].astype(np.uint32)
    order = np.lexsort((key, flags, bucket))
    bucket, key, flags = bucket[order], key[order], flags[order]

    def pack(part: slice) -> bytes:
        return np.bincount(flags[part], minlength=4).astype("<u4").tobytes() + key[part].tobytes()

    return _rows(docs.column("batch")[0].as_py(), bucket, pack, len(key))


def _answer_probes(table: pa.Table) -> pa.Table:
    """For each batch the hashes of this bucket that can start a repeat."""
    keys, flags, owner = [], [], []
    for row, packed in enumerate(table.column("_packed").to_pylist()):
        counts = np.frombuffer(packed, "<u4", 4)
        keys.append(np.frombuffer(packed, "<u4", offset=16))
        flags.append(np.repeat(np.arange(4, dtype=np.uint8), counts))
        owner.append(np.full(len(keys[-1]), row, np.int32))
    key, flag, owner = np.concatenate(keys), np.concatenate(flags), np.concatenate(owner)
    order = np.argsort(key)
    heads = _runs(key[order])
    seen = np.bitwise_or.reduceat(flag[order], heads)
    held = np.diff(np.r_[heads, len(key)])
    wanted = ((seen & 1) > 0) & ((held > 1) | ((seen & 2) > 0))
    chosen = order[np.repeat(wanted, held)]
    return _reply(table, owner[chosen], lambda part: key[chosen[part]].tobytes())


def _reply(table: pa.Table, owner: np.ndarray, pack) -> pa.Table:
    """One row per batch that gets entries; ``pack`` takes places of ``owner``."""
    order = np.argsort(owner, kind="stable")
    heads = _runs(owner[order])
    parts = np.split(order, heads[1:]) if len(heads) else []
    rows = owner[order][heads]
    return pa.table({
        "_bucket": table.column("_bucket").take(pa.array(rows)),
        "_batch": table.column("_batch").take(pa.array(rows)),
        "_packed": pa.array([pack(part) for part in parts], pa.binary()),
    })


# ---------------------------------------------------------------- step 2: extend


def _extend(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not answers.num_rows or not docs.num_rows:
        return _rows(0, np.zeros(0, np.int64), None, 0)
    batch = Batch(docs)
    place, _, bucket, key = _block_keys(batch, buckets)
    hits = np.concatenate([
        (_U(b) << _U(32)) | np.frombuffer(packed, "<u4").astype(_U) for b, packed in
        zip(answers.column("_bucket").to_pylist(), answers.column("_packed").to_pylist(), strict=True)
    ])
    hits.sort()
    joined = (bucket.astype(_U) << _U(32)) | key.astype(_U)
    at = np.minimum(np.searchsorted(hits, joined), len(hits) - 1)
    hit = np.zeros(len(batch.hashes) + 1, np.int64)
    hit[place] = hits[at] == joined
    before = np.r_[0, np.cumsum(hit)]
    start, doc, one, two = batch.windows()
    near = before[start + WINDOW - BLOCK + 1] > before[start]
    one, two, ids = one[near], two[near], batch.ids[doc[near]]
    order = np.lexsort((ids, two, one, one % _U(buckets)))
    one, two, ids = one[order], two[order], ids[order]
    heads = _runs(one, two)
    one, two, ids = one[heads], two[heads], ids[heads]

    def pack(part: slice) -> bytes:
        # Ids of a batch and bucket usually lie close enough for 32 bits above the smallest.
        least = ids[part].min()
        above = (ids[part] - least).astype(_U)
        wide = above.max() >> _U(32) > 0
        head = np.array([len(above), least, wide], "<i8").tobytes()
        above = above if wide else above.astype(np.uint32)
        return head + one[part].tobytes() + two[part].tobytes() + above.tobytes()

    return _rows(
        docs.column("batch")[0].as_py(), (one % _U(buckets)).astype(np.int64), pack, len(one)
    )


def _answer_windows(table: pa.Table) -> pa.Table:
    """For each batch the windows that another batch holds in a smaller document."""
    ones, twos, all_ids, owner = [], [], [], []
    for row, packed in enumerate(table.column("_packed").to_pylist()):
        size, least, wide = np.frombuffer(packed, "<i8", 3).tolist()
        ones.append(np.frombuffer(packed, "<u8", size, 24))
        twos.append(np.frombuffer(packed, "<u4", size, 24 + 8 * size))
        above = np.frombuffer(packed, "<u8" if wide else "<u4", size, 24 + 12 * size)
        all_ids.append((above.astype(_U) + np.array(least).astype(_U)).astype(np.int64))
        owner.append(np.full(size, row, np.int32))
    one, two, ids, owner = (np.concatenate(x) for x in (ones, twos, all_ids, owner))
    order = np.lexsort((ids, two, one))
    heads = _runs(one[order], two[order])
    least = np.repeat(ids[order][heads], np.diff(np.r_[heads, len(one)]))
    chosen = order[ids[order] > least]
    return _reply(
        table, owner[chosen],
        lambda part: one[chosen[part]].tobytes() + two[chosen[part]].tobytes(),
    )


# ---------------------------------------------------------------- step 3: finish


def _removed(docs: pa.Table, answers: pa.Table) -> tuple[Batch, np.ndarray]:
    """The batch, and which of its words are removed."""
    batch = Batch(docs)
    start, doc, one, two = batch.windows()
    ids = batch.ids[doc]
    named = answers.column("_packed").to_pylist()
    sizes = [len(packed) // 12 for packed in named]
    far_one = np.concatenate([
        np.zeros(0, _U), *(np.frombuffer(p, "<u8", n) for p, n in zip(named, sizes, strict=True))
    ])
    far_two = np.concatenate([
        np.zeros(0, np.uint32),
        *(np.frombuffer(p, "<u4", n, 8 * n) for p, n in zip(named, sizes, strict=True)),
    ])
    # The answers join the batch's windows under an id below all others.
    all_one, all_two = np.r_[one, far_one], np.r_[two, far_two]
    all_ids = np.r_[ids, np.full(len(far_one), np.iinfo(np.int64).min)]
    order = np.argsort(all_one)
    heads = _runs(all_one[order])
    spread = np.diff(np.r_[heads, len(order)])
    if not np.array_equal(all_two[order], np.repeat(all_two[order][heads], spread)):
        order = np.lexsort((all_two, all_one))  # two windows agree in one lane only
        heads = _runs(all_one[order], all_two[order])
        spread = np.diff(np.r_[heads, len(order)])
    repeated = np.zeros(len(order), bool)
    if len(order):
        least = np.minimum.reduceat(all_ids[order], heads)
        repeated[order] = all_ids[order] > np.repeat(least, spread)
    covered = np.zeros(len(batch.hashes) + 1, np.int64)
    begun = start[repeated[:len(start)]]
    np.add.at(covered, begun, 1)
    np.add.at(covered, begun + WINDOW, -1)
    return batch, np.cumsum(covered)[:-1] > 0


def _digest(docs: pa.Table, answers: pa.Table) -> dict[str, list]:
    batch, gone = _removed(docs, answers)
    removed, digests, at = [], [], 0
    for words in batch.words:
        flags = gone[at:at + len(words)]
        at += len(words)
        removed.append(int(flags.sum()))
        if removed[-1]:
            words = [word for word, flag in zip(words, flags.tolist(), strict=True) if not flag]
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return {
        "id": docs.column("id"), "copies": docs.column("copies"), "n_words": batch.sizes,
        "n_removed": removed, "kept_sha256": digests,
    }


def cut_text(text: str, gone: np.ndarray) -> str:
    """The text without its removed words and the white space that follows them."""
    raw, parts, at = text.encode(), [], 0
    spans = [match.span() for match in _WORD.finditer(raw)]
    nexts = [start for start, _ in spans[1:]] + [len(raw)]
    for (start, _), end, flag in zip(spans, nexts, gone.tolist(), strict=True):
        if flag:
            parts.append(raw[at:start])
            at = end
    return b"".join([*parts, raw[at:]]).decode()


def _cut(docs: pa.Table, answers: pa.Table) -> dict[str, list]:
    batch, gone = _removed(docs, answers)
    texts, at = docs.column("text").to_pylist(), 0
    for i, words in enumerate(batch.words):
        flags = gone[at:at + len(words)]
        at += len(words)
        if flags.any():
            texts[i] = cut_text(texts[i], flags)
    return {"row": docs.column("row"), "copies": docs.column("copies"), "kept": texts}


# ---------------------------------------------------------------- the plan


def _run(dealt: DataFrame, total: int, finish, schema: T.StructType) -> DataFrame:
    buckets = blocks_for(total, BUCKET_BYTES)
    by_batch = dealt.groupBy("batch")
    probes = by_batch.applyInArrow(lambda t: _probe(t, buckets), _PACKED)
    hits = probes.groupBy("_bucket").applyInArrow(_answer_probes, _PACKED)
    windows = by_batch.cogroup(hits.groupBy("_batch")).applyInArrow(
        lambda t, answers: _extend(t, answers, buckets), _PACKED
    )
    repeats = windows.groupBy("_bucket").applyInArrow(_answer_windows, _PACKED)
    arrow = to_arrow_schema(schema)

    def done(t: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.table(finish(t, answers), schema=arrow) if t.num_rows else arrow.empty_table()

    return by_batch.cogroup(repeats.groupBy("_batch")).applyInArrow(done, schema)


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, removed words, and a digest of the words that stay."""
    dealt, total = deal(docs, id_col, text_col)
    schema = T.StructType([dealt.schema["id"]]).add("copies", "long").add("n_words", "long").add(
        "n_removed", "long").add("kept_sha256", "string")
    made = _run(dealt, total, _digest, schema)
    return copied(made, F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns, with the repeated passages cut out of the text."""
    dealt, total = deal(docs, id_col, text_col, whole=True)
    schema = T.StructType([dealt.schema["row"]]).add("copies", "long").add("kept", "string")
    made = _run(dealt, total, _cut, schema)
    return copied(made, *[
        F.col("kept").alias(name) if name == text_col else F.col("row").getField(name).alias(name)
        for name in docs.columns
    ])
