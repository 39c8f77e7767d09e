"""Repeated byte strings, against brute force and SQL."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import compare
from quern.llm import batches, repeated_bytes as rb
from quern.llm.queries import ORACLES, QUERIES

LAST = batches.LAST_ID


def plain(rows):
    """(id, bytes, removed bytes, runs, digest) by looking at every string."""
    coded = [(LAST if i is None else i, (text or "").encode()) for i, text in rows]
    least = {}
    for i, raw in coded:
        for start in range(len(raw) - rb.LENGTH + 1):
            s = raw[start:start + rb.LENGTH]
            least[s] = min(least.get(s, (i, start)), (i, start))
    made = []
    for (i, raw), (name, _) in zip(coded, rows):
        gone = [False] * len(raw)
        for start in range(len(raw) - rb.LENGTH + 1):
            if least[raw[start:start + rb.LENGTH]] < (i, start):
                gone[start:start + rb.LENGTH] = [True] * rb.LENGTH
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        made.append((name, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(made, key=repr)


def group(table, name):
    keys = table.column(name).to_pylist()
    return {k: table.filter(pa.array([x == k for x in keys])) for k in dict.fromkeys(keys)}


def steps(rows, n_batches, buckets, seed=0):
    """The four steps over tables in memory, dealt as the plan deals them."""
    rng = random.Random(seed)
    of = defaultdict(lambda: rng.randrange(n_batches))
    docs = group(pa.table({
        "id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()),
        "copies": pa.array([1] * len(rows), pa.int64()),
        "batch": pa.array([of[i] for i, _ in rows], pa.int32()),
    }), "batch")
    none = rb.parcels([])

    def together(tables):
        tables = [t for t in tables if t.num_rows]
        return pa.concat_tables(tables) if tables else none

    def answered(answer, asked):
        told = together([answer(part) for part in group(together(asked), "bucket").values()])
        return group(told, "batch")

    told = answered(rb._answer_contexts, [rb._probe(d, buckets) for d in docs.values()])
    told = answered(rb._answer_phrases, [rb._phrases(d, told.get(b, none), buckets) for b, d in docs.items()])
    told = answered(rb._answer_strings, [rb._strings(d, told.get(b, none), buckets) for b, d in docs.items()])
    out = []
    for b, d in docs.items():
        made = rb._digest(d, told.get(b, none))
        ids = made["id"].to_pylist()
        out += zip(ids, made["n_bytes"].tolist(), made["n_removed"].tolist(), made["n_spans"].tolist(), made["kept_sha256"])
    return sorted(map(tuple, out), key=repr)


def corpus(seed, letters):
    """Texts made of passages that recur, whole and in part, with small changes."""
    rng = random.Random(seed)

    def fresh(n):
        return "".join(rng.choice(letters) for _ in range(n))
    passages = [fresh(rng.choice([60, 101, 130, 260])) for _ in range(5)]
    texts = []
    for _ in range(25):
        parts = []
        for _ in range(rng.randrange(5)):
            text = rng.choice(passages)
            kind = rng.randrange(4)
            if kind == 0:
                text = fresh(rng.randrange(150))
            elif kind == 1:
                a = rng.randrange(len(text))
                text = text[a:a + rng.randrange(30, 200)]
            elif kind == 2:
                a = rng.randrange(len(text))
                text = text[:a] + fresh(1) + text[a + 1:]
            parts.append(text)
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("letters", ["ab", "a", "abcdefghijklmnopqrstuvwxyz     ", "é中\x00x", "\x00"])
@pytest.mark.parametrize("seed", range(6))
def test_steps_equal_brute_force(letters, seed):
    texts = corpus(seed, letters)
    rows = [(i * 7 % 101, text) for i, text in enumerate(texts)]
    assert steps(rows, 4, 3, seed) == plain(rows)


@pytest.mark.parametrize("seed", range(4))
def test_repeated_ids_and_nulls(seed):
    texts = corpus(seed, "abcd ") + [None, "", "x" * 99, "x" * 100, "x" * 500]
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 2, 3, -5, 2**40, 2**62]), text) for text in texts] * 2
    assert steps(rows, 3, 2, seed) == plain(rows)


def test_one_long_text_and_shifted_copies():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(9, base * 3), (4, base[17:1700]), (5, "zz" + base[1650:2900]), (6, ("ab" * 400) + base[:90]), (7, "ab" * 300)]
    assert steps(rows, 2, 5) == plain(rows)


def test_order_of_the_parse_is_the_order_of_the_text():
    """Neighbours in the combined order are ordered as the suffixes themselves are."""
    texts = [t for t in corpus(3, "abc ") if len(t) > 300] * 2
    docs = pa.table({"id": list(range(len(texts))), "text": texts})
    batch = rb.Batch(docs)
    place = np.concatenate([np.arange(a, b - rb.LENGTH + 1) for a, b in zip(batch.begin, batch.end)])
    order = rb.CorpusOrder(batch, place)
    raw = batch.bytes.tobytes()
    strings = [raw[p:p + rb.LENGTH] for p in place[order.order].tolist()]
    assert strings == sorted(strings)
    label = order.label[order.order]
    assert [a == b for a, b in zip(strings, strings[1:])] == (label[1:] == label[:-1]).tolist()


def test_triggers_do_not_depend_on_the_surroundings():
    text = corpus(1, "abcdefg ")[3] * 2
    alone = rb.Batch(pa.table({"id": [1], "text": [text]}))
    within = rb.Batch(pa.table({"id": [0, 1], "text": ["xyz", "q" + text]}))
    assert (alone.trigger + 4).tolist() == [t for t in within.trigger.tolist() if t > 3]


def test_query_equals_sql(spark, data):
    got = compare.spark_rows(QUERIES["op11_repeated_bytes"](spark, data))
    assert got[1] and got == compare.sql_rows(compare.connect(data), ORACLES["op11_repeated_bytes"])


NAMES = "batch string, copies int, row int"


def test_query_on_odd_tables(spark, documents, monkeypatch):
    monkeypatch.setattr(rb, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(batches, "BATCH_BYTES", 1500)
    texts = corpus(2, "abc de") + [None, "", "x" * 700, None] + ["same text " * 30] * 40
    ids = [*range(20), *[7] * 5, None, 3, 4, None, *[None] * 30, *[11] * 10]
    docs = documents(texts, ids, NAMES).repartition(4)
    want = plain(list(zip(ids, texts)))
    assert sorted(map(tuple, rb.byte_digest(docs).collect()), key=repr) == want
    assert rb.byte_digest(docs.limit(0)).count() == 0
    cut = rb.remove_repeated_bytes(docs)
    assert cut.columns == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode())) for r in cut.collect())
    assert kept == sorted((i is None, i or 0, n - gone) for i, n, gone, _, _ in want)
    assert rb.remove_repeated_bytes(docs.limit(0)).count() == 0


def test_cut_texts_stay_text(spark, documents):
    """A removed run that ends inside a character takes the rest of the character along."""
    shared = "".join(map(chr, range(0x100, 0x132)))
    docs = documents(["a" + shared + "é", "b" + shared + "ê" + "c" * 10], None, NAMES)
    rows = {r.doc_id: r.text for r in rb.remove_repeated_bytes(docs).collect()}
    # The second text shares 100 bytes and the first byte of its next character.
    assert rows == {1: "a" + shared + "é", 2: "b" + "c" * 10}
