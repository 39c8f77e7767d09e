"""Importance resampling and vector codes, against SQL and plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import compare
from quern.llm import importance_resampling as resampling, vector_codes as codes
from quern.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_vector_codes"])
def test_same_rows_as_sql(spark, data, name):
    got = compare.spark_rows(QUERIES[name](spark, data))
    assert got[1]
    assert got == compare.sql_rows(compare.connect(data), ORACLES[name])


# ---------------------------------------------------------------- resampling

ODD = [None, "", " \n", "a", "A b\x00c", "été Ünïcode9 x" * 3, "word " * 3000, "x" * 50_000,
       "the cat sat on the mat " * 30, "The CAT sat-on the mat 7 " * 5, "中文 字 " * 20]


def plain_features(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, words + [a + " " + b for a, b in zip(words, words[1:])]


def plain_resample(rows, targets, percent=25, least=20):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, plain_features(text)[1]))
    for text in targets:
        t.update(map(bucket, plain_features(text)[1]))
    whole, aimed = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    made = []
    for i, text in rows:
        words, features = plain_features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * whole / ((s[b] + 1) * aimed)))
                 for b in map(bucket, features)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        made.append([i, len(features), weight, score, None, len(words) >= least])
    able = sorted((r for r in made if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, row in enumerate(able[:percent * len(able) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in made), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_resampling_of_odd_and_repeated_rows(spark, documents):
    texts = ODD * 2 + [ODD[8]] * 30
    ids = [*range(20), None, None, *[5] * 15, *range(100, 115)]
    docs = documents(texts, ids, "rank string, n_features int, row int").repartition(5)
    target = spark.createDataFrame([("the mat of the cat",), (None,), ("中文",)], "text string")
    want = plain_resample(list(zip(ids, texts)), ["the mat of the cat", None, "中文"])
    assert result(resampling.resample(docs, target)) == want
    for few, aim in ((docs.limit(0), target), (docs, target.limit(0))):
        kept = [] if few is not docs else plain_resample(list(zip(ids, texts)), [])
        assert result(resampling.resample(few, aim)) == kept


def test_drawn_documents_keep_their_columns(spark, documents):
    texts = [f"word{i} " * 25 for i in range(40)] + ["few words"]
    docs = documents(texts, [i // 2 for i in range(41)], "row string, row_ int, score long")
    target = spark.createDataFrame([("word3 word4",)], "text string")
    drawn = resampling.draw_documents(docs, target)
    assert drawn.columns == docs.columns and drawn.count() == 10
    assert drawn.exceptAll(docs).count() == 0
    ranked = resampling.resample(docs, target).filter("rank is not null")
    assert ranked.select("doc_id").exceptAll(drawn.select("doc_id")).count() == 0


def test_table_verifies_bytes_when_keys_collide():
    texts = ["a b c a b " + "long-word" * 9 + "x " + "long-word" * 9 + "y", None, "c b a", "12345678 123456789"]
    grams = resampling.NGrams(texts)
    names = [grams.joined[a:a + n] for a, n in zip(grams.begin.tolist(), grams.size.tolist())]
    assert sorted(names) == sorted(f.encode() for text in texts for f in plain_features(text)[1])
    assert grams.key.tolist() == [xxhash.xxh64_intdigest(name) for name in names]
    for key in (grams.key, grams.key * np.uint64(0), grams.key % np.uint64(3), ~grams.key * np.uint64(0)):
        table = resampling.Table(grams, key=key)
        by_slot = defaultdict(set)
        for name, slot in zip(names, table.slot.tolist()):
            by_slot[slot].add(name)
        assert all(len(held) == 1 for held in by_slot.values())
        assert len(by_slot) == len(set(names))
        assert {next(iter(by_slot[s])): int(table.count[s]) for s in by_slot} == Counter(names)
        assert all(table.bucket[s] == zlib.crc32(n) % 10_000 for n, s in zip(names, table.slot))


# ---------------------------------------------------------------- codes


def plain_codes(rows, parts, entries, rounds):
    """(id, vector of whole numbers) in seeding order."""
    size = len(rows[0][1]) // parts
    cut = [[tuple(x[p * size:(p + 1) * size]) for p in range(parts)] for _, x in rows]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), i) for i, entry in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            used = defaultdict(list)
            for x in cut:
                used[near(x[p], books[p])[1]].append(x[p])
            for i, members in used.items():
                books[p][i] = tuple(sum(c) // len(members) for c in zip(*members))
    found = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    digest = hashlib.sha256(",".join(
        str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return [("".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for f in found], digest


def test_codes_of_odd_and_repeated_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], i % 3) for i in range(60)]
    rows += [(i, rows[i % 4][1], None) for i in range(60, 80)] + [rows[7], (7, rows[8][1], 1)]
    rows += [(None, [0.5] * 8, 2), (90, [0.0] * 8, None), (91, [1.0, 2.0, 3.0], 1), (92, [], 1)]
    dropped = [(93, None, 1), (94, [1.0, None], 1), (95, [float("nan")] * 8, 1), (96, [float("-inf")] * 8, 2)]
    df = spark.createDataFrame(
        [(*row, "x", 1, 2.0) for row in rows + dropped],
        "vec_id long, embedding array<float>, label int, code string, error int, id double",
    ).repartition(4)
    whole = sorted(
        [(i, [math.floor(1024 * v) for v in x + [0.0] * (8 - len(x))], label) for i, x, label in rows],
        key=lambda r: (r[0] is None, r[0] or 0, r[1]),
    )
    want, digest = plain_codes([r[:2] for r in whole], 4, 16, 4)
    total = Counter()
    for (_, _, label), (_, error) in zip(whole, want):
        total[label] += error
    expected = sorted(((i, c, e, total[label], digest) for (i, _, label), (c, e) in zip(whole, want)), key=repr)
    got = codes.vector_codes(df, entries=16)
    assert sorted(map(tuple, got.collect()), key=repr) == expected
    assert codes.vector_codes(df.limit(0)).count() == 0
    assert codes.vector_codes(df.filter("embedding is null")).columns == got.columns


def test_many_labels_are_salted(spark, monkeypatch):
    df = spark.createDataFrame(
        [(i, [float(i % 7), 1.0, 2.0, 3.0], i % 5 or None) for i in range(200)],
        "vec_id long, embedding array<double>, label int")
    want = sorted(map(tuple, codes.vector_codes(df, entries=3).collect()))
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, codes.vector_codes(df, entries=3).collect())) == want


@pytest.mark.parametrize("scale", [1, 1 << 16])
def test_equal_average_search_is_exact_and_prunes(scale):
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, (256, 1)) * scale
    entries = centres + rng.integers(-20, 20, (256, 16)) * scale
    rows = entries[rng.integers(0, 256, 3000)] + rng.integers(-9, 9, (3000, 16)) * scale
    rows[:40] = entries[3]
    entries[200] = entries[3]  # a tie
    kind = float if scale == 1 else np.int64
    book = codes.Codebook(entries.astype(kind))
    index, distance = book.nearest(rows.astype(kind))
    full = ((rows[:, None].astype(object) - entries[None]) ** 2).sum(axis=2)
    assert index.tolist() == [list(row).index(min(row)) for row in full.tolist()]
    assert distance.astype(np.int64).tolist() == full.min(axis=1).tolist()
    assert (index[:40] == 3).all()
    assert book.measured < 0.5 * len(rows) * len(entries)


def test_decoding_is_within_the_error(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=16)], 0) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    quantiser = codes.train(codes.kept_vectors(df, "vec_id", "embedding", "label"), entries=8)
    for row in codes.vector_codes(df, entries=8).collect():
        whole = np.floor(np.array(rows[row.vec_id][1]) * 1024)
        assert ((whole - codes.decoded(row.code, quantiser)) ** 2).sum() == row.error


def test_components_out_of_range_are_refused():
    import pyarrow as pa
    with pytest.raises(ValueError):
        codes.whole_rows(pa.array([[1e12, 0.0]]), 2, 1024)
