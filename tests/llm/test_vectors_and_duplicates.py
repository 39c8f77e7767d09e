"""Search, packing, passages and near copies, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import (
    batches, exact_top_k, packing, secret_scan, simhash_dedup, substring_dedup, vector_forest,
)
from quern.llm.common import table, tokenizer_path
from quern.llm.queries import ORACLES, QUERIES

ODD = [None, "", " \n", "a", "a b", "x" * 3000, "the cat " * 2000, "　 é\x0bz"]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, x int")


def odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "s", 1) for i in range(60)]
    rows += [(60, None, "s", 1), (61, [], "s", 1), (62, [1.0, None], "s", 1),
             (63, [float("nan")] * 6, "s", 1), (64, [float("inf")] * 6, "s", 1),
             (65, [0.0] * 6, "s", 1), (None, [1.0] * 6, "s", 1)]
    rows += [(100 + i, rows[3][1], "s", 1) for i in range(40)] + [rows[5], rows[5]]
    return vectors(spark, rows), {r[0]: r[1] for r in rows if r[0] is not None and r[1]
                                  and all(v is not None and np.isfinite(v) for v in r[1])}


def brute(known, queries, k, score):
    want = {}
    for q in queries:
        ranked = sorted((-score(known[q], x), i) for i, x in known.items() if i != q)[:k]
        want[q] = [(i, -s) for s, i in ranked]
    return want


def lists(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("blocks", [(2048, 2048), (3, 7)])
def test_exact_search(spark, blocks):
    df, known = odd_vectors(spark)
    floor = {i: [int(np.floor(np.float32(v) * 1024.0)) for v in x] for i, x in known.items()}
    got = exact_top_k.exact_top_k(
        df, F.col("id") % 5 == 0, 10, query_block=blocks[0], vector_block=blocks[1])
    queries = [i for i in known if i % 5 == 0]
    assert lists(got) == brute(floor, queries, 10, lambda a, b: sum(x * y for x, y in zip(a, b)))
    assert exact_top_k.exact_top_k(df.limit(0), F.col("id") % 5 == 0).count() == 0


def test_exact_search_of_few_and_of_large_values(spark):
    big = [(0, [1e9, 3.0]), (1, [1e9, 2.0]), (2, [-1e9, 1.0])]
    df = vectors(spark, [(i, x, "s", 1) for i, x in big])
    got = lists(exact_top_k.exact_top_k(df, F.col("id") == 0, 10, scale=1))
    assert [i for i, _ in got[0]] == [1, 2]


def test_exact_search_equals_sql(spark, data):
    import compare
    con = compare.connect(data)
    got = compare.spark_rows(QUERIES["op6_exact_top_k"](spark, data))
    assert got[1] and got == compare.sql_rows(con, ORACLES["op6_exact_top_k"])


def test_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(size=(3000, 64)) * 100 * np.exp(-np.arange(64) / 8))
    ids, match = np.arange(3000), exact_top_k._match(10)
    place, found, score = match(ids[:20], rows[:20], ids, rows)
    for q in range(20):
        full = rows @ rows[q]
        full[q] = -np.inf
        order = np.lexsort((ids, -full))[:10]
        assert found[place == q].tolist() == order.tolist()
        assert score[place == q].tolist() == full[order].tolist()
    assert match.products < 0.75 * 20 * rows.size


def test_clustered_vectors_need_few_products():
    rng = np.random.default_rng(5)
    centres = np.eye(64)[:16] * 900
    rows = np.floor(centres[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 64)) * 20)
    ids, match = np.arange(4000), exact_top_k._match(10)
    own = np.arange(0, 4000, 13)
    place, found, score = match(ids[own], rows[own], ids, rows)
    full = rows[own] @ rows.T
    full[np.arange(len(own)), own] = -np.inf
    for q, line in enumerate(full):
        assert found[place == q].tolist() == np.lexsort((ids, -line))[:10].tolist()
    assert match.products < 0.5 * len(own) * rows.size


def test_forest_on_odd_vectors(spark):
    df, known = odd_vectors(spark)
    known = {i: np.array(x, np.float32).astype(float) for i, x in known.items() if any(x)}
    queries = [i for i in known if i % 5 == 0]
    got = lists(vector_forest.nearest(df, F.col("id") % 5 == 0, 20, query_block=4, shard_rows=16))
    want = brute(known, queries, 20, lambda a, b: float(a @ b))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {
        q: [i for i, _ in x] for q, x in want.items()}
    assert vector_forest.nearest(df.limit(0), F.col("id") % 5 == 0).count() == 0


def test_forest_recall_when_it_searches_a_part():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    rows = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 0.4
    ids = np.arange(4000)
    place, found, _ = vector_forest._match(20, 10, 32, 200, 0.3)(ids[:50], rows[:50], ids, rows)
    hits = 0
    for q in range(50):
        full = rows @ rows[q]
        full[q] = -np.inf
        hits += len(set(found[place == q]) & set(np.argsort(-full)[:20]))
    assert hits / 1000 >= 0.9


def test_forest_follows_a_recall_target():
    """On clustered rows a small part is scored, on structureless ones as much as recall takes."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32)) * 3
    clustered = centres[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 32)) * 0.2
    for rows, most in ((clustered, 0.3), (rng.normal(size=(4000, 64)), 1.0)):
        ids = np.arange(4000)
        own = ids[::40]
        match = vector_forest._match(20, 10, 32, 0, None)
        place, found, _ = match(own, rows[own], ids, rows)
        full = rows[own] @ rows.T
        full[np.arange(len(own)), own] = -np.inf
        hits = sum(len(set(found[place == q]) & set(np.argsort(-line)[:20])) for q, line in enumerate(full))
        assert hits / (20 * len(own)) >= 0.9
        assert match.scored <= most * len(own) * len(rows)


def test_forest_handles_copies():
    rows = np.vstack([np.ones((500, 8)), np.eye(8)])
    forest = vector_forest.Forest(vector_forest._lift(rows), 3, 16)
    for root in range(3):
        assert forest.roots[root] is not None
    margins = (rows[0] @ forest.normal[:, :-1].T).tolist()
    assert len(forest.gather(margins, 10**6, len(rows))) == len(rows)


def test_recall_of_the_query(spark, data):
    known = {r.vec_id: np.array(r.embedding, float) for r in table(spark, data, "embeddings").collect()}
    got = lists(QUERIES["op9_nearest_vectors"](spark, data))
    want = brute(known, [i for i in known if i % 20 == 0], 20, lambda a, b: float(a @ b))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, found in got.items():
        assert all(s == pytest.approx(float(known[q] @ known[i])) for i, s in found)


# ---------------------------------------------------------------- packing


def check_packing(rows, ids_of, window=2048):
    sequences, docs = {}, {}
    for r in rows:
        ids = ids_of[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts, total in [*((p, None) for p in sequences.values()),
                         *((docs[i], len(ids)) for i, ids in ids_of.items())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= window
    return [sum(length for _, length in parts) for parts in sequences.values()]


def test_packing(spark, data, documents):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = [*ODD, "İstanbul Σς don't <|endoftext|> x", "\r\n\tq\u0085r", "ab\x1ccd"]
    docs = table(spark, data, "documents").select("doc_id", "text").unionByName(
        documents(texts, [10**6 + i for i in range(len(texts))]).select("doc_id", "text")
    ).cache()
    ids_of = {
        r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for r in docs.collect()
    }
    sizes = check_packing(packing.pack_documents(docs).collect(), ids_of)
    assert sum(size < 2048 for size in sizes) <= 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packing_of_repeated_rows(spark, documents):
    texts = ["same words here"] * 30 + ["long text " * 3000] * 2 + [None]
    docs = documents(texts, [7] * 30 + [8, 8, None], "length string, part int, ids int")
    rows = packing.pack_documents(docs, window=64).collect()
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert sum(r.length for r in rows) == want
    assert sum(r.start == 0 for r in rows if r.doc_id == 7) == 30
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert sum(n < 64 for n in filled.values()) <= 1 and max(filled.values()) <= 64


def test_plan_places_every_piece_once():
    rng = random.Random(1)
    for histogram in (
        {1500: 900}, {2048: 5, 1024: 7}, {1: 1}, {2047: 3, 1: 2, 600: 10},
        {rng.randint(1, 2048): rng.randint(1, 40) for _ in range(500)},
    ):
        plan = packing.Plan(histogram, 2048)
        covered = {}
        for length, rank, *_ in plan.rows:
            covered.setdefault(length, []).append(rank)
        assert set(covered) == set(histogram) and (plan.left == 0).all()


def test_counts_solve_the_least_squares():
    combos = np.array([(4, 0, 0), (1, 3, 0), (2, 2, 0), (1, 1, 2)])
    truth = np.array([5.0, 3.0, 2.0, 4.0])
    counts = np.zeros(5)
    for combo, times in zip(combos, truth):
        for length in combo[combo > 0]:
            counts[length] += times
    x = packing.solve_counts(combos, counts, 4000)
    assert (x >= 0).all() and x == pytest.approx(truth, abs=0.05)


# ---------------------------------------------------------------- passages


def kept_words(texts):
    """(words, removed, kept words) per document by plain windows."""
    words = {i: (text or "").encode().split() for i, text in texts}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k:k + 13]), i)
    made = {}
    for i, own in words.items():
        gone = [False] * len(own)
        for k in range(len(own) - 12):
            if first[tuple(own[k:k + 13])] < i:
                gone[k:k + 13] = [True] * 13
        made[i] = (len(own), sum(gone), [w for w, g in zip(own, gone) if not g])
    return made


def passages(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    shared = [[word() for _ in range(rng.randint(11, 40))] for _ in range(8)]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [word() for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.6:
                parts += rng.choice(shared)
        texts.append(" ".join(parts))
    return texts + texts[:20] + ["same word " * 60] * 3 + ODD


@pytest.mark.parametrize("sizes", [(1 << 22, 1 << 24), (900, 700)])
def test_passages_equal_plain_windows(spark, documents, monkeypatch, sizes):
    monkeypatch.setattr(batches, "BATCH_BYTES", sizes[0])
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", sizes[1])
    texts = passages()
    ids = random.Random(3).sample(range(10_000), len(texts))
    want = kept_words(zip(ids, texts))
    rows = substring_dedup.repeat_digest(documents(texts, ids)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, removed, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, removed)
        assert r.kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()


def test_removal_keeps_rows_columns_and_clean_texts(spark, documents):
    texts = passages(7)
    want = kept_words(enumerate(texts, 1))
    rows = substring_dedup.remove_repeats(documents(texts)).collect()
    assert len(rows) == len(texts) and rows[0].batch == 1
    for r in rows:
        n, removed, kept = want[r.doc_id]
        assert (r.text or "").encode().split() == kept
        if not removed:
            assert r.text == texts[r.doc_id - 1]


def test_clashing_columns_stay(spark, documents, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_BYTES", 900)
    texts = passages(5) + ["same word " * 60] * 20
    docs = documents(texts, [7 if i % 3 else i for i in range(len(texts))],
                     "_batch string, _copies long, copies int").withColumn("row", F.lit("r"))
    made = substring_dedup.remove_repeats(docs)
    assert made.columns == docs.columns and made.count() == len(texts)
    assert made.select("_batch", "row").distinct().collect() == [("x", "r")]


def test_equal_ids_are_one_document(spark, documents):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = substring_dedup.repeat_digest(documents([passage, passage, passage], [7, 7, 9])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(7, 0), (7, 0), (9, 30)]
    rows = substring_dedup.repeat_digest(documents([passage, passage], [None, 9])).collect()
    assert sorted((r.n_removed for r in rows)) == [0, 30]
    assert substring_dedup.repeat_digest(documents([""]).limit(0)).count() == 0


@pytest.mark.parametrize("shared", [7, None])
def test_rows_of_one_id_fill_several_batches(spark, documents, monkeypatch, shared):
    monkeypatch.setattr(batches, "BATCH_BYTES", 900)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 700)
    texts = passages(5)
    texts += texts[:2] * 20
    ids = [shared if i % 3 else 100 + i for i in range(len(texts))]
    docs = documents(texts, ids)
    dealt = batches.deal(docs, "doc_id", "text")[0].collect()
    own = [r for r in dealt if r.id == shared]
    assert len({r.batch for r in own}) > 5 and sum(r.copies for r in own) == ids.count(shared)
    assert len({r.text for r in own}) == len(own)
    firsts = {}
    for i, text in zip(ids, texts):
        words = (text or "").encode().split()
        for k in range(len(words) - 12):
            key = tuple(words[k:k + 13])
            firsts[key] = min(firsts.get(key, 10**9), 10**9 if i is None else i)
    want = []
    for i, text in zip(ids, texts):
        words, gone = (text or "").encode().split(), set()
        for k in range(len(words) - 12):
            if firsts[tuple(words[k:k + 13])] < (10**9 if i is None else i):
                gone.update(range(k, k + 13))
        want.append((str(i), " ".join(w.decode() for k, w in enumerate(words) if k not in gone)))
    rows = substring_dedup.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), " ".join(w.decode() for w in (r.text or "").encode().split())) for r in rows) == sorted(want)
    assert substring_dedup.repeat_digest(docs).count() == len(texts)


# ---------------------------------------------------------------- near copies


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2 and root(a) != root(b):
                a_root, b_root = root(a), root(b)
                parent[max(a_root, b_root)] = min(a_root, b_root)
    return {i: root(i) for i in ids}


def near_texts(seed=2):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        words = [f"W{rng.randint(0, 500)}" for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 12)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "other"
            texts.append(" ".join(copy))
    return texts + texts[:5] + ODD + [None, "A b", "a B"]


def test_near_copies_equal_all_pairs(spark, documents):
    texts = near_texts()
    ids = random.Random(4).sample(range(10_000), len(texts))
    prints = {i: plain_fingerprint(text) for i, text in zip(ids, texts)}
    want = groups(prints)
    rows = simhash_dedup.fingerprint_digest(documents(texts, ids)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{prints[i]:016x}", want[i]) for i in ids}
    kept = simhash_dedup.keep_one(documents(texts, ids)).collect()
    assert {r.doc_id for r in kept} == set(want.values()) and kept[0].batch == 1


def test_shards_find_every_link_of_random_neighbours(spark):
    rng = random.Random(6)
    chain = [rng.getrandbits(64)]
    for _ in range(60):  # a long chain of links
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = {i: v for i, v in enumerate(dict.fromkeys([*chain, *(rng.getrandbits(64) for _ in range(100))]))}
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in prints.items()]
    reps = spark.createDataFrame(rows, "fp long, rep long").repartition(5)
    roots = {r.v: r.root for r in simhash_dedup.components(simhash_dedup.stars_of(reps)).collect()}
    want = groups(prints)
    assert {i: roots.get(i, i) for i in prints} == want


def test_bk_tree_equals_all_pairs():
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = sorted({centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4)))
                     for _ in range(300)})
    label = simhash_dedup.bk_components(np.array(values, np.uint64))
    assert dict(enumerate(label.tolist())) == groups(dict(enumerate(values)))


def test_near_copies_of_odd_tables(spark, documents):
    rows = simhash_dedup.near_duplicates(documents(["a b c"] * 3, [5, 5, None])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == [("5", 5), ("5", 5), ("None", 5)]
    assert simhash_dedup.near_duplicates(documents(["a"]).limit(0)).count() == 0


def test_near_copies_of_repeated_and_null_ids(spark, documents):
    kept = simhash_dedup.keep_one(documents(["a b c"] * 3 + ["d e f"] * 2, [5, 5, None, None, None])).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("5", "a b c"), ("None", "d e f")]
    # Two texts within two bits of a third, whose id is NULL, but not of each other.
    rng, prints = random.Random(1), {}
    words = [f"w{i}" for i in range(400)]
    for _ in range(400):
        copy = list(words)
        copy[rng.randrange(400)] = f"x{rng.randint(0, 99)}"
        prints[simhash_dedup.fingerprint(" ".join(copy))] = " ".join(copy)
    near = lambda a, b: (a ^ b).bit_count() <= 2
    a, b, c = next((a, b, c) for b in prints for a in prints for c in prints
                   if near(a, b) and near(b, c) and not near(a, c))
    found = simhash_dedup.near_duplicates(documents([prints[a], prints[b], prints[c]], [1, None, 3]))
    assert {r.component_id for r in found.collect()} == {1}


def test_stage_keeps_one_of_each_group(spark, documents):
    import corpus_pipeline
    texts = near_texts()
    ids = random.Random(4).sample(range(10_000), len(texts))
    want = groups({i: plain_fingerprint(text) for i, text in zip(ids, texts)})
    docs = documents(texts, ids, "row string, ROW_ int, node long")
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_stage_keeps_rows_of_repeated_ids_apart(spark, documents):
    texts = ["a b c"] * 3 + ["d e f", "d e f", None, " ", "g h i"]
    kept = simhash_dedup.keep_one(documents(texts, [5, 5, None, None, None, 5, 6, 5])).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == [
        ("5", "a b c"), ("5", "g h i"), ("None", "d e f")]
    assert len(kept) == 4
    assert simhash_dedup.keep_one(documents(["a"]).limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, data):
    import corpus_pipeline
    docs = table(spark, data, "documents")
    columns = docs.columns
    n, kept_ids = docs.count(), {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and ids <= kept_ids, name
        n, kept_ids = docs.count(), ids
    rows = docs.collect()
    assert 0 < n and len(rows) == n
    prints = groups({r.doc_id: plain_fingerprint(r.text) for r in table(spark, data, "documents").collect()})
    assert len({prints[i] for i in kept_ids}) == len(kept_ids)
    scanner = secret_scan.scanner(secret_scan.RULES)
    assert not any(scanner.spans([r.text for r in rows]))
    assert all(r.n_chars == len(r.text) for r in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in packed} == kept_ids
    whole = corpus_pipeline.run(spark, data).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in whole} and {
        r.doc_id for r in whole} == kept_ids


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline
    schema = "doc_id long, text string, lang string, source string, n_chars long, batch string, ROW int, copies int, id int"
    good = " ".join(f"plain{i} words{i} follow{i}" for i in range(60))
    rows = [(i, f"{good} {i} token = abcdefghijklmnop{i}", "en", "s", 1, "b", 1, 2, 3) for i in range(6)]
    rows += [(None, good, None, None, None, None, None, None, None)] * 3 + [(50, None, "en", "s", 0, "b", 1, 2, 3)]
    rows += [(7, good + " seven", "en", "s", 1, "b", 1, 2, 3)] * 2
    labels = "doc_id long, quality int, toxic int"
    for name, docs, rated in (("odd", rows, [(1, 1, 0), (None, 1, 0), (2, None, 0)]), ("none", [], []), ("unrated", rows, [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(rated, labels).write.parquet(f"{folder}/labels.parquet")
        pieces = corpus_pipeline.run(spark, folder).collect()
        assert bool(pieces) == bool(docs)
        kept = table(spark, folder, "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, folder)
            assert kept.columns == [f.strip().split(" ")[0] for f in schema.split(",")]
        assert kept.filter(F.contains("text", F.lit("abcdefghijklmnop"))).count() == 0
        assert kept.count() == len({(r.doc_id) for r in pieces}) or None in {r.doc_id for r in pieces}
