import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern import session
from quern.functions import pairs
from quern.functions.text import strip
from quern.operators import evaluation, ingest


def test_perplexity_goldens(spark):
    losses = spark.createDataFrame([(1.0, 1), (2.0, 3)], "loss double, n_tokens long")
    assert evaluation.weighted_perplexity(losses).first().perplexity == pytest.approx(math.exp(1.75))
    assert evaluation.batch_perplexity(losses).first().perplexity == pytest.approx(math.exp(1.5))
    none = losses.limit(0)
    assert evaluation.weighted_perplexity(none).first().perplexity is None
    assert evaluation.batch_perplexity(none).first().perplexity is None
    zero = spark.createDataFrame([(1.0, 0)], "loss double, n_tokens long")
    assert evaluation.weighted_perplexity(zero).first().perplexity is None


@pytest.mark.parametrize("heavy", [3, 10_000])
@pytest.mark.parametrize("same", [True, False])
def test_unigram_losses_equal_counting(spark, monkeypatch, heavy, same):
    monkeypatch.setattr(evaluation, "HEAVY", heavy)
    corpus = {i: "the " * 20 + f"w{i} w{i % 3} the\nend\u3000x" for i in range(12)}
    texts = corpus if same else {0: "the w1 unseen unseen", 1: "the the", 2: "unseen"}
    schema = "id int, text string"
    corpus_df = spark.createDataFrame(list(corpus.items()), schema)
    texts_df = corpus_df if same else spark.createDataFrame(list(texts.items()), schema)
    seen = Counter(w for t in corpus.values() for w in t.split())
    mass = sum(seen.values()) + len(seen)
    given = None if same else corpus_df
    got = {r.id: r for r in evaluation.unigram_losses(texts_df, "id", "text", given).collect()}
    assert set(got) == set(texts)
    total = sum(r.loss * r.n_tokens for r in got.values())
    n = sum(r.n_tokens for r in got.values())
    whole = evaluation.unigram_perplexity(texts_df, "text", given).first()
    assert whole.n_tokens == n and whole.mean_loss == pytest.approx(total / n)
    for key, text in texts.items():
        costs = [-math.log((seen[w] + 1) / mass) for w in text.split()]
        assert got[key].n_tokens == len(costs)
        assert got[key].loss == pytest.approx(sum(costs) / len(costs))


def test_texts_without_words_keep_their_row(spark):
    rows = [(1, "a b"), (2, " \n"), (3, None), (4, "")]
    texts = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: (r.loss is None, r.n_tokens)
           for r in evaluation.unigram_losses(texts, "id", "text").collect()}
    assert got == {1: (False, 2), 2: (True, 0), 3: (True, 0), 4: (True, 0)}


def test_expected(spark):
    rows = spark.createDataFrame(
        [(1, "def add(): return 1", ["add", "return"]), (2, "x", ["add", "x"]), (3, "y", [])],
        "id int, answer string, expected array<string>",
    )
    checked = evaluation.expected_hits(rows, "answer", "expected")
    got = {r.id: (r.hits, r.wanted, r.passed) for r in checked.collect()}
    assert got == {1: (2, 2, True), 2: (1, 2, False), 3: (0, 0, True)}
    rate = evaluation.pass_rate(checked).first()
    assert (rate.cases, rate.passed, rate.hits, rate.wanted) == (3, 2, 3, 4)


def test_top_repos(spark):
    from datetime import datetime
    new, old = datetime(2025, 6, 1), datetime(2024, 6, 1)
    rows = [("b", new, 500, 50, new, "Python"), ("a", new, 500, 50, new, "Python"),
            ("few", new, 100, 50, new, "Python"), ("forks", new, 500, 10, new, "Python"),
            ("old", new, 500, 50, old, "Python"), ("c", new, 900, 50, new, "C")]
    listing = spark.createDataFrame(
        rows, "repo string, updated_at timestamp, stars long, forks long, pushed_at timestamp, "
        "language string")
    assert [r.repo for r in ingest.top_repos(listing).collect()] == ["a", "b"]
    assert [r.repo for r in ingest.top_repos(listing, language=None, max_results=1).collect()] == ["c"]
    assert ingest.top_repos(listing, max_results=0).count() == 0
    state = spark.createDataFrame([("a", new), ("b", datetime(2026, 1, 1)), ("z", old)],
                                  "repo string, updated_at timestamp")
    changed = ingest.changed_repos(ingest.top_repos(listing), state)
    assert [r.repo for r in changed.collect()] == ["b"]
    after = {r.repo: r.updated_at for r in ingest.updated_state(state, changed).collect()}
    assert after == {"a": new, "b": new, "z": old}


def test_strip_keeps_inner_space(values):
    assert values(strip, ["\x85 a b\x1c"]) == ["a b"]


# ------------------------------------------------------------- bigrams


def plain_bigram_model(corpus):
    """p(word | word before) by interpolated Kneser-Ney, from plain counting."""
    seen = Counter()
    for text in corpus:
        words = (text or "").split()
        seen.update(zip(["", *words], words))
    once, twice = (sum(c == n for c in seen.values()) for n in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.75
    total, followers, precursors = Counter(), Counter(), Counter()
    for (prev, word), c in seen.items():
        total[prev] += c
        followers[prev] += 1
        precursors[word] += 1
    known = len(precursors)

    def p(prev, word):
        low = (max(precursors[word] - d, 0) + d * known / (known + 1)) / len(seen)
        if not total[prev]:
            return low
        return max(seen[prev, word] - d, 0) / total[prev] + d * followers[prev] / total[prev] * low
    return p, set(precursors), set(total)


CORPUS = ["the cat sat on the mat", "the cat ate the rat", "a cat sat\non a mat", "the " * 30, None, " ",
          "on the mat the cat sat", "rat\u3000cat"]


@pytest.mark.parametrize("heavy", [3, 10_000])
@pytest.mark.parametrize("same", [True, False])
def test_bigram_losses_equal_counting(spark, monkeypatch, heavy, same):
    monkeypatch.setattr(evaluation, "HEAVY", heavy)
    texts = CORPUS if same else ["the cat sat", "unknown words here", "the unknown the cat", "", None, "mat on"]
    p, _, _ = plain_bigram_model(CORPUS)
    schema = "id int, text string"
    corpus_df = spark.createDataFrame(list(enumerate(CORPUS)), schema)
    texts_df = corpus_df if same else spark.createDataFrame(list(enumerate(texts)), schema)
    got = {r.id: r for r in evaluation.bigram_losses(
        texts_df, "id", "text", None if same else corpus_df).collect()}
    assert set(got) == set(range(len(texts)))
    for i, text in enumerate(texts):
        words = (text or "").split()
        costs = [-math.log(p(prev, word)) for prev, word in zip(["", *words], words)]
        assert got[i].n_tokens == len(words)
        if words:
            assert got[i].loss == pytest.approx(sum(costs) / len(costs))
        else:
            assert got[i].loss is None


def test_pairs_of_bigrams_are_not_left_on_disk(spark, tmp_path, monkeypatch):
    """What stays for the result is one row per text and slice."""
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    texts = spark.createDataFrame([(i % 3, text) for i, text in enumerate(CORPUS)], "id int, text string")
    assert evaluation.bigram_losses(texts, "id", "text").count() == 3
    assert [path.name.partition("-")[0] for path in (tmp_path / "quern").iterdir()] == ["shares"]


def losses_by_counting(texts, corpus):
    """Unigram and bigram loss of each text, by plain counting."""
    p, _, _ = plain_bigram_model(corpus)
    seen = Counter(word for text in corpus for word in (text or "").split())
    mass = sum(seen.values()) + len(seen)
    for text in texts:
        words = (text or "").split()
        one = [-math.log((seen[word] + 1) / mass) for word in words]
        two = [-math.log(p(prev, word)) for prev, word in zip(["", *words], words)]
        yield [sum(costs) / len(costs) if costs else None for costs in (one, two)]


@pytest.mark.parametrize("given", ["table", "condition", "none"])
def test_losses_over_many_chunks_and_buckets(spark, monkeypatch, given):
    """Chunks and buckets of a few bytes, so that most words and pairs meet in others than their own."""
    for name, size in (("CHUNK_BYTES", 30), ("WORD_BYTES", 50), ("PAIR_BYTES", 20)):
        monkeypatch.setattr(pairs, name, size)
    texts = CORPUS + [f"w{i % 7} the w{i % 5}\u2003w{i % 3} \x1c cat w{i % 7}" for i in range(60)]
    corpus = [text for i, text in enumerate(texts) if given == "none" or i % 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    corpus_of = {"table": docs.filter("id % 3 != 0"), "condition": F.col("id") % 3 != 0, "none": None}[given]
    one, two = ({r.id: r.loss for r in run(docs, "id", "text", corpus_of).collect()}
                for run in (evaluation.unigram_losses, evaluation.bigram_losses))
    expected = list(losses_by_counting(texts, corpus))
    assert [one[i] for i in range(len(texts))] == [pytest.approx(x) for x, _ in expected]
    assert [two[i] for i in range(len(texts))] == [pytest.approx(x) for _, x in expected]


def test_losses_of_repeated_and_null_keys(spark):
    texts = spark.createDataFrame(
        [(None, "a b"), (None, "a"), (1, "b b"), (1, None), (2, "a b")], "id int, text string")
    for run in (evaluation.unigram_losses, evaluation.bigram_losses):
        # NULL is not in the corpus: the condition isn't true for it.
        rows = {r.id: (r.n_tokens, r.loss) for r in run(texts, "id", "text", F.col("id") > 0).collect()}
        assert {key: n for key, (n, _) in rows.items()} == {None: 3, 1: 2, 2: 2}
        same = {r.id: r.loss for r in run(texts, "id", "text", texts.filter("id > 0")).collect()}
        assert {key: loss for key, (_, loss) in rows.items()} == pytest.approx(same)


def test_corpus_without_words_gives_no_unigram_losses(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    rows = evaluation.unigram_losses(texts, "id", "text", texts.limit(0)).collect()
    assert {(r.id, r.loss, r.n_tokens) for r in rows} == {(1, None, 2), (2, None, 0)}
    for run in (evaluation.unigram_losses, evaluation.bigram_losses):
        assert run(texts.limit(0), "id", "text", texts).collect() == []
        assert run(texts.limit(0), "id", "text").collect() == []


def test_held_out_losses_read_every_text_twice(spark, tmp_path, monkeypatch):
    """Once for the size of all, once to number the words, whatever the models and their buckets."""
    from quern.plans import queries
    read, texts = tmp_path / "read", spark.range(20).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c"), "id").alias("text"))

    def noted(batches):
        for batch in batches:
            with open(read, "a") as file:
                file.write("x" * batch.num_rows)
            yield batch

    monkeypatch.setattr(queries, "_docs", lambda *_: texts.mapInArrow(noted, texts.schema))
    assert queries.QUERIES["perplexity_held_out"](spark, "").count() == 4
    assert read.stat().st_size == 2 * 20


def test_long_series_of_words_travel_once(spark):
    """A chunk sends a word, and a pair of words, once, however often they come."""
    texts = spark.createDataFrame([(i, "on and " * 5000) for i in range(8)], "id int, text string").coalesce(1)
    coded = evaluation.code_texts(texts, "id", "text")
    sent = coded.words.collect()
    assert [len(pairs.unpack(row.place, "<u4")[0]) for row in sent] == [3]
    counted = evaluation.pair_counts(coded)
    told = counted.filter("bucket is not null").collect()
    assert sorted(n for row in told for n in pairs.unpack(row.seen, "<i8")[0]) == [8, 39_992, 40_000]
    coded.drop()


def test_bigram_probabilities_add_up():
    p, words, contexts = plain_bigram_model(CORPUS)
    for prev in [*contexts, "never seen"]:
        assert sum(p(prev, word) for word in [*words, "unknown"]) == pytest.approx(1)


def test_empty_corpus_gives_no_losses(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    rows = evaluation.bigram_losses(texts, "id", "text", texts.limit(0)).collect()
    assert {(r.id, r.loss, r.n_tokens) for r in rows} == {(1, None, 2), (2, None, 0)}


def test_bigrams_predict_held_out_documents_better(spark, data):
    from quern.plans.queries import QUERIES
    told = {(r.model, r.held_out): r.perplexity for r in QUERIES["perplexity_held_out"](spark, data).collect()}
    assert told["bigram", True] < told["unigram", True]
    assert told["bigram", False] < told["unigram", False]
