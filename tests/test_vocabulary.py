"""Labels, windows and audits on a merging vocabulary, against the library itself."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quern.functions import vocabulary as columns
from quern.operators import vocabulary
from quern.plans import jobs, tables
from quern.plans.queries import QUERIES

PATH = tables.public_vocabulary()
WORDS = tables.public_vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def md5(ids):
    return hashlib.md5(" ".join(map(str, ids)).encode()).hexdigest()


def test_labels_of_continued_documents(spark, data, library):
    """A label is decided by whether the bytes of the tokens before it reach the border."""
    split = {r.doc_id: r for r in tables.continuations(tables.documents(spark, data)).collect()}
    rows = QUERIES["vocabulary_labels"](spark, data).collect()
    assert len(rows) == len([r for r in split.values() if r.prompt is not None])
    apart = 0
    for row in rows:
        prompt, rest = split[row.doc_id].prompt, split[row.doc_id].completion
        ids, head = ids_of(library, prompt + rest)[:2048], ids_of(library, prompt)[:2048]
        # This vocabulary writes one visible character per byte.
        at, border, labels, straddling = 0, len(prompt.encode()), [], 0
        for i in ids:
            size = len(library.id_to_token(i))
            labels.append(-100 if at < border else i)
            straddling += at < border < at + size
            at += size
        assert (row.n_ids, row.prompt_tokens, row.ids_md5) == (len(ids), len(head), md5(ids))
        assert row.prompt_is_prefix == (ids[:len(head)] == head)
        assert row.labels_md5 == md5(labels) and row.straddling == straddling
        assert row.trained == sum(label != -100 for label in labels)
        apart += not row.prompt_is_prefix
    assert 0 < apart < len(rows)


@pytest.mark.parametrize("rule", columns.RULES)
def test_rules_differ_at_the_border_only(spark, library, rule):
    texts = spark.createDataFrame(
        [(1, "The inter", "national word"), (2, "A line.\n", "Next"), (3, "x " * 30, " y"), (4, "", "all"),
         (5, "nothing follows", ""), (6, None, "x"), (7, "é" * 5 + "日", "本語 text")],
        "k int, p string, c string")
    rows = {r.k: r for r in vocabulary.labels(texts, PATH, ["k"], "p", "c", 20, rule).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 7}
    for k, p, c in [tuple(r) for r in texts.collect() if r.k in rows]:
        whole = library.encode(p + c, add_special_tokens=False)
        ids, row = whole.ids[:20], rows[k]
        assert row.input_ids == ids and row.attention_mask == [1] * len(ids)
        masked = [label == -100 for label in row.labels]
        assert [i for i, m in zip(ids, masked) if not m] == [x for x in row.labels if x != -100]
        assert masked == sorted(masked, reverse=True)
        inside = [b <= len(p) for _, b in whole.offsets[:20]]
        touching = [a < len(p) for a, _ in whole.offsets[:20]]
        head = ids_of(library, p)[:20]
        want = {"train": inside, "mask": touching, "count": [i < len(head) for i in range(len(ids))]}
        assert masked == want[rule], (k, rule)
    assert rows[1].straddling == 1 and not rows[1].prompt_is_prefix
    assert rows[4].prompt_tokens == 0 and rows[2].prompt_is_prefix
    with pytest.raises(ValueError):
        columns.completion_labels(PATH, F.lit("a"), F.lit("b"), 5, "other")


def test_roundtrip_of_documents(spark, data, library):
    docs = {r.doc_id: r.text for r in tables.documents(spark, data).collect()}
    rows = QUERIES["vocabulary_roundtrip"](spark, data).collect()
    assert {r.doc_id for r in rows} == {i for i, text in docs.items() if text is not None}
    for row in rows:
        text = docs[row.doc_id]
        ids = ids_of(library, text)
        kept = library.decode(ids[:1024], skip_special_tokens=False)
        tokens = [library.id_to_token(i) for i in ids[:1024]]
        assert (row.n_tokens, row.decoded_chars, row.cut) == (len(tokens), len(kept), len(ids) >= 1024)
        assert row.same == (kept == text) and row.kept_same
        assert row.newline_tokens == sum("Ċ" in t for t in tokens)
        assert row.space_tokens == sum("Ġ" in t for t in tokens)
    assert {r.same for r in rows} == {True, False}


def test_roundtrip_that_loses_and_cuts_that_split(spark):
    texts = spark.createDataFrame([(1, "Hello World"), (2, "日本語" * 3), (3, ""), (4, None), (5, "‍👩‍👩‍👧")],
                                  "k int, t string")
    kept = {r.k: r for r in vocabulary.roundtrip(texts, PATH, ["k"], "t", 3).collect()}
    assert set(kept) == {1, 2, 3, 5}
    assert kept[1].same and not kept[1].cut and not kept[1].partial
    assert kept[2].partial and kept[2].kept_same and not kept[2].same
    assert kept[3].same and kept[3].n_tokens == 0
    lost = {r.k: r for r in vocabulary.roundtrip(texts, WORDS, ["k"], "t").collect()}
    assert not lost[1].same and not lost[1].kept_same  # lower case only


class Counting:
    """A tokenizer that notes how much it encodes."""
    def __init__(self, made):
        self.made, self.sizes = made, []

    def __getattr__(self, name):
        return getattr(self.made, name)

    def encode(self, text, **options):
        self.sizes.append(len(text))
        return self.made.encode(text, **options)


def test_long_texts_are_not_encoded_to_their_end(data, spark, library, monkeypatch):
    counting = Counting(library)
    monkeypatch.setattr(columns, "load", lambda path: counting)
    assert columns.splits_at_blanks(PATH)
    row = columns.labelled(PATH, "some words " * 100, "and more of them " * 20_000, 50, columns.MASK)
    assert len(row["input_ids"]) == 50 and sum(counting.sizes) < 5_000
    texts = [r.text for r in tables.documents(spark, data).collect() if r.text]
    texts += ["a  b   c " * 300, "x" * 900, "1 2 3 " * 300, "é <|endoftext|> a " * 200, "it's we'll a b " * 99, "\n a b\t c" * 99]
    for text in texts:
        whole = library.encode(text, add_special_tokens=False)
        for limit in (1, 7, 100, 1024):
            head = columns.encode_head(PATH, text, limit)
            assert head.ids[:limit] == whole.ids[:limit] and head.offsets[:limit] == whole.offsets[:limit]
            assert (len(head) > limit) == (len(whole) > limit)
    columns.splits_at_blanks.cache_clear()


def test_windows_complete_characters(library):
    texts = ["日本語テキスト 👩‍👩‍👧‍👦 é", "plain words", "a�b 日��", "", "𝔘𝔫𝔦" * 4, "�" * 6]
    for text in texts:
        ids = ids_of(library, text)
        for size in (1, 2, 3, 5, 100):
            parts = [ids[at:at + size] for at in range(0, len(ids), size)]
            made = columns.decoded_windows(PATH, parts)
            assert len(made) == len(parts) and "".join(made) == text, (text, size)


def test_tokens_and_masks(spark, data, library):
    rows = QUERIES["vocabulary_tokens"](spark, data).collect()
    samples = {r.doc_id: r for r in tables.document_samples(tables.documents(spark, data)).collect()}
    eos = library.token_to_id("<|endoftext|>")
    for row in rows:
        s = samples[row.doc_id]
        code = {"completion": s.original_code, "bug_fix": s.fixed_code}.get(s.type) or s.code
        ids = [*ids_of(library, code), eos]
        assert (row.original_tokens, row.ids_md5, row.truncated) == (len(ids), md5(ids[:2048]), len(ids) > 2048)
    trained = QUERIES["vocabulary_masks"](spark, data).collect()
    pairs = {(r.conv_id, r.turn): r.code for r in tables.dialogue_pairs(tables.table(spark, data, "conversations")).collect()}
    assert len(trained) == len(pairs)
    for row in trained[:200]:
        assert row.text == pairs[row.conv_id, row.turn].strip() + "\n```" and row.has_newline
    with pytest.raises(ValueError):
        columns.token_id(PATH, "<no such token>")


def test_jobs_with_a_vocabulary(spark, tmp_path, library):
    rows = [{"type": "code_comment", "instruction": "Add numbers", "code": f"def add{i}(a, b):\n    return a + b"}
            for i in range(5)] + [{"type": "code_comment", "instruction": "i", "code": " "}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    source = f"{tmp_path}/a.jsonl"
    stats = jobs.tokens_job(spark, source, f"{tmp_path}/tokens", vocabulary=PATH).first()
    sizes = [len(ids_of(library, row["code"])) + 1 for row in rows[:5]]
    assert (stats.samples, stats.total_tokens, stats.skipped) == (5, sum(sizes), 1)
    kept = spark.read.parquet(f"{tmp_path}/tokens/tokens").orderBy("source_line").first()
    assert kept.input_ids == [*ids_of(library, rows[0]["code"]), library.token_to_id("<|endoftext|>")]
    report = jobs.masks_job(spark, source, f"{tmp_path}/masks", vocabulary=PATH).first()
    assert report.samples == 6 and report.trained > 40 and report.space_tokens > 0
    report = jobs.audit_job(spark, source, f"{tmp_path}/audit", vocabulary=PATH).first()
    assert (report.texts, report.same, report.cut) == (6, 6, 0)
