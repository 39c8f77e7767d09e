"""Token counts, pieces, languages, secrets and quality, against brute force and the libraries."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quern.llm import (
    language_id, pieces, quality_classifier, secret_scan, sentence_pieces, token_counts,
)
from quern.llm.common import Memo, table, tokenizer_path
from quern.llm.queries import QUERIES

ODD = [
    None, "", " ", "\n\n", "a", "the  cat\n\n sat", " \t x \x1c y　z ", "naïve Ωσς’s don't 'll",
    "<|endoftext|>", "a <|endoftext|>b", "漢字かな 😀👩‍👩‍👧 é", "x" * 5000, "ab " * 3000,
    "a b \u0085c", "İstanbul ŉ ǅ", "\r\n tab\tend ", "!!! ...  ???",
]


@pytest.fixture(scope="module")
def gpt():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_memo_is_bounded():
    memo = Memo(len, 3)
    assert [memo[x] for x in ("a", "bb", "ccc", "dddd", "e" * 200)] == [1, 2, 3, 4, 200]
    assert len(memo) <= 3 and "e" * 200 not in memo


def test_token_counts_equal_the_library(spark, data, documents, gpt):
    got = {r.doc_id: r for r in token_counts.token_counts(documents(ODD)).collect()}
    for i, text in enumerate(ODD, 1):
        want = len(gpt.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes) == (want, len((text or "").encode())), text
        assert got[i].over_limit == (want > 1024)
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    for row in QUERIES["op4_token_counts"](spark, data).collect():
        assert row.n_tokens == len(gpt.encode(texts[row.doc_id], add_special_tokens=False).ids)


def test_pre_tokens_of_common_characters_equal_the_library(gpt):
    counter = token_counts.counter(tokenizer_path("byte_bpe_50k.json"))
    for c in map(chr, [10, *range(0x20, 0x7F), *range(0xA1, 0x250)]):
        for text in (c, f"a{c}b", f" {c}1", c + c, f"a {c}", f"{c} b", f"\n{c}", f"{c}\n\nx"):
            found = counter.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            assert counter.pre_tokens(text) == [text[a:b] for _, (a, b) in found]


def test_every_shortcut_token_is_one_token(gpt):
    whole = sorted(token_counts.counter(tokenizer_path("byte_bpe_50k.json")).whole)
    assert len(whole) > 40_000
    assert all(len(e.ids) == 1 for e in gpt.encode_batch(whole, add_special_tokens=False))


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def unigram():
    """The public pieces and scores, read by the library as a unigram model."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def all_paths(words, text):
    segment = "".join(pieces.segments_of(text))
    edges = words.edges(segment)

    def from_(start):
        if start == len(segment):
            yield 0.0, ()
            return
        for end, piece in edges[start]:
            score = words.scores[piece] if piece >= 0 else words.unknown_score
            ids = (piece,) if piece >= 0 else tuple(words.unknown_ids(segment[start]))
            for rest, tail in from_(end):
                yield score + rest, ids + tail
    return sorted(from_(0), key=lambda path: -path[0])


@pytest.mark.parametrize("text", ["the cat", "a  b", "é☃x", "in.\nThe", "aaaa b aa", " x", "x "])
def test_n_best_equals_all_segmentations(text):
    words = pieces.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    want = all_paths(words, text)
    for n in (1, 4, 12):
        made = sentence_pieces.encoder(tokenizer_path("piece_bpe_32k.model")).encode(text, n)
        assert [score for score, _ in made] == [score for score, _ in want[:n]]
        assert len({ids for _, ids in made}) == len(made)
        scored = dict((ids, score) for score, ids in want)
        for score, ids in made:
            assert scored[tuple(np.frombuffer(ids, "<i4").tolist())] == score


def test_n_best_equals_the_library(spark, data, unigram):
    encoder = sentence_pieces.encoder(tokenizer_path("piece_bpe_32k.model"))
    texts = [" ".join(r.text.split(" ")[:7]) for r in table(spark, data, "documents").limit(60).collect()]
    for text in texts:
        found = unigram.nbest_encode(text, nbest_size=8, return_type="proto")
        found = found.nbests if hasattr(found, "nbests") else found
        made = [score for score, _ in encoder.encode(text, 8)]
        assert made == pytest.approx([one.score for one in found], rel=1e-6)


def test_encoding_and_decoding_of_documents(spark, data, documents):
    docs = documents(ODD)
    coded = sentence_pieces.encode_documents(docs, 3)
    rows = {r.doc_id: r for r in coded.collect()}
    assert rows[1].ids is None and rows[2].ids == [[]]
    best = coded.select("doc_id", F.element_at("ids", 1).alias("ids"))
    back = {r.doc_id: r.text for r in sentence_pieces.decode_documents(best).collect()}
    assert [back[i] for i in range(1, len(ODD) + 1)] == ODD
    digest = QUERIES["op1_sentence_pieces"](spark, data).collect()
    assert digest and all(r.round_trip and r.scores == sorted(r.scores, reverse=True) for r in digest)


# ---------------------------------------------------------------- languages


def test_marginal_probability_equals_the_sum_over_segmentations():
    path = tokenizer_path("piece_bpe_32k.model")
    words = pieces.vocabulary(path)
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(words.size), 3).T)
    scorer = language_id.Scorer(path, ["a", "b", "c"], logs)
    for text in ("the cat", "été", "x☃y", "in.\nThe", "that,"):
        parts = scorer.parts(text)
        scorer.learn_segments(sorted(set(parts)))
        got = sum(scorer.rows[scorer.row_of[part]] for part in parts)
        want = np.zeros(3)
        for part in parts:
            total, edges = np.zeros((len(part) + 1, 3)), words.edges(part)
            total[0] = 1
            for start, end, piece in ((s, e, p) for s, es in enumerate(edges) for e, p in es):
                ids = [piece] if piece >= 0 else words.unknown_ids(part[start])
                total[end] += total[start] * np.exp(logs[ids].sum(axis=0))
            want += np.log(total[-1])
        assert got == pytest.approx(want)
        scorer.forget()


def test_long_texts_do_not_underflow():
    path = tokenizer_path("piece_bpe_32k.model")
    logs = np.log(np.full((pieces.vocabulary(path).size, 2), 1e-5) * [1, 2])
    langs, scores = language_id.Scorer(path, ["a", "b"], logs).predict(["漢☃x" * 3000])
    assert langs == ["b"] and scores == [1.0]


def test_languages_held_out(spark, data):
    docs = table(spark, data, "documents")
    rows = QUERIES["op2_language_id"](spark, data).join(docs.select("doc_id", "lang"), "doc_id")
    held = rows.filter("held_out").collect()
    assert len(held) > 20
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.collect())


def test_languages_of_odd_texts(spark, documents):
    docs = documents(["the cat sat on the mat " * 5] * 20 + ["le chat est sur la table " * 5] * 20)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") <= 20, "en").otherwise("fr"))
    odd = documents([None, "", "123 !", "the mat"]).withColumn("lang", F.lit(None).cast("string"))
    odd = odd.withColumn("doc_id", F.col("doc_id") + 100)
    got = {r.doc_id: (r.lang_pred, r.score)
           for r in language_id.language_predictions(docs.unionByName(odd)).collect()}
    assert [got[i][0] for i in (101, 102, 103, 104)] == ["und", "und", "und", "en"]
    assert got[101][1] == 0.0
    unknown = language_id.language_predictions(odd).collect()
    assert {r.lang_pred for r in unknown} == {"und"}
    assert language_id.language_predictions(odd.limit(0)).count() == 0


def plain_language(text, languages, logs, words):
    """Sums over all segmentations of every line, one end after the other."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    totals = []
    for j in range(len(languages)):
        total = 0.0
        for line in text.split("\n"):
            marked = "▁" + line.replace(" ", "▁")
            if marked == "▁":
                continue
            forward = [0.0] + [-math.inf] * len(marked)
            for end in range(1, len(marked) + 1):
                parts = []
                for start in range(max(0, end - words.longest), end):
                    piece = words.ids.get(marked[start:end])
                    if piece is not None:
                        parts.append(forward[start] + logs[piece, j])
                if not marked[end - 1:end] in words.ids:
                    parts.append(forward[end - 1] + sum(logs[i, j] for i in words.unknown_ids(marked[end - 1])))
                top = max(parts)
                forward[end] = top + math.log(sum(math.exp(p - top) for p in parts))
            total += forward[-1]
        totals.append(total)
    top = max(totals)
    share = 1 / sum(math.exp(t - top) for t in totals)
    return languages[totals.index(top)], share


def test_predictions_equal_plain_forward_sums(spark, data):
    from quern.llm.pieces import vocabulary
    docs = table(spark, data, "documents")
    path = tokenizer_path("piece_bpe_32k.model")
    languages, logs = language_id.learn(docs, path)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    texts = [None, "", "1 2", "a", "é", "𝔘x", "line\n\nother line", *[t[:300].strip() for t in texts if t and "  " not in t[:300]]]
    langs, scores = language_id.Scorer(path, languages, logs).predict(texts)
    for text, lang, score in zip(texts, langs, scores):
        want = plain_language(text, languages, logs, vocabulary(path))
        assert lang == want[0] and abs(score - want[1]) < 1e-6, text
    assert len(texts) > 30


def test_equal_languages_tie_to_the_first(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    from quern.llm.pieces import vocabulary
    logs = np.full((vocabulary(path).size, 3), -5.0)
    langs, scores = language_id.Scorer(path, ["a", "b", "c"], logs).predict(["some text"])
    assert langs == ["a"] and abs(scores[0] - 1 / 3) < 1e-9


def test_many_languages_and_null_ids(spark, documents):
    texts = [f"word{i % 700} other{i % 700}" for i in range(1400)]
    docs = documents(texts, [None, *range(1, 1400)]).withColumn(
        "lang", F.concat(F.lit("l"), F.element_at(F.split(F.element_at(F.split("text", " "), 1), "d"), 2)))
    rows = language_id.language_predictions(docs).collect()
    assert len(rows) == 1400 and all(r.held_out is not None for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    learned, _ = language_id.learn(docs, tokenizer_path("piece_bpe_32k.model"))
    assert len(learned) == 700 and len({r.lang_pred for r in rows}) > 100


# ---------------------------------------------------------------- secrets


def test_trigram_queries():
    query = secret_scan.trigram_query
    assert query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert query("[0-9a-f]{16,}") is True
    assert query("(abc|x.z)") is True
    assert query("(abc|bcd)e?") == ("or", (
        "abc", ("and", ("abc", "bce")), "bcd", ("and", ("bcd", "cde"))
    ))
    assert query("a.cde*fgh") == "fgh"
    assert query("[Aa][Bb]C") == "abc"


def test_every_match_satisfies_its_query():
    rng = random.Random(2)
    scanner = secret_scan.scanner(secret_scan.RULES)
    heads = ["password", "PassWd", "secret", "TOKEN", "api_key", "ApiKey", "AKIA", "ghp_", "eyJ"]
    texts = []
    for _ in range(800):
        parts = [rng.choice(heads), rng.choice(["", '"', " "]), rng.choice(":= "),
                 "".join(rng.choice("0aAfZ9._-/") for _ in range(rng.randint(0, 45)))]
        texts.append(" ".join(rng.choice(["x", "the"]) for _ in range(3)) + "".join(parts))
    found = scanner.spans(texts)
    for text, spans in zip(texts, found):
        want = sorted(
            (m.start(), place, m.end()) for place, (rule, pattern, _) in enumerate(scanner.rules)
            for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least
        )
        assert spans == want
    assert sum(map(bool, found)) > 100


def test_postings_are_the_texts_own_trigrams():
    rules = (secret_scan.Rule("a", "Straße[0-9]+"), secret_scan.Rule("b", "x(abc|bcd)y"),
             secret_scan.Rule("c", "(?i:kelvin)"), secret_scan.Rule("d", "(?ai:ABC)"))
    scanner = secret_scan.Scanner(rules)
    assert [query is True for _, _, query in scanner.rules] == [False, False, True, False]
    texts = ["", "Straße7", "strAßE", "xABCy", "xabcy", "ab", "c" * 9 + "bcd", "\0", "KELVIN", "\u212aelvin"]
    postings = scanner.postings(texts)
    for gram, found in postings.items():
        assert found.tolist() == [
            i for i, text in enumerate(texts) if gram.encode() in text.encode().lower()], gram
    kinds = [[scanner.rules[place][0].kind for _, place, _ in spans] for spans in scanner.spans(texts)]
    assert kinds == [[], ["a"], [], ["d"], ["b", "d"], [], [], [], ["c"], ["c"]]
    assert scanner.spans([]) == []
    queries = {rule.kind: query for rule, _, query in secret_scan.scanner(secret_scan.RULES).rules}
    assert queries["code_host"] is not True and queries["chat"] is not True and queries["hex"] is True


def test_secret_digest_of_odd_tables(spark, documents):
    assert secret_scan.secret_digest(documents(["a"]).limit(0)).count() == 0
    rows = secret_scan.secret_digest(documents(["f" * 16, "f" * 16, None], [4, 4, None], "spans string, n_hex int, x int"))
    assert sorted((str(r.doc_id), r.n_hex) for r in rows.collect()) == [("4", 1), ("4", 1), ("None", 0)]


def base_spans(text):
    rules = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                              re.I | re.A), 2, 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
    ]
    return sorted(
        (m.start(), place, f"{kind}:{m.start()}:{m.end()}", kind)
        for place, (kind, pattern, group, least) in enumerate(rules) for m in pattern.finditer(text)
        if len(m.group(group)) >= least
    )


def test_secret_digest_equals_plain_scanning(spark, data, documents):
    key = "AK" + "IA" + "ABCDEFGHIJ012345"
    texts = [None, "", key, f"é {key}{key} token = abcdefghijklmnop", "token=short token=" + "x" * 12,
             "ſecret=abcdefghijklmnop ToKen:abcdefghijKlmnop", "f" * 100_000, "password " + " " * 50_000]
    docs = table(spark, data, "documents").select("doc_id", "text").unionByName(
        documents(texts, [10**6 + i for i in range(len(texts))]).select("doc_id", "text"))
    want = {r.doc_id: base_spans(r.text or "") for r in docs.collect()}
    rows = secret_scan.secret_digest(docs).collect()
    assert len(rows) == len(want)
    for r in rows:
        spans = want[r.doc_id]
        text = ",".join(name for _, _, name, _ in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        kinds = [kind for *_, kind in spans]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, ("assign", "access", "hex")))
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_redaction(spark, documents):
    texts = [None, "", "a token=abcdefghijklmnop b", "f" * 20 + " x " + "e" * 16, "clean"]
    rows = secret_scan.redact_secrets(documents(texts)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [None, "", "a <SECRET> b", "<SECRET> x <SECRET>", "clean"]
    assert rows[0].n_words == 2


def test_whole_key_blocks_are_redacted(spark, documents):
    begin, end = (f"-----{side} RSA PRIVATE " + "KEY-----" for side in ("BEGIN", "END"))
    lines = ["MIIEvQ" + "aB3+/" * 11 + "xyz"] * 3
    body = "\n".join([*lines, "Qw9=="])
    info = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    texts = [
        f"a {begin}\n{body}\n{end} b", f"a {begin}\r\n{info}{body}\n{end}\nb",
        f"a {begin}\n{body}\nb c", f"a {begin}\n{info}{body}", f"a {begin}\n{lines[0]}\nQw9a\nb c",
        f'k = "{begin}\\n{lines[0]}\\n{lines[1]}\\n{end}\\n"', f'k = "{begin}\\n{lines[0]}\\nQw9="',
        f"a {begin} {' '.join(lines)} b c", f"{begin}\n{body}\n{end}\nmid\n{begin}\n{body}\n{end}",
        f"the line {begin} is a head\nb\n{begin}\n{body}\n{end} c", f"{begin}\n" * 3000,
    ]
    rows = secret_scan.redact_secrets(documents(texts)).orderBy("doc_id").collect()
    mask = "<SECRET>"
    assert [r.text for r in rows] == [
        f"a {mask} b", f"a {mask}\nb", f"a {mask}\nb c", f"a {mask}", f"a {mask}\nb c",
        f'k = "{mask}\\n"', f'k = "{mask}"', f"a {mask} b c", f"{mask}\nmid\n{mask}",
        f"the line {mask} is a head\nb\n{mask} c", f"{mask}\n" * 3000,
    ]


# ---------------------------------------------------------------- quality


def test_ordinal_gradient_by_differences():
    """A fit separates grades that a single word marks, and its tail probabilities are ordered."""
    rng = random.Random(5)
    texts, grades = [], []
    for _ in range(600):
        words = [f"w{rng.randint(0, 40)}" for _ in range(30)]
        grade = rng.randint(0, 2)
        words += {0: ["awful"], 1: ["!!"] * 6, 2: []}[grade]
        rng.shuffle(words)
        texts.append(" ".join(words))
        grades.append(grade)
    found = [quality_classifier.features(text) for text in texts]
    sizes = np.array([len(f) for f in found])
    flat = np.array(list(itertools.chain.from_iterable(found)))
    model = quality_classifier.fit(flat, sizes, np.array(grades))
    assert (np.diff(model.thresholds) > 0).all()
    above = model.grades(found)
    assert (np.diff(above, axis=1) <= 1e-12).all()
    predicted = (above >= 0.5).sum(axis=1)
    assert (predicted == np.array(grades)).mean() > 0.97


@pytest.mark.parametrize("parts, old, new, blank", [
    ("天地玄黄宇宙洪荒日月盈昃", "洪荒", "荒毒", ""), ("กขคงจฉชซญดตถ", "จฉ", "ฉฆ", ""), ("abcdefghij", "ef", "zf", ""),
    (["understand", "workers", "belong", "streams"], "understand", "understood", " "),
])
def test_marks_beyond_the_beginnings_of_words(parts, old, new, blank):
    """A mark deep in a text without blanks, or in the end of a word, separates grades."""
    rng = random.Random(7)

    def text(grade):
        drawn = blank.join([*(rng.choice(parts) for _ in range(40)), old, *(rng.choice(parts) for _ in range(9))])
        return drawn if grade else drawn.replace(old, new)
    grades = np.array([2 * rng.randint(0, 1) for _ in range(600)])
    found = [quality_classifier.features(text(grade)) for grade in grades]
    fitted, held = found[:400], found[400:]
    model = quality_classifier.fit(
        np.array(list(itertools.chain.from_iterable(fitted))), np.array(list(map(len, fitted))), grades[:400])
    assert ((model.grades(held)[:, 1] >= 0.6) == (grades[400:] == 2)).mean() > 0.95


def plain_features(text):
    words = (text or "").split()
    if not words:
        return [], []

    def bucket(name):
        return zlib.crc32(name.encode()) % quality_classifier.BUCKETS
    found = set()
    for word in words:
        plain = word.strip(quality_classifier.OUTER).lower()
        found |= {bucket("w:" + plain), bucket("p:" + plain[:3]), bucket("p:" + plain[:4])}
        if len(plain) > 16 or quality_classifier._UNSPACED.search(plain):
            found |= {bucket("g:" + plain[i:i + n]) for n in (2, 3) for i in range(len(plain) - n + 1)}
    total = len(words)
    shares = [
        ("capitals", sum(w.isupper() for w in words)),
        ("symbols", sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words)),
        ("bars", sum(w == "|" for w in words)),
        ("repeats", sum(a == b for a, b in zip(words, words[1:]))), ("distinct", len(set(words))),
    ]
    steps = [bucket(f"s:{name}:{math.ceil(10 * value / total)}") for name, value in shares]
    return sorted(found), [*steps, bucket(f"s:words:{min(12, total.bit_length())}")]


def test_grades_equal_a_plain_sum_of_weights(spark, documents):
    rng = np.random.default_rng(0)
    model = quality_classifier.Model(rng.normal(size=quality_classifier.BUCKETS), np.array([-0.4, 0.7]))
    texts = [None, "", " \n", "a", "The CAT | sat sat, on! it", "x" * 40 + " y", "中文字符 テスト", "word " * 30_000,
             "p. q; (r) \"s\"", "Über ßtraße ſ"] * 2
    rows = quality_classifier.quality(documents(texts, more="keep string, expected_grade int, p_keep int"), model)
    for row in rows.collect():
        found, steps = plain_features(texts[row.doc_id - 1])
        tails = [0.0, 0.0]
        if steps:
            scale = (len(found) + len(steps)) ** -0.25
            score = sum(scale * model.weights[i] for i in found) + sum(model.weights[i] for i in steps)
            tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert abs(row.expected_grade - sum(tails)) < 1e-9 and abs(row.p_keep - tails[1]) < 1e-9
        assert row.keep == (tails[1] >= 0.6)
    assert quality_classifier.quality(documents(["a"]).limit(0), model).count() == 0


def test_ratings_with_nulls_and_none_at_all(spark, documents):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (2, None, 1), (3, 1, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.grade) for r in quality_classifier.label_grades(labels).collect()} == {(1, 1), (4, 0)}
    docs = documents(["a b", "c d"])
    assert quality_classifier.fit_on(docs, quality_classifier.label_grades(labels.limit(0))) is None
    assert quality_classifier.fit_on(docs.limit(0), quality_classifier.label_grades(labels)) is None


def test_one_text_per_rated_id_is_fitted(spark, documents, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality_classifier, "fit", lambda flat, sizes_, grade: sizes.append(len(sizes_)))
    docs = documents(["a b"] * 50 + ["c d", "e f"], [1] * 50 + [2, 3])
    ratings = spark.createDataFrame([(1, 0), (2, 2), (3, 1)], "doc_id long, grade int")
    quality_classifier.fit_on(docs, ratings)
    assert sizes == [3]


def test_quality_of_documents(spark, data, documents):
    rows = QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.1")
    grades = quality_classifier.label_grades(table(spark, "/root/testdata/sf0.1", "labels"))
    judged = rows.join(grades, "doc_id").groupBy("grade").agg(
        F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r.grade: r.kept for r in judged}
    assert kept[2] > 0.98 and kept[0] < 0.1 and kept[1] < 0.1
    odd = quality_classifier.quality(documents([None, "", " \n", "a"]), None).orderBy("doc_id")
    assert [(r.p_keep, r.keep) for r in odd.collect()] == [(0, False)] * 3 + [(1, True)]
    whole = quality_classifier.quality(documents([None, "a b"]), None, whole=True).collect()
    assert [(r.doc_id, r.text, r.batch) for r in whole] == [(2, "a b", 1)]


def test_digests_of_empty_tables_and_clashing_columns(spark, documents):
    names = "n_pieces string, n_tokens int, scores int"
    docs = documents(["the cat", "the cat", None, ""], [3, 3, None, 4], names)
    for digest in (sentence_pieces.encoding_digest, token_counts.token_counts):
        rows = digest(docs).collect()
        assert len(rows) == 4 and digest(docs.limit(0)).count() == 0
        same = [tuple(r)[1:] for r in rows if r.doc_id == 3]
        assert same[0] == same[1]
        assert [tuple(r)[1:] for r in rows if r.doc_id is None] == [tuple(r)[1:] for r in rows if r.doc_id == 4]
