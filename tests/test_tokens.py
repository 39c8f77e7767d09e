import pytest
from pyspark.sql import functions as F

from quern.functions import bytes as byte_tokens
from quern.operators import audit, formats, tokens

TEXTS = ["abc", "é€😀\n    x", "", "a" * 3000, "é" * 1500, "\x00\x7fz"]


def samples_of(spark, rows):
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)],
        "id int, type string, instruction string, code string, original_code string, "
        "fixed_code string",
    )


def test_encode_and_decode_are_bytes(values):
    ids = values(lambda x: byte_tokens.encode(x, 2048, add_eos=False), TEXTS)
    assert ids == [list(t.encode()[:2048]) for t in TEXTS]
    back = values(lambda x: byte_tokens.decode(byte_tokens.encode(x, 10_000)), TEXTS)
    assert back == TEXTS


def test_the_cut_drops_the_end_id_unless_kept(values):
    cut = values(lambda x: byte_tokens.encode(x, 5), ["abcd", "abcde", ""])
    assert cut == [[97, 98, 99, 100, 256], [97, 98, 99, 100, 101], [256]]
    kept = values(lambda x: byte_tokens.encode(x, 5, keep_eos=True), ["abcde"])
    assert kept == [[97, 98, 99, 100, 256]]


@pytest.mark.parametrize("prompt, want", [
    (3, [-100, -100, -100, 4, 5]), (7, [-100] * 5), (0, [1, 2, 3, 4, 5]), (-2, [1, 2, 3, 4, 5]),
    (5, [-100] * 5),
])
def test_labels(spark, prompt, want):
    row = spark.range(1).select(byte_tokens.completion_labels(
        F.array(*[F.lit(i) for i in range(1, 6)]), F.lit(prompt)
    ).alias("labels"))
    assert row.first().labels == want


ROWS = [
    ("completion", "i", "c", "o", None), ("completion", "i", "c", "", None),
    ("bug_fix", "", "c", "o", "f"), ("bug_fix", None, "c", None, None),
    (None, "i", "c", "o", "f"), ("code_comment", "i", " \n\u3000", None, None),
    ("code_comment", "i", None, "o", None),
]


def test_code_by_type_and_blank_rows(spark):
    df = samples_of(spark, ROWS)
    code = [r.code for r in tokens.with_code(df).orderBy("id").collect()]
    assert code == ["o", "c", "f", "c", "c", " \n\u3000", ""]
    done = tokens.tokenise(df, ["id"]).orderBy("id").collect()
    assert [r.id for r in done] == [0, 1, 2, 3, 4]
    assert [r.instruction for r in done] == ["i", "i", None, None, "i"]
    assert done[4].type == "unknown" and done[0].input_ids == [111, 256]
    assert [r.key for r in tokens.blank_rejects(df, "id").orderBy("key").collect()] == ["5", "6"]


def test_stats_agree_with_the_ids(spark):
    df = samples_of(spark, ROWS + [("code_comment", "i", "x" * 5000, None, None)])
    stats = tokens.token_stats(tokens.sizes(df)).first()
    report = tokens.length_report(tokens.tokenise(df)).first()
    for name in ("samples", "total_tokens", "max_tokens", "min_tokens", "avg_tokens"):
        assert stats[name] == report[name]
    assert (stats.skipped, stats.truncated, stats.max_tokens) == (2, 1, 2048)
    empty = tokens.token_stats(tokens.sizes(df.limit(0))).first()
    assert (empty.samples, empty.max_tokens, empty.avg_tokens) == (0, 0, 0)


def test_any_tokenizer_can_be_plugged_in(spark):
    def load():
        from tokenizers import Tokenizer, models, pre_tokenizers

        vocabulary = {"[UNK]": 0, "def": 1, "f": 2, "(": 3, ")": 4}
        tokenizer = Tokenizer(models.WordLevel(vocabulary, unk_token="[UNK]"))
        tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()

        def encode(text):
            if "boom" in text:
                raise ValueError(text)
            return tokenizer.encode(text).ids
        return encode
    df = samples_of(spark, [
        ("code_comment", "i", "def f ( ) x", None, None), ("code_comment", "i", "boom", None, None),
    ])
    made = tokens.tokenise_with(df, load, eos_id=9, key=["id"], limit=4)
    done = sorted(made.collect(), key=lambda r: r.id)
    assert [(r.id, r.input_ids, r.truncated, r.original_tokens, r.error) for r in done] == [
        (0, [1, 2, 3, 4], True, 6, None), (1, None, None, None, "ValueError: boom"),
    ]
    rejects = {(r.key, r.reason): r.detail for r in tokens.token_rejects(made, "id").collect()}
    assert rejects == {
        ("0", "cut_to_limit"): "4 of 6 tokens", ("1", "tokenizer_error"): "ValueError: boom"
    }
    stats = tokens.token_stats(made).first()
    assert (stats.samples, stats.errors, stats.truncated) == (1, 1, 1)
    with pytest.raises(ValueError):
        tokens.tokenise_with(df, load, eos_id=None)


def test_masks(spark):
    df = spark.createDataFrame(
        [(1, [5, 6], [1, 0]), (2, [5, 6], [1]), (3, [5], None), (4, [], []), (5, None, None)],
        "id int, input_ids array<int>, attention_mask array<int>",
    )
    got = {r.id: r.attention_mask for r in tokens.model_inputs(df, ["id"]).collect()}
    assert got == {1: [1, 0], 2: [1, 1], 3: [1]}
    bare = tokens.model_inputs(df.drop("attention_mask"), ["id"]).collect()
    assert all(r.attention_mask == [1] * len(r.input_ids) for r in bare)


def test_padding(spark):
    rows = [(i * 10, list(range(1, 1 + i % 5 + 1))) for i in range(11)]
    df = spark.createDataFrame(rows, "id long, input_ids array<int>").repartition(4)
    got = {r.id: r for r in tokens.padded_batches(df, "id", rows=4, pad_id=0).collect()}
    for start in range(0, 11, 4):
        batch = rows[start:start + 4]
        longest = max(len(ids) for _, ids in batch)
        for key, ids in batch:
            assert got[key].input_ids == ids + [0] * (longest - len(ids))
            assert got[key].attention_mask == [1] * len(ids) + [0] * (longest - len(ids))
            assert got[key].batch_id == start // 4


def test_texts(spark):
    df = samples_of(spark, [
        ("code_comment", " do it ", "\nx = 1\n### End of Code ###", None, None),
        ("code_comment", "", "x", None, None), ("code_comment", "x", None, None, None),
        ("completion", "do", "x", None, None),
    ])
    built = formats.prompt_completion(df)
    first = built.orderBy("id").first()
    assert first.prompt == "### Instruction:\ndo it\n\n### Response:\n"
    assert first.completion == "x = 1\n### End of Code ###\n"
    counts = formats.format_counts(built, "prompt", "completion").first()
    assert (counts.before, counts.skipped, counts.kept) == (3, 2, 1)
    head = "### Instruction:\ndo it\n\n### Response:\n```python\nx = 1\n"
    single = formats.drop_empty(formats.single_text(df), "text").collect()
    assert [r.text for r in single] == [head + "### End of Code ###\n```"]
    marked = formats.drop_empty(formats.marked_text(df, "<e>"), "text").first().text
    assert marked == head + "### End of Code ###\n```\n### End of Code ###<e>"
    once = formats.drop_empty(formats.marked_text(df, "<e>", strip_marker=True), "text").first()
    assert once.text == head + "```\n### End of Code ###<e>"
    with pytest.raises(ValueError):
        formats.require_rows(formats.drop_empty(formats.single_text(df.filter("id = 1")), "text"))


def test_masked_samples(spark):
    df = samples_of(spark, [("code_comment", "é", "x = 1\n    y", None, None),
                            ("code_comment", "i" * 3000, "x", None, None)])
    done = formats.completion_masks(df, ["id"]).orderBy("id").collect()
    head = "### Instruction:\né\n\n### Response:\n```python\n".encode()
    whole = head + "x = 1\n    y\n```".encode()
    assert done[0].input_ids == list(whole)
    assert done[0].labels == [-100] * len(head) + list(whole[len(head):])
    assert done[0].prompt_is_prefix and done[0].attention_mask == [1] * len(whole)
    assert set(done[1].labels) == {-100} and len(done[1].labels) == 2048
    part = audit.trained_part(formats.completion_masks(df, ["id"]), ["id"]).orderBy("id").collect()
    assert part[0].has_newline and part[0].has_indent and part[0].newline_tokens == 2
    assert part[1].trained == 0 and not part[1].has_newline


def test_roundtrip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    rows = audit.roundtrip(df, ["id"], "text").orderBy("id").collect()
    assert all(r.kept_same for r in rows)
    assert [r.same for r in rows] == [len(text.encode()) <= 2048 for text in TEXTS]
    summary = audit.roundtrip_summary(audit.roundtrip(df, ["id"], "text")).first()
    assert (summary.texts, summary.kept_same, summary.same_share) == (6, 6, 1.0)
    assert [r.cut for r in rows] == [False, False, False, True, True, False]
    assert rows[1].has_newline and rows[1].has_indent


def test_format_tokens(spark):
    df = spark.createDataFrame(
        [(["Ċ", "ĊĠ", "Ġdef", "ĠĠĠĠ", "▁x", " ", "\n", "ĊĊ", "y"],)], "t array<string>"
    )
    row = df.select(audit.format_token_counts("t").alias("c")).first().c
    assert (row.newline_tokens, row.space_tokens, row.indent_tokens) == (4, 5, 3)
