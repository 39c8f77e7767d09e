import pytest
from pyspark.sql import functions as F

from quern.operators import selection

BODY = "def f(a):\n    value = a + 1\n    other = value * 2\n    return other" + "\n" + "    # x" * 12
GOOD = "Return a doubled value"


def judged(spark, rows):
    items = [(i, *row) for i, row in enumerate(rows, 1)]
    df = spark.createDataFrame(
        items, "source_line long, type string, instruction string, code string"
    )
    return selection.judge(df)


CASES = [
    (("completion", GOOD, BODY), "not_code_comment"),
    ((None, GOOD, BODY), "not_code_comment"),
    (("code_comment", " \u3000", BODY), "empty_instruction"),
    (("code_comment", None, BODY), "empty_instruction"),
    (("code_comment", GOOD, "\n "), "empty_code"),
    (("code_comment", "short", BODY), "instruction_too_short"),
    (("code_comment", "x" * 161, BODY), "instruction_too_long"),
    (("code_comment", GOOD, "def f():\n    return 1"), "code_too_short"),
    (("code_comment", GOOD, BODY + "\n#" + "y" * 2000), "code_too_long"),
    (("code_comment", GOOD, "x = 1\n" * 40), "no_indentation"),
    (("code_comment", "TODO write this", BODY), "bad_instruction_pattern"),
    (("code_comment", GOOD, BODY + "\n    assert a"), "bad_code_pattern"),
    (("code_comment", GOOD, BODY + "\n    return ("), "invalid_python"),
    (("code_comment", GOOD, "x = 1\n" + BODY), "not_function_or_class"),
    (("code_comment", GOOD, "import a\nimport b\nimport c\nimport d\n" + BODY), "too_many_imports"),
    (("code_comment", GOOD, BODY), None),
    (("code_comment", GOOD, BODY.replace("def", "async def").replace("\n", "\r\n")), None),
]


def test_first_failing_reason(spark):
    got = judged(spark, [row for row, _ in CASES]).orderBy("source_line").collect()
    assert [r.reason for r in got] == [reason for _, reason in CASES]
    assert got[-1].shape == "function" and "\r" not in got[-1].code


def test_score_goldens(spark):
    function = 'import a\ndef f(x):\n    """Doc."""\n' + "    x = x + 1\n" * 20 + "    return x"
    klass = "import a, b\nimport c\nimport d\nclass C:\n" + "    value = 1234567\n" * 6
    rows = judged(spark, [
        ("code_comment", "i" * 30, function), ("code_comment", "i" * 130, klass),
    ]).orderBy("source_line").collect()
    assert [(r.shape, r.score) for r in rows] == [("function", 125), ("class", 55)]


def pool_of(spark, shapes, score=lambda i: i % 7):
    rows = [(i, score(i), shape, f"code {i}") for i, shape in enumerate(shapes, 1)]
    return spark.createDataFrame(rows, "source_line long, score int, shape string, code string")


@pytest.mark.parametrize("functions, classes, others, want", [
    (50, 1, 0, {"function": 9, "class": 1}), (3, 50, 0, {"function": 3, "class": 7}),
    (50, 50, 0, {"function": 8, "class": 2}), (2, 1, 0, {"function": 2, "class": 1}),
    (1, 1, 40, {"function": 1, "class": 1, "other": 8}),
])
def test_quotas(spark, functions, classes, others, want):
    pool = pool_of(spark, ["function"] * functions + ["class"] * classes + ["other"] * others)
    for parts in (1, 6):
        keys = selection.balanced_keys(pool.repartition(parts), 10)
        got = {r["shape"]: r["count"] for r in keys.groupBy("shape").count().collect()}
        assert got == want


def test_best_scores_win_and_ties_go_to_the_first_line(spark):
    pool = pool_of(spark, ["function"] * 40)
    lines = {r.source_line for r in selection.balanced_keys(pool, 10).collect()}
    best = sorted(range(1, 41), key=lambda i: (-(i % 7), i))[:10]
    assert lines == set(best)


def test_shuffle_is_a_seeded_permutation(spark):
    pool = pool_of(spark, ["function"] * 40)
    one = [r.source_line for r in selection.select_balanced(pool, 20).collect()]
    two = [r.source_line for r in selection.select_balanced(pool.repartition(5), 20).collect()]
    other = [r.source_line for r in selection.select_balanced(pool, 20, seed=7).collect()]
    assert one == two and set(one) == set(other) and one != other and one != sorted(one)


def test_candidates_ignore_the_instruction(spark):
    rows = [("code_comment", GOOD, BODY), ("code_comment", GOOD + " again", BODY)]
    kept = selection.candidates(judged(spark, rows)).collect()
    assert [(r.source_line, r.instruction) for r in kept] == [(1, GOOD)]


def test_report_of_nothing(spark):
    none = judged(spark, [("completion", GOOD, BODY)])
    pool = selection.candidates(none)
    row = selection.selection_report(none, pool, selection.balanced_keys(pool, 5)).first()
    assert (row.total_seen, row.filtered_count, row.selected_count) == (1, 0, 0)
    assert (row.score_min, row.score_max, row.score_avg) == (0, 0, 0.0)
    assert row.skip_reasons == {"not_code_comment": 1} and row.shape_counts == {}


def test_rejected_rows_are_not_parsed(spark):
    rows = judged(spark, [("code_comment", "short", "def (")])
    assert rows.select(F.col("reason")).first().reason == "instruction_too_short"
