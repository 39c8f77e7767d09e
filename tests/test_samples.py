import ast

import pytest
from pyspark.sql import functions as F

from quern.functions import naming
from quern.functions.text import collapse_spaces
from quern.operators import cleaning, samples


def built(spark, files, **limits):
    rows = spark.createDataFrame(list(files.items()), "file_path string, source string")
    return samples.check(samples.extract(rows, **limits))


@pytest.mark.parametrize("name, args, want", [
    ("get_user", ["a", "b"], "获取 user，参数为 a, b"),
    ("__init__", ["self"], "实现函数 init ，接收参数 self"),
    ("run", [], "运行 run"), ("is_ok", ["x"], "判断是否为 ok，参数为 x"),
    ("settle", [], "设置 tle"), ("unknown_thing", [], "实现函数 unknown thing，无需参数"),
])
def test_function_instruction(spark, name, args, want):
    row = spark.createDataFrame([(name, args)], "n string, a array<string>")
    got = row.select(collapse_spaces(naming.function_instruction("n", "a")).alias("t")).first().t
    assert got == want


def test_blanks_of_a_raw_function_instruction(spark):
    row = spark.createDataFrame([("get_user", ["a"])], "n string, a array<string>")
    got = row.select(naming.function_instruction("n", "a").alias("t")).first().t
    assert got == "获取  user，参数为 a"


@pytest.mark.parametrize("methods, want", [
    ([], "定义类 My Class"), (["a", "b"], "定义类 My Class，包含方法 a、b"),
    (list("abcdefg"), "定义类 My Class，包含方法 a、b、c、d、e 等 7 个方法"),
])
def test_class_instruction(spark, methods, want):
    row = spark.createDataFrame([("My_Class", methods)], "n string, m array<string>")
    assert row.select(naming.class_instruction("n", "m").alias("t")).first().t == want


SOURCE = '''import os


# Count the things
# in a list
def count(items):
    return sum(1 for _ in items)


async def fetch(x):
    return await x


# not taken
@os.cached
def documented(a):
    """ok"""
    value = a + 1
    return value


class Box:
    """Holds one thing and gives it back."""

    def get_thing(self):
        return self.thing if self.thing else None
'''


def test_instructions_and_code(spark):
    got = {r.instruction: r for r in built(spark, {"r/a_b.py": SOURCE}).collect()}
    assert set(got) == {
        "实现 a b 模块的完整功能", "Count the things in a list",
        "实现函数 documented，接收参数 a", "Holds one thing and gives it back.",
        "获取 thing，参数为 self",
    }
    assert got["实现函数 documented，接收参数 a"].code.startswith("def documented")
    for row in got.values():
        ast.parse(row.code)
        assert row.code.endswith("\n### End of Code ###")


def test_caps_per_file(spark):
    many = "".join(f"def f{i}(a):\n    return a + {i} + 100000\n\n\n" for i in range(12))
    many += "".join(f"class C{i}:\n    name = 'a long enough name'\n\n\n" for i in range(6))
    files = {f"{n}.py": many.replace("100000", f"{n}00000") for n in range(1, 5)}
    counts = built(spark, files).groupBy("file_path", "kind").count().collect()
    assert {(r["kind"], r["count"]) for r in counts} == {("file", 1), ("function", 5), ("class", 3)}
    picks = built(spark, files).filter("kind = 'function'").groupBy("file_path").agg(
        F.sort_array(F.collect_list("node_ord")).alias("o")
    ).select("o").distinct().count()
    assert picks > 1
    all_of_them = built(spark, files, functions_per_file=12).filter("kind = 'function'")
    assert all_of_them.count() == 48


def test_a_file_with_one_function_collapses_with_it(spark):
    body = "def only(a):\n" + "".join(f"    a = a + {i}\n" for i in range(20)) + "    return a\n"
    checked = built(spark, {"x.py": body})
    kept = samples.distinct_samples(checked).collect()
    assert [r.kind for r in kept] == ["file"]
    counts = {r.outcome: r.samples for r in samples.sample_counts(checked).collect()}
    assert counts == {"generated": 2, "written": 1, "duplicate": 1}


def test_first_file_wins_and_partitions_do_not_matter(spark):
    body = "def same(a):\n    return a * 1000000000 + 12345\n"
    files = {f"{n:02}.py": body for n in range(30)}
    rows = spark.createDataFrame(list(files.items())[::-1], "file_path string, source string")
    for parts in (1, 8):
        checked = samples.check(samples.extract(rows.repartition(parts)))
        assert [r.file_path for r in samples.distinct_samples(checked).collect()] == ["00.py"]


def test_reasons(spark):
    files = {
        "empty.py": "", "broken.py": "def (", "small.py": "x = 1\n",
        "large.py": "x = 1\n" * 1400, "long.py": "x = 1\n" * 800,
        "short.py": "def f(): pass\n",
    }
    got = {(r.file_path, r.kind): r.reason for r in built(spark, files).collect()}
    assert got == {
        ("empty.py", "file"): "empty_or_unreadable_file", ("broken.py", "file"): "ast_parse_failed",
        ("small.py", "file"): "file_too_small", ("large.py", "file"): "file_too_large",
        ("long.py", "file"): "too_long_skipped", ("short.py", "file"): "file_too_small",
        ("short.py", "function"): "code_too_short",
    }


def test_kept_and_rejected_make_the_whole(spark):
    checked = built(spark, {"a.py": SOURCE, "b.py": SOURCE, "c.py": "x"})
    total = checked.count()
    counts = {r.outcome: r.samples for r in samples.sample_counts(checked).collect()}
    rejected = samples.rejects(checked).count()
    assert counts["written"] + counts["duplicate"] + rejected == total


def test_clean_outcomes_cover_all(spark):
    rows = spark.createDataFrame(
        [("a.py", SOURCE), ("b.py", "def ("), ("c.py", "x = 1"), ("d.py", SOURCE + "# a@b.cd\n")],
        "p string, t string",
    )
    cleaned = cleaning.clean(cleaning.as_sources(rows, "p", "t"))
    counts = cleaning.outcome_counts(cleaned).first().asDict()
    assert counts == dict(
        total=4, passed=2, syntax_error=1, too_short=1, cleaning_error=0, skipped=2
    )
    texts = {r.file_path: r.source for r in cleaning.passed(cleaned).collect()}
    assert texts["a.py"] == SOURCE and texts["d.py"].endswith("# <REDACTED_EMAIL>\n")


def test_redaction_that_breaks_the_code_is_a_cleaning_error(spark):
    lines = "".join(f"x{i} = 1\n" for i in range(10))
    rows = spark.createDataFrame([("a.py", lines + "y = a @ b.c@d.e\n")], "p string, t string")
    row = cleaning.clean(cleaning.as_sources(rows, "p", "t")).first()
    assert row.outcome == "cleaning_error" and row.source is None
