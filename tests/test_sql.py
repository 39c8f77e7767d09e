"""The library in SQL text, and trees of files."""

import ast

import pytest
from pyspark.sql import functions as F

from quern.functions import naming, sql
from quern.sources import files, sinks

SOURCE = '''
class A:
    """Doc   of A"""
    def one(self, x): return x
    def two(self): pass

# about get
def get_thing(a, b):
    return 1

async def later(): pass

class Empty: pass
'''


@pytest.fixture
def sources(spark):
    rows = [("a.py", SOURCE), ("bad.py", "def ("), ("none.py", None), ("zero.py", "x = '\\0'"), ("é.py", "def é(): return 'ü'")]
    sql.register(spark)
    return spark.createDataFrame(rows, "file_path string, source string")


def test_definitions_of_functions(spark, sources):
    rows = spark.sql("SELECT file_path, d.* FROM {files} f, LATERAL definitions(f.source, 'function') d",
                     files=sources)
    assert rows.columns == ["file_path", "node_ord", "name", "docstring", "top", "code", "args", "comments"]
    got = {(r.file_path, r.name): r for r in rows.collect()}
    assert set(got) == {("a.py", "get_thing"), ("a.py", "one"), ("a.py", "two"), ("é.py", "é")}
    assert got["a.py", "get_thing"].args == ["a", "b"] and got["a.py", "get_thing"].comments == "about get"
    assert not got["a.py", "one"].top and got["é.py", "é"].code == "def é(): return 'ü'"


def test_definitions_of_classes(spark, sources):
    rows = spark.sql("SELECT d.* FROM {files} f, LATERAL definitions(f.source, 'class') d", files=sources)
    assert rows.columns[-1] == "methods"
    assert {r.name: r.methods for r in rows.collect()} == {"A": ["one", "two"], "Empty": []}


def test_sources_without_a_line_of_the_kind_are_not_parsed(monkeypatch):
    parsed, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda text, *more: parsed.append(text) or parse(text, *more))
    found = sql.Definitions()
    none = [*found.eval("def f(): pass\nx = 'class A'  # class B", "class"),
            *found.eval("class A: pass\nasync def f(): pass", "function")]
    before = len(parsed)
    names = [row[1] for row in found.eval("class A: pass", "class")]
    after = len(parsed)
    monkeypatch.undo()
    assert (none, before, names, after) == ([], 0, ["A"], 1)


@pytest.mark.parametrize("kind, word, end, node", [
    ("class", "class", "", ast.ClassDef), ("function", "def", "()", ast.FunctionDef)])
def test_no_definition_is_missed(kind, word, end, node):
    one = f"{word} A{end}: pass"
    texts = [one, f"\\\n{one}", f"\x0c{one}", f"{word}\\\n A{end}: pass", f"if 1:\n\t{one}", f"x = 1\r{one}"[6:],
             f"x = '''\n'''\n{one}", f"@d\n{one}", f"{word} {word}_{end}: pass", f"x=1;{one}", f"if 1: {one}",
             f"'''\n{one}\n'''", f"﻿{one}", f"x = 1 \\\n{one}", f"async {word} A{end}: pass", f"x = 1\x0c{one}"]
    for text in texts:
        try:
            want = [n.name for n in ast.walk(ast.parse(text)) if isinstance(n, node)]
        except SyntaxError:
            want = []
        assert [row[1] for row in sql.Definitions().eval(text, kind)] == want, text


def test_definitions_do_not_travel_one_source_at_a_time(spark, sources):
    queries = {"class": sql.class_samples(sources, 3, 42), "function": sql.function_samples(sources, 5, 5, 42)}
    for kind, query in queries.items():
        plan = query._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan, kind


@pytest.mark.parametrize("call", [
    "definitions(f.source, 'module')", "definitions(f.source, f.file_path)", "definitions(1, 'class')"])
def test_wrong_arguments_fail_when_analysed(spark, sources, call):
    with pytest.raises(Exception, match="argument"):
        spark.sql("SELECT d.* FROM {files} f, LATERAL " + call + " d", files=sources)


def test_instructions_equal_the_columns(spark, sources):
    names = ["get", "get_name", "set_x", "is_ok", "other_name", "test_é", "", "g", "to_it's"]
    rows = [(n, args) for n in names for args in ([], ["a"], ["a", "b_c", "d", "e", "f", "g"])]
    df = spark.createDataFrame(rows, "name string, args array<string>")
    got = df.select(
        naming.function_instruction("name", "args").alias("a"), F.expr("function_instruction(name, args)").alias("b"),
        naming.class_instruction("name", "args").alias("c"), F.expr("class_instruction(name, args)").alias("d"))
    assert all(r.a == r.b and r.c == r.d for r in got.collect())
    assert spark.sql(r"SELECT collapse_spaces(' a \n\t b　') AS x").first().x == "a b"


def test_trees_are_written_and_read(spark, tmp_path):
    rows = [("a.py", "x"), ("b/c.py", "é\n"), ("b/../d.py", ""), ("./b/e.txt", "t"), ("b/f.py", None)]
    df = spark.createDataFrame(rows, "file_path string, source string").repartition(3)
    for _ in range(2):
        assert sinks.write_tree(df, f"{tmp_path}/tree") == 5
    found = {r.file_path: bytes(r.content) for r in files.source_tree(spark, f"{tmp_path}/tree").collect()}
    assert found == {"a.py": b"x", "b/c.py": "é\n".encode(), "d.py": b"", "b/f.py": b""}
    assert sinks.write_tree(df.limit(0), f"{tmp_path}/none") == 0
    out = spark.createDataFrame([("../x.py", "x")], "file_path string, source string")
    with pytest.raises(Exception, match="leaves the root"):
        sinks.write_tree(out, f"{tmp_path}/tree")


def test_every_file_of_a_tree_is_found(spark, tmp_path, monkeypatch):
    from quern.plans import jobs
    from quern.sources import lines, trees
    monkeypatch.setattr(trees, "PART_FILES", 2)
    root = tmp_path / "raw"
    (root / "p" / "_q").mkdir(parents=True)
    body = "".join(f"n{i} = {i}\n" for i in range(12))
    for name in ("a.py", "p/__init__.py", "p/_q/.hidden.py", "p/x.pyc", "p/b.PY", "p/c.py"):
        (root / name).write_text(body)
    (root / "p" / "empty.py").write_bytes(b"")
    want = {"a.py", "p/__init__.py", "p/_q/.hidden.py", "p/c.py", "p/empty.py"}
    found = files.source_tree(spark, str(root))
    assert {r.file_path for r in found.collect()} == want
    parts = trees.TreeReader({"path": f"file://{root}", "pattern": "*.py"}).partitions()
    assert [len(part.paths) for part in parts] == [2, 2, 1]
    report = jobs.clean_job(spark, str(root), f"{tmp_path}/out").first()
    assert (report.total, report.passed, report.too_short) == (5, 4, 1)
    (tmp_path / "none").mkdir()
    assert files.source_tree(spark, f"{tmp_path}/none").count() == 0
    monkeypatch.setattr(lines, "readable", lambda uri: False)
    assert {r.file_path for r in files.source_tree(spark, str(root)).collect()} == {"a.py", "p/c.py"}
