import ast
import glob
import sysconfig
import warnings

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.functions import pysource
from quern.functions.slices import slices
from quern.operators import cleaning

LIBRARY = sorted(glob.glob(sysconfig.get_paths()["stdlib"] + "/*.py"))


@pytest.fixture(scope="module")
def library():
    texts = []
    for path in LIBRARY:
        with open(path, encoding="utf-8") as f:
            texts.append(f.read())
    return texts


@pytest.mark.parametrize("source, lines", [
    ("x='''a\nb\nc'''", 1), ("x=f'''a\nb{1}\nc'''", 3), ("# c\n\nx = 1; y = 2\n", 1),
    ('"""doc"""\n', 1), ("", 0), ("def f():\n    # c\n    return 1\n", 2),
])
def test_code_lines(source, lines):
    assert pysource._lint(source)["code_lines"] == lines


def test_imports():
    tree = ast.parse("from .foo.bar import x\nfrom . import y\nimport a.b, c as d\n")
    outline = pysource.outline_of("x\n" * 3, tree)
    assert outline["imports"] == ["a", "c", "foo"]


@pytest.mark.parametrize("source, want", [
    ("x = 1 #c", "x = 1 # c\n"), ("#", "#\n"), ("#   a  \n", "# a\n"), ("##a\n", "# #a\n"),
    ("#!/bin/sh\n#!x\n", "#!/bin/sh\n# !x\n"), ("#coding: utf-8\n", "#coding: utf-8\n"),
    ("s = '#x'\n", "s = '#x'\n"), ("if x:\n\ty = 1   \n\n\n", "if x:\n    y = 1\n"),
    ("x\t=\t1\n", "x = 1\n"), ("s = 'a\tb'\n", "s = 'a  b'\n"),
    ("a = 1 + \\\n    2\n", "a = 1 +\\\n    2\n"),
])
def test_tidy(source, want):
    assert pysource._tidied(list(pysource._tokens(source)))[0] == want


def test_tidying_keeps_the_number_of_code_lines(library):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for text in library:
            tokens = list(pysource._tokens(text))
            tidied, same_lines = pysource._tidied(tokens)
            if same_lines:
                again = pysource._code_lines(pysource._tokens(tidied))
                assert again == pysource._code_lines(tokens)


def test_definitions_come_in_the_order_of_a_full_walk(library):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for text in library:
            tree = ast.parse(text)
            wanted = (*pysource.IMPORTS, *pysource.DEFINITIONS)
            full = [n for n in ast.walk(tree) if isinstance(n, wanted)]
            assert [n for n in pysource._statements(tree) if isinstance(n, wanted)] == full


def test_offsets_cut_the_same_segments_as_the_parser(library):
    own = 'é = "ü"\ndef f(ä):\n    return "é" + ä; x = 1\nclass Ö:\n    def g(self): return "😀"\n'
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for text in [own, *library]:
            if "\f" in text:
                continue
            tree = ast.parse(text)
            outline = pysource.outline_of(text, tree)
            for kind, key in [(ast.FunctionDef, "functions"), (ast.ClassDef, "classes")]:
                nodes = [n for n in ast.walk(tree) if isinstance(n, kind)]
                for d, node in list(zip(outline[key], nodes, strict=True))[:5]:
                    cut = text[d["start"]:d["start"] + d["length"]]
                    assert cut == ast.get_source_segment(text, node)


def test_comment_block():
    lines = "x = 1\n## first\n\n#\n# second #\n\ndef f(): pass".splitlines()
    assert pysource._comment_block(lines, 7) == "first second #"
    assert pysource._comment_block(["@d", "def f(): pass"], 2) == ""


def test_snippet():
    facts = pysource._snippet("import a\nfrom b import c\ndef f():\n    import d\n")
    assert facts == dict(
        syntax_ok=True, top_kinds=["import", "import", "function"], import_count=3,
        top_level_defs=1,
    )
    assert pysource._snippet("def (")["import_count"] == 999


def test_bad_rows_never_fail(spark):
    sources = ["def f(:\n", "x = 1\0\n", "(" * 400 + ")" * 400, "  x = 1\n y", "", None]
    rows = spark.createDataFrame(
        [(str(i), s, None, 0) for i, s in enumerate(sources)],
        "file_path string, source string, read_error string, original_size bigint",
    )
    done = {r.file_path: r for r in cleaning.clean(rows).collect()}
    assert {done[k].outcome for k in "0123"} <= {"syntax_error", "cleaning_error"}
    assert done["0"].error_line == 1
    assert done["4"].outcome == "too_short"


def test_reading_by_declaration(spark):
    body = "".join(f"x{i} = 'é'\n" for i in range(10))
    raw = {
        "plain": body.encode(), "bom": b"\xef\xbb\xbf" + body.encode(),
        "latin": b"# -*- coding: latin-1 -*-\n" + body.encode("latin-1"),
        "third": b"\n\n# coding: latin-1\n" + body.encode(),
        "bad": body.encode("latin-1"), "unknown": b"# coding: nope\nx = 1\n",
        "crlf": body.replace("\n", "\r\n").encode(),
    }
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in raw.items()],
                                 "file_path string, content binary")
    read = {r.file_path: r for r in cleaning.read_sources(rows).collect()}
    assert read["plain"].source == read["bom"].source == read["crlf"].source == body
    assert read["latin"].source.endswith(body)
    assert read["third"].source.endswith(body)
    assert read["bad"].source is None and "Error" in read["bad"].read_error
    assert read["unknown"].read_error.startswith("SyntaxError")
    outcomes = {r.file_path: r.outcome for r in cleaning.clean(cleaning.read_sources(rows)).collect()}
    assert outcomes["bad"] == outcomes["unknown"] == "cleaning_error"
    assert outcomes["latin"] == outcomes["bom"] == "passed"


def test_schema_matches_what_the_stage_returns():
    assert set(pysource._cleaner(0)("def f():\n    return 1\n", None)) <= set(schemas.CLEANED.names)


def odd_variants(text):
    yield text, None
    yield text, text.replace("#", "#admin", 2)
    yield text.replace("\n\n", "  \n\n", 3), None
    yield text + "#end", None


PLAIN = [
    'x = """a\n# b  \n"""  # c\ny = 1\n', '"""a\n\nb"""; z = 2\n', "#!x\n#y\nx = 1", "s = '#x'\n", "é = 1  #ü\n",
    '"""a\nb""" + """c\n\nd"""\n', "x = 1\n\n\n", "#coding: utf-8\nx = 1\n", "x = [\n  1,\n  # c\n]\n", "",
]


def test_plain_sources_are_cleaned_as_by_the_lexer(library, monkeypatch):
    """Also that most of them are, since the lexer takes most of the time."""
    plainly, cleaner = pysource._plainly_cleaned, pysource._cleaner(0)
    own = [*PLAIN, 'x = f"{1}" #c\n', '"a""b"\n', '"a" B"b"\n', "x = 1 + \\\n  2\n", "if x:\n\ty = 1\n"]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for text, redacted in [pair for text in [*own, *library[::12]] for pair in odd_variants(text)]:
            monkeypatch.setattr(pysource, "_plainly_cleaned", plainly)
            got = cleaner(text, redacted)
            monkeypatch.setattr(pysource, "_plainly_cleaned", lambda *_: None)
            assert got == cleaner(text, redacted), text

    def no_lexer(text):
        raise AssertionError("the lexer was called")
    monkeypatch.setattr(pysource, "_plainly_cleaned", plainly)
    monkeypatch.setattr(pysource, "_tokens", no_lexer)
    assert not any(cleaner(text, None)["failed"] for text in PLAIN)


def test_batches_are_taken_in_slices(spark):
    """Python holds the values of one slice, however large a batch is."""
    seen = [len(part) for (part,) in slices(pa.array(["x"] * 1000))]
    assert max(seen) <= 64 and sum(seen) == 1000
    rows = spark.range(1000).repartition(1).select("id", F.concat(F.lit("x = "), "id").alias("source"))
    told = rows.select("id", pysource.outline(F.col("source")).alias("o"), pysource.parses(F.col("source")).alias("p"))
    assert told.filter("p and o.function_count = 0 and o.error is null").count() == 1000
