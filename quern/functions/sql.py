"""The library in SQL text: functions and table functions that a session registers.

``definitions(source, kind)`` is a Python table function: with ``LATERAL`` it gives a row for
every function or class of a source.  ``analyze`` fixes its columns by the kind when the query is
analysed.  Its rows travel pickled, many sources at a time; over Arrow each source would be a batch of
its own, which takes longer than parsing.  The instruction texts are SQL functions, which Spark puts into the plan as expressions.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quern.functions import pysource
from quern.functions.naming import LISTED_METHODS, VERB_BY_PREFIX
from quern.functions.text import SPACE_CLASS

STRINGS = T.ArrayType(T.StringType())
KINDS = {
    "function": [("args", STRINGS), ("comments", T.StringType())],
    "class": [("methods", STRINGS)],
}
# What finds each kind, and what begins the line of one: a source without such a line has none.
_FOUND = {"function": pysource.functions_of, "class": pysource.classes_of}
_BEGUN = {
    kind: re.compile(rf"(?:\A|[\n\r])[ \t\f]*{word}\b")
    for kind, word in (("function", "def"), ("class", "class"))
}


class Definitions:
    """Rows (node_ord, name, docstring, top, code, and args and comments or methods).

    A NULL source, or one that Python cannot parse, has no rows.
    """

    @staticmethod
    def analyze(source: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if source.isTable or source.dataType != T.StringType():
            raise Exception("the first argument is a source text")
        if not kind.isConstantExpression or kind.value not in KINDS:
            raise Exception(f"the second argument is one of {', '.join(map(repr, KINDS))}")
        schema = T.StructType().add("node_ord", "integer").add("name", "string").add(
            "docstring", "string").add("top", "boolean").add("code", "string")
        for name, of in KINDS[kind.value]:
            schema = schema.add(name, of)
        return AnalyzeResult(schema)

    def eval(self, source: str, kind: str):
        if source is None or not _BEGUN[kind].search(source):
            return []
        with pysource.quiet():
            try:
                tree = ast.parse(source)
            except Exception:
                return []
            own = [name for name, _ in KINDS[kind]]
            return [
                (one["ord"], one["name"], one["docstring"], one["top"],
                 source[one["start"]:one["start"] + one["length"]].strip(), *(one[name] for name in own))
                for one in _FOUND[kind](source, tree)
            ]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _function_instruction() -> str:
    cases = "\n".join(
        f"WHEN startswith(name, {_quoted(prefix)}) THEN concat({_quoted(verb + ' ')}, replace("
        f"CASE WHEN name = {_quoted(prefix)} THEN name ELSE substr(name, {len(prefix) + 1}) END, '_', ' '), tail)"
        for prefix, verb in VERB_BY_PREFIX.items()
    )
    tail = "CASE WHEN size(args) > 0 THEN concat('，参数为 ', array_join(args, ', ')) ELSE '' END"
    told = "CASE WHEN size(args) > 0 THEN concat('，接收参数 ', array_join(args, ', ')) ELSE '，无需参数' END"
    return (
        f"CASE {cases} ELSE concat('实现函数 ', replace(name, '_', ' '), {told}) END"
    ).replace("tail)", f"{tail})")


FUNCTIONS = {
    "collapse_spaces(text STRING)": f"trim(regexp_replace(text, r'(?U)[{SPACE_CLASS}]+', ' '))",
    "function_instruction(name STRING, args ARRAY<STRING>)": _function_instruction(),
    "class_instruction(name STRING, methods ARRAY<STRING>)": (
        "concat('定义类 ', replace(name, '_', ' '), CASE WHEN size(methods) = 0 THEN '' ELSE concat('，包含方法 ', "
        f"array_join(slice(methods, 1, {LISTED_METHODS}), '、'), CASE WHEN size(methods) > {LISTED_METHODS} "
        "THEN concat(' 等 ', CAST(size(methods) AS STRING), ' 个方法') ELSE '' END) END)"
    ),
}


def register(spark: SparkSession) -> None:
    """Makes ``definitions`` and the functions above known to the session."""
    spark.udtf.register("definitions", F.udtf(Definitions, useArrow=False))
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")


def _picked(kind: str, columns: str, cap: int, seed: int) -> str:
    """At most ``cap`` definitions of a file, drawn by the seeded key that the samples use."""
    key = f"md5(concat_ws('|', '{seed}', file_path, '{kind}', d.node_ord))"
    return f"""
SELECT file_path, d.node_ord, d.code, {columns},
  row_number() OVER (PARTITION BY file_path ORDER BY {key}, d.node_ord) AS pick
FROM {{files}} AS f, LATERAL definitions(f.source, '{kind}') AS d"""


def function_samples(files: DataFrame, cap: int, least: int, seed: int) -> DataFrame:
    """(file_path, node_ord, instruction, code) of the functions in files (file_path, source)."""
    register(files.sparkSession)
    rows = _picked(
        "function", "d.docstring, d.comments, function_instruction(d.name, d.args) AS named", cap, seed)
    return files.sparkSession.sql(f"""
WITH picked AS ({rows}),
told AS (
  SELECT *, collapse_spaces(coalesce(nullif(docstring, ''), nullif(comments, ''), named)) AS told
  FROM picked WHERE pick <= {cap}
)
SELECT file_path, node_ord, CASE WHEN length(told) < {least} THEN named ELSE told END AS instruction, code
FROM told""", files=files)


def class_samples(files: DataFrame, cap: int, seed: int) -> DataFrame:
    """(file_path, node_ord, instruction, code) of the classes in files (file_path, source)."""
    register(files.sparkSession)
    rows = _picked("class", "d.docstring, class_instruction(d.name, d.methods) AS named", cap, seed)
    return files.sparkSession.sql(f"""
WITH picked AS ({rows})
SELECT file_path, node_ord, collapse_spaces(coalesce(nullif(docstring, ''), named)) AS instruction, code
FROM picked WHERE pick <= {cap}""", files=files)
