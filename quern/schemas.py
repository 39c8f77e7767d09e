"""Declared schemas of the tables that jobs read and write."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRINGS = T.ArrayType(T.StringType())
INTS = T.ArrayType(T.IntegerType())

REPO_LISTING = _struct(
    repo=T.StringType(), updated_at=T.TimestampType(), stars=T.LongType(), forks=T.LongType(),
    pushed_at=T.TimestampType(), language=T.StringType(),
)
CRAWL_STATE = _struct(repo=T.StringType(), updated_at=T.TimestampType())
REPO_CONTENTS = _struct(
    repo=T.StringType(), path=T.StringType(), type=T.StringType(), encoding=T.StringType(),
    content=T.StringType(),
)
MANIFEST = _struct(
    file_path=T.StringType(), original_size=T.LongType(), cleaned_size=T.LongType(),
    line_count=T.IntegerType(), function_count=T.IntegerType(), imports=STRINGS,
    cleaned_at=T.TimestampType(), python_version=T.StringType(),
)
# What a run knows of every file of a tree; ``run`` is the one that cleaned it.
INPUTS = _struct(
    file_path=T.StringType(), original_size=T.LongType(), content_md5=T.StringType(),
    outcome=T.StringType(), run=T.IntegerType(),
)
REJECTS = _struct(
    stage=T.StringType(), key=T.StringType(), reason=T.StringType(), detail=T.StringType(),
    at=T.TimestampType(),
)
SAMPLE = _struct(
    type=T.StringType(), instruction=T.StringType(), code=T.StringType(),
    original_code=T.StringType(), fixed_code=T.StringType(),
)
TOKENISED = _struct(
    source_line=T.LongType(), type=T.StringType(), input_ids=INTS, instruction=T.StringType(),
    n_tokens=T.IntegerType(), original_tokens=T.IntegerType(), truncated=T.BooleanType(),
)
EVAL_CASE = _struct(case_id=T.LongType(), instruction=T.StringType(), expected=STRINGS)
LOSS = _struct(sample_id=T.LongType(), loss=T.DoubleType(), n_tokens=T.LongType())

# What the Python-source stages return (see functions/pysource.py).
FUNCTION_DEF = _struct(
    ord=T.IntegerType(), name=T.StringType(), args=STRINGS, docstring=T.StringType(),
    comments=T.StringType(), top=T.BooleanType(), start=T.IntegerType(), length=T.IntegerType(),
)
CLASS_DEF = _struct(
    ord=T.IntegerType(), name=T.StringType(), methods=STRINGS, docstring=T.StringType(),
    top=T.BooleanType(), start=T.IntegerType(), length=T.IntegerType(),
)
LINT = dict(
    syntax_ok=T.BooleanType(), error_line=T.IntegerType(), error=T.StringType(),
    failed=T.BooleanType(), code_lines=T.IntegerType(),
)
OUTLINE = dict(
    function_count=T.IntegerType(), imports=STRINGS, docstring=T.StringType(),
    functions=T.ArrayType(FUNCTION_DEF), classes=T.ArrayType(CLASS_DEF),
)
LINTED = _struct(**LINT)
OUTLINED = _struct(error=T.StringType(), **OUTLINE)
CLEANED = _struct(**LINT, text=T.StringType(), line_count=T.IntegerType(), **OUTLINE)
SNIPPET = _struct(
    syntax_ok=T.BooleanType(), top_kinds=STRINGS, import_count=T.IntegerType(),
    top_level_defs=T.IntegerType(),
)
DECODED = _struct(text=T.StringType(), error=T.StringType())
