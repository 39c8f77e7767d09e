"""The only stages that leave the JVM: they need Python's own parser and lexer.

Each is an Arrow-batched UDF over one text column.  Rows that are already rejected are passed as
NULL and cost nothing.  One call per row returns every fact later steps need; code segments are
returned as offsets and cut out natively.  No exception of a single row fails a task.

The UDFs are marked non-deterministic only to stop the optimizer from copying the call into
pushed-down filters, which would parse each text twice.
"""

from __future__ import annotations

import ast
import gc
import io
import re
import sys
import tokenize
import warnings
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern import schemas
from quern.functions.slices import slices

# Fixed value: tokens that do not make a line a code line.
QUIET_TOKENS = frozenset({
    tokenize.ENCODING, tokenize.ENDMARKER, tokenize.INDENT, tokenize.DEDENT,
    tokenize.NEWLINE, tokenize.NL, tokenize.COMMENT,
})
# Fixed value: comments that declare the file's encoding are left as they are.
CODING_COMMENT = r"#.*coding[:=]\s*[-\w.]+"
IMPORTS = (ast.Import, ast.ImportFrom)
STATEMENT_FIELDS = frozenset({"body", "handlers", "cases", "orelse", "finalbody"})
DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
# Characters with which the lexer's positions or lines differ from those of the text.
UNUSUAL = re.compile("[\t\f\r\x0b\x1c-\x1e\x85\u2028\u2029]")
# Comments and strings of a source that parses, and what tells that they can't be found this way:
# a backslash or a quote outside of them.
LEXEMES = re.compile(
    r'#[^\n]*|"""(?:[^"\\]++|\\.|"(?!""))*+"""|"(?:[^"\\\n]++|\\.)*+"'
    r"|'''(?:[^'\\]++|\\.|'(?!''))*+'''|'(?:[^'\\\n]++|\\.)*+'|\\|\"|'", re.DOTALL)
CODE_LINE = re.compile(r"^ *[^ \n#]", re.MULTILINE)
BLANK_END = re.compile(r"[^\S\n]\n")


@contextmanager
def quiet():
    """Parsing without warnings, and without searches for cycles: trees have none, and are many objects."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            yield
    finally:
        if collecting:
            gc.enable()


def _tokens(text):
    return tokenize.generate_tokens(io.StringIO(text).readline)


def _code_lines(tokens):
    """Number of lines on which a token other than layout or a comment starts."""
    starts = (t.start[0] for t in tokens if t.type not in QUIET_TOKENS and t.string.strip())
    return len(set(starts))


def _problem(exc):
    return f"{type(exc).__name__}: {exc}"


def _parsed(text):
    """(tree, facts): `failed` marks errors other than a syntax error."""
    try:
        return ast.parse(text), dict(syntax_ok=True, failed=False)
    except SyntaxError as exc:
        return None, dict(syntax_ok=False, error_line=exc.lineno, error=exc.msg, failed=False)
    except Exception as exc:
        return None, dict(syntax_ok=False, error=_problem(exc), failed=True)


def _lint(text):
    tree, facts = _parsed(text)
    if tree is not None:
        try:
            facts["code_lines"] = _code_lines(_tokens(text))
        except Exception as exc:
            facts.update(error=_problem(exc), failed=True)
    return facts


def _spaced(comment, first_line):
    """A comment gets one blank after its hash sign."""
    if first_line and comment.startswith("#!") or re.match(CODING_COMMENT, comment):
        return comment
    return f"# {comment[1:].strip()}".rstrip()


def _spaced_comment(token):
    """Comments are spaced; other tokens stay as they are."""
    if token.type != tokenize.COMMENT:
        return token
    return token._replace(string=_spaced(token.string, token.start[0] == 1))


def _tidied(tokens):
    """(text, same_lines): spaced comments, no tabs, no trailing white space, one newline at the
    end.  `same_lines` tells that no line was split, so counts of lines still hold."""
    spaced = tokenize.untokenize(map(_spaced_comment, tokens))
    lines = spaced.splitlines()
    text = "\n".join([line.expandtabs(4).rstrip() for line in lines]).rstrip() + "\n"
    return text, len(lines) == spaced.count("\n") + (not spaced.endswith("\n"))


def _plain(text):
    """(code lines, comments, strings over several lines) of a source that parses, as the lexer tells
    them, comments and strings by their ends.  None for sources with tabs, odd line ends, continued
    lines, formatted strings or strings side by side, which need the lexer."""
    if UNUSUAL.search(text):
        return None
    comments, long_strings = [], []
    code_lines, last = len(CODE_LINE.findall(text)), -1
    for found in LEXEMES.finditer(text):
        start, end = found.span()
        if text[start] == "#":
            comments.append((start, end))
            continue
        prefix = text[max(start - 2, 0):start].lower()
        if end == start + 1 or prefix.endswith(("f", "t")) or prefix in ("fr", "tr"):
            return None
        if last >= 0 and not text[last:start].lower().rstrip("bru").strip(" "):
            return None
        last = end
        if "\n" in found[0]:
            long_strings.append((start, end))
            # No token starts on its further lines, unless one follows it on the last.
            rest = text[end:].partition("\n")[0].strip(" ") if end < len(text) else ""
            code_lines += bool(rest) and rest[0] != "#"
            code_lines -= len(CODE_LINE.findall(text, start + 1, end))
    return code_lines, comments, long_strings


def _plainly_tidied(text, comments):
    """The text of ``_tidied`` for a source that ``_plain`` can tell."""
    parts, at = [], 0
    for start, end in comments:
        parts += text[at:start], _spaced(text[start:end], "\n" not in text[:min(start, 1)])
        at = end
    lines = "".join([*parts, text[at:]]).split("\n")
    return "\n".join([line.rstrip() for line in lines]).rstrip() + "\n"


def _comment_block(lines, lineno):
    """Comment lines right above line `lineno`, oldest first; blank lines do not end the block."""
    found = []
    for at in range(lineno - 2, -1, -1):
        line = lines[at].strip()
        if line and not line.startswith("#"):
            break
        found.append(line.lstrip("#").strip())
    return " ".join(filter(None, reversed(found)))


def _statements(tree):
    """All statements, breadth first.  Expressions hold none, so they are not entered."""
    queue, fields = deque([tree]), {}
    while queue:
        node = queue.popleft()
        yield node
        kind = type(node)
        if kind not in fields:
            fields[kind] = [name for name in node._fields if name in STATEMENT_FIELDS]
        for name in fields[kind]:
            queue.extend(getattr(node, name))


class _Offsets:
    """Turns the parser's (line, UTF-8 column) positions into character offsets."""

    def __init__(self, text):
        self.rows = text.split("\n")
        self.starts = [0]
        for row in self.rows:
            self.starts.append(self.starts[-1] + len(row) + 1)

    def at(self, lineno, column):
        row = self.rows[lineno - 1]
        if not row.isascii():
            column = len(row.encode("utf-8")[:column].decode("utf-8"))
        return self.starts[lineno - 1] + column

    def span(self, node):
        start = self.at(node.lineno, node.col_offset)
        return dict(
            top=node.col_offset == 0, start=start,
            length=self.at(node.end_lineno, node.end_col_offset) - start,
        )


def _import_roots(node):
    if isinstance(node, ast.Import):
        return [alias.name.partition(".")[0] for alias in node.names]
    return [node.module.partition(".")[0]] if node.module else []


def _class(node, ord_, offsets):
    return dict(
        ord=ord_, name=node.name, docstring=ast.get_docstring(node),
        methods=[part.name for part in node.body if isinstance(part, ast.FunctionDef)],
        **offsets.span(node),
    )


def _function(node, ord_, lines, offsets):
    return dict(
        ord=ord_, name=node.name, docstring=ast.get_docstring(node),
        args=[arg.arg for arg in node.args.args],
        comments=_comment_block(lines, node.lineno), **offsets.span(node),
    )


def functions_of(text, tree):
    """The functions of one source, in the parser's breadth-first order."""
    lines, offsets = text.splitlines(), _Offsets(text)
    found = (node for node in _statements(tree) if isinstance(node, ast.FunctionDef))
    return [_function(node, at, lines, offsets) for at, node in enumerate(found)]


def classes_of(text, tree):
    """The classes of one source, in the parser's breadth-first order."""
    offsets = _Offsets(text)
    found = (node for node in _statements(tree) if isinstance(node, ast.ClassDef))
    return [_class(node, at, offsets) for at, node in enumerate(found)]


def outline_of(text, tree):
    """Counts, imports and the definitions of one source, in the parser's breadth-first order."""
    lines, offsets = text.splitlines(), _Offsets(text)
    functions, classes, roots, n_functions = [], [], set(), 0
    for node in _statements(tree):
        if isinstance(node, IMPORTS):
            roots.update(_import_roots(node))
        elif isinstance(node, ast.ClassDef):
            classes.append(_class(node, len(classes), offsets))
        elif isinstance(node, ast.FunctionDef):
            functions.append(_function(node, len(functions), lines, offsets))
        n_functions += isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef))
    return dict(
        function_count=n_functions, imports=sorted(roots), docstring=ast.get_docstring(tree),
        functions=functions, classes=classes,
    )


def _outline_or_error(text):
    try:
        return outline_of(text, ast.parse(text))
    except Exception as exc:
        return dict(error=_problem(exc))


def _plainly_cleaned(text, tree, redacted, min_code_lines):
    """What ``_cleaner`` gives for a source without the lexer; None if it takes the lexer.

    The definitions are where they were: only comments and blanks at the ends of lines changed.
    """
    plain = _plain(text)
    if plain is None:
        return None
    facts = dict(code_lines=plain[0], line_count=plain[0])
    if plain[0] < min_code_lines:
        return facts
    if redacted is not None:
        try:
            tree = ast.parse(redacted)
        except Exception:
            return None
        plain = _plain(redacted)
        if plain is None:
            return None
        facts["line_count"] = plain[0]
    _, comments, long_strings = plain
    source = text if redacted is None else redacted
    tidied = _plainly_tidied(source, comments)
    if any(BLANK_END.search(source, *span) for span in long_strings):
        tree = ast.parse(tidied)
    if tidied != text:
        facts["text"] = tidied
    return facts | outline_of(tidied, tree)


def _cleaner(min_code_lines):
    """Check, tidy and describe one source in one go.

    `redacted` is NULL if redaction changed nothing; the tokens are then used twice.  A text that
    was tidy already is not parsed again and is not sent back.  Most sources don't need the lexer.
    """
    def clean(text, redacted):
        tree, facts = _parsed(text)
        if tree is None:
            return facts
        try:
            plain = _plainly_cleaned(text, tree, redacted, min_code_lines)
            if plain is not None:
                return facts | plain
            tokens = list(_tokens(text))
            facts["code_lines"] = facts["line_count"] = _code_lines(tokens)
            if facts["code_lines"] < min_code_lines:
                return facts
            if redacted is not None:
                tokens = list(_tokens(redacted))
                facts["line_count"] = _code_lines(tokens)
            tidied, same_lines = _tidied(tokens)
            if tidied != text:
                tree = ast.parse(tidied)
                facts["text"] = tidied
            if not same_lines:
                facts["line_count"] = _code_lines(_tokens(tidied))
            return facts | outline_of(tidied, tree)
        except Exception as exc:
            return facts | dict(error=_problem(exc), failed=True)
    return clean


def _kind(node):
    if isinstance(node, IMPORTS):
        return "import"
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return "function"
    return "class" if isinstance(node, ast.ClassDef) else "other"


def _snippet(text):
    try:
        tree = ast.parse(text)
        return dict(
            syntax_ok=True, top_kinds=[_kind(node) for node in tree.body],
            import_count=sum(isinstance(node, IMPORTS) for node in _statements(tree)),
            top_level_defs=sum(isinstance(node, DEFINITIONS) for node in tree.body),
        )
    except Exception:
        # Fixed value: a count that no limit accepts.
        return dict(syntax_ok=False, top_kinds=[], import_count=999, top_level_defs=999)


def _parses(text):
    try:
        ast.parse(text)
        return True
    except Exception:
        return False


def _decode(content):
    """Text of a source file by its own encoding declaration or byte order mark."""
    try:
        encoding, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
        with io.TextIOWrapper(io.BytesIO(content), encoding) as reader:
            return dict(text=reader.read())
    except Exception as exc:
        return dict(error=_problem(exc))


def _per_row(work, returns):
    """Arrow UDF that applies `work` to each row whose first value is not NULL, slice by slice."""
    arrow_type = to_arrow_type(returns)

    def rows(*columns):
        for part in slices(*columns):
            with quiet():
                values = zip(*(column.to_pylist() for column in part))
                done = [None if first is None else work(first, *more) for first, *more in values]
            yield pa.array(done, type=arrow_type)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from rows(batch)

    def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from rows(*batch)

    def call(*columns: Column) -> Column:
        return F.arrow_udf([one, two][len(columns) - 1], returns).asNondeterministic()(*columns)
    return call


# Workers get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lint(source: Column) -> Column:
    return _per_row(_lint, schemas.LINTED)(source)


def clean(source: Column, redacted: Column, min_code_lines: int) -> Column:
    return _per_row(_cleaner(min_code_lines), schemas.CLEANED)(source, redacted)


def outline(source: Column) -> Column:
    return _per_row(_outline_or_error, schemas.OUTLINED)(source)


def snippet_facts(code: Column) -> Column:
    return _per_row(_snippet, schemas.SNIPPET)(code)


def parses(code: Column) -> Column:
    return _per_row(_parses, schemas.T.BooleanType())(code)


def decode_by_declaration(content: Column) -> Column:
    return _per_row(_decode, schemas.DECODED)(content)
