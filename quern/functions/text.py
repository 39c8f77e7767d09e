"""Column helpers for text.  All are built-in expressions, so they stay in the JVM.

Python's regular expressions and ``str`` methods are the yardstick: ``\\w``, ``\\s`` and ``\\b``
are Unicode-aware and only ``\\n`` ends a line.  Java needs the flags ``U`` and ``d`` for that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# Every character that str.isspace() accepts; all of them are below U+3001.
SPACES = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
# The same set for use inside a Java character class under the U flag.
SPACE_CLASS = r"\s\x1c-\x1f"

# What is redacted, in this order, and the text put in its place.  Each pattern
# comes with a literal that every match must contain; the regex runs only where it occurs.
REDACTIONS = [
    ("PRIVATE KEY-----", r"(?sdU)-----BEGIN.*?PRIVATE KEY-----.*?-----END.*?PRIVATE KEY-----",
     "<REDACTED_PRIVATE_KEY>"),
    ("AKIA", r"(?dU)\bAKIA[A-Z0-9]{16}\b", "<REDACTED_AWS_KEY>"),
    # Mail addresses: \b[\w\.-]+@[\w\.-]+\.\w+\b, tried once per run of such characters.
    ("@", r"(?dU)(?:\G|(?<![\w\.-]))([\.-]*?)\b[\w\.-]++@[\w\.-]+\.\w+\b",
     "$1<REDACTED_EMAIL>"),
    (".", r"(?dU)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<REDACTED_IP>"),
]

CODE_END = "### End of Code ###"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """``str.strip()``: drops every kind of Unicode white space at both ends."""
    return F.trim(col(c), F.lit(SPACES))


def collapse_spaces(c: Column | str) -> Column:
    """Each run of white space becomes one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(col(c), f"(?U)[{SPACE_CLASS}]+", " "))


def unify_newlines(c: Column | str) -> Column:
    return bind(col(c), lambda text: F.when(
        F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")
    ).otherwise(text))


def replace_where(c: Column | str, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Regex replacements in order: (literal, pattern, replacement).  Every match of the pattern
    contains the literal, so texts without it skip the regex."""
    def step(needle: str, pattern: str, replacement: str) -> Callable[[Column], Column]:
        return lambda text: F.when(
            F.contains(text, F.lit(needle)), F.regexp_replace(text, pattern, replacement)
        ).otherwise(text)
    c = col(c)
    for rule in rules:
        c = bind(c, step(*rule))
    return c


def redact(c: Column | str) -> Column:
    """Replace key blocks, access keys, mail addresses and IPv4 addresses by placeholders."""
    return replace_where(c, REDACTIONS)


def matches_any(c: Column | str, patterns: Sequence[str]) -> Column:
    """True if one of the patterns is found, ignoring case, with ``^`` and ``$`` per line."""
    if not patterns:
        return F.lit(False)
    return F.rlike(col(c), F.lit("(?imdU)" + "|".join(f"(?:{p})" for p in patterns)))


def filled(c: Column | str) -> Column:
    """NULL for an empty string, so that ``coalesce`` falls through as ``or`` does."""
    return F.nullif(col(c), F.lit(""))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def sample_json_length(type_: Column, instruction: Column, code: Column) -> Column:
    """Length of the sample as one JSON line with a blank after each of 3 colons and 2 commas."""
    packed = F.to_json(F.struct(
        text_or_empty(type_).alias("type"),
        text_or_empty(instruction).alias("instruction"),
        text_or_empty(code).alias("code"),
    ))
    return F.length(packed) + 5


def with_end_marker(code: Column | str) -> Column:
    code = col(code)
    newline = F.when(F.endswith(code, F.lit("\n")), "").otherwise("\n")
    return F.concat(code, newline, F.lit(CODE_END))


def utf8_text(content: Column | str) -> Column:
    """Bytes to text; broken sequences become U+FFFD."""
    return F.make_valid_utf8(col(content).cast("string"))


def is_indented(code: Column | str) -> Column:
    return F.contains(col(code), F.lit("\n    ")) | F.contains(col(code), F.lit("\n\t"))


def has_triple_quotes(code: Column | str) -> Column:
    return F.contains(col(code), F.lit('"""')) | F.contains(col(code), F.lit("'''"))


def seeded_rank(seed: int, *keys: Column | str) -> Column:
    """Pseudo-random order key that depends on the seed and the row's own key only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def path_stem(path: Column | str) -> Column:
    """Last path segment without its extension, as ``PurePath.stem``."""
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")


def path_stays_inside(path: Column | str) -> Column:
    """False for absolute paths and for any ``..`` that climbs above the starting folder."""
    def step(depth: Column, segment: Column) -> Column:
        return (
            F.when((depth < 0) | segment.isin("", "."), depth)
            .when(segment == "..", depth - 1)
            .otherwise(depth + 1)
        )
    depth = F.aggregate(F.split(col(path), "/"), F.lit(0), step)
    return ~F.startswith(col(path), F.lit("/")) & (depth >= 0)
