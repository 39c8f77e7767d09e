"""Column rewrites that repair text produced by a code model.  Each is a fixed chain of
built-in string expressions, in the order the rules are stated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quern.functions.text import SPACE_CLASS, bind, col, replace_where, strip

# Words that generated text glues to what follows, with the first character that
# shows it.
GLUED_WORDS = [
    ("def", "[A-Za-z]"),
    ("class", "[A-Z]"),
    ("return", "[A-Za-z]"),
    ("import", "[A-Za-z]"),
    ("print", "[A-Za-z]"),
]

# Keywords that get a blank after them, in this order.
KEYWORDS = [
    "def", "class", "if", "elif", "else", "for", "while", "try", "except", "finally", "with",
    "return", "yield", "raise", "import", "from", "print", "assert", "pass", "break", "continue",
    "global", "nonlocal", "del",
]
# Operators that get a blank on both sides, long ones first.
OPERATORS = [
    "<=", ">=", "==", "!=", "<<", ">>", "**", "//",
    "=", "+", "-", "*", "/", "%", "<", ">", "&", "|", "^",
]
# Words that open a block; a text on one line is broken before each of them.
BLOCK_WORDS = [
    "def ", "class ", "if ", "elif ", "else:", "for ", "while ", "try:", "except ", "finally:",
    "with ", "@",
]


def _chain(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def restore_marks(c: Column | str) -> Column:
    """Byte-pair marks for newline and blank back to the characters they stand for."""
    return F.replace(F.replace(col(c), F.lit("Ċ"), F.lit("\n")), F.lit("Ġ"), F.lit(" "))


def clean_generated(c: Column | str) -> Column:
    c = restore_marks(c)
    c = replace_where(
        c, [(word, f"{word}({follower})", f"{word} $1") for word, follower in GLUED_WORDS]
    )
    c = _chain(c, [
        # Indentation: each leading white-space character of a line counts as one blank.
        (rf"(?mdU)(?:^|\G)[{SPACE_CLASS}&&[^\n]]", " "),
        # Runs of blanks after the indentation shrink to one.
        (r"(?<=[^ \n]) +", " "),
        (r"\n{3,}", "\n\n"),
    ])
    for old, new in [("(", " ("), ("( ", "("), (" )", ")")]:
        c = F.replace(c, F.lit(old), F.lit(new))
    return strip(c)


def strip_markup(c: Column | str) -> Column:
    """Drop an echoed prompt and anything that looks like a tag."""
    return strip(_chain(col(c), [
        (r"(?sU)###\s*Instruction:.*?###\s*Response:", ""),
        (r"<[^>]+>", ""),
    ]))


def space_out(c: Column | str) -> Column:
    """Blanks after keywords, around operators and after commas and colons."""
    word = "[a-zA-Z0-9_]"
    # Patterns begin with a literal wherever they can, since a search tries every character.
    rules = [(k, f"{k}([A-Za-z_])", f"{k} $1") for k in KEYWORDS]
    rules += [
        (":", r":([A-Za-z_])", ": $1"),
        (")(", r"\)\(", ") ("),
        (")->", r"\)->", ") -> "),
        ("->", r"->([A-Za-z_])", "-> $1"),
    ]
    # The word character on the left is one that the last match did not end with.
    rules += [
        (op, rf"\Q{op}\E(?<={word}\Q{op}\E)(?<!\G\Q{op}\E)({word})", f" {op} $1") for op in OPERATORS
    ]
    rules += [
        (",", r",([A-Za-z_])", ", $1"),
        (",", r",([0-9])", ", $1"),
        ("if(", r"if\(", "if ("),
        ("elif(", r"elif\(", "elif ("),
        ("while(", r"while\(", "while ("),
    ]
    # name=value: each run of word characters is tried once, from its start or from where the
    # last match ended, which keeps the rule linear on text without blanks.  Few texts still have
    # what every match needs.
    value = r"[a-zA-Z0-9_\"']"
    assigned = rf"(?:\G|(?<!{word}))([0-9]*+[a-zA-Z_]{word}*+)=({value})"
    return bind(replace_where(c, rules), lambda text: F.when(
        F.contains(text, F.lit("=")) & F.rlike(text, F.lit(rf"=(?<={word}=)(?={value})")),
        F.regexp_replace(text, assigned, "$1 = $2"),
    ).otherwise(text))


def break_one_liner(c: Column | str) -> Column:
    """A text without any newline gets one before every block word."""
    rules = [(word, f"({word})", "\n$1") for word in BLOCK_WORDS]
    return bind(col(c), lambda text: F.when(F.contains(text, F.lit("\n")), text).otherwise(
        replace_where(text, rules)
    ))


def reindent(c: Column | str) -> Column:
    """Strip every line, drop blank ones, put a blank line before each block line, and indent by
    the number of block headers met so far (the level never goes down).

    After the first steps two newlines in a row are the most there can be, so three in a row mark
    the place after a header where the level rises.  Splitting there gives pieces whose index is
    their level, which keeps the work linear in the length of the text.
    """
    blanks = rf"[{SPACE_CLASS}&&[^\n]]"
    block = "|".join(word.rstrip() + r"\x20" if word.endswith(" ") else word for word in BLOCK_WORDS)
    header = rf"(?:class\x20|def\x20)[^\n]*|(?:{block})[^\n]*(?<=:)"
    flat = _chain(col(c), [
        (rf"(?mdU)^{blanks}++|{blanks}(?<!{blanks}{{2}}){blanks}*+$", ""),
        (r"\n{2,}", "\n"),
        (r"\A\n|\n\z", ""),
        (rf"\n(?={block})", "\n\n"),
        (rf"(?md)^({header})\n", "$1\n\n\n"),
    ])
    levelled = F.transform(
        F.split(flat, "\n\n\n"),
        lambda piece, level: F.when(level == 0, piece).otherwise(F.regexp_replace(
            piece, F.lit(r"(?md)^(?=[^\n])"), F.repeat(F.lit("    "), level)
        )),
    )
    return F.array_join(levelled, "\n")


def repair_compact(c: Column | str) -> Column:
    return reindent(break_one_liner(space_out(c)))


def clean_response(c: Column | str) -> Column:
    return repair_compact(strip_markup(c))
