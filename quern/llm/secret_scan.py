"""Secret scans through a trigram index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
contain.  A block of documents is indexed in one pass over its bytes, whatever the number of rules:
every trigram of the texts that some rule asks for goes to that trigram's posting list.  A rule's
query intersects and unites posting lists, and only the documents that remain are searched with the
expression.  Rules without a mandatory trigram search every document.  Blocks are independent, so
nothing is shuffled and no index grows with the corpus.

Trigrams are three bytes, with A to Z in lower case, which can only add candidates.  What an
expression matches in either case beyond ASCII counts as no trigram.

Cases: NULL is the empty text (no spans); texts are searched whole; matches of one kind never
overlap, those of different kinds may; equal starts are ordered by the rules' order; repeated rows
give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame
from re import _constants as codes, _parser as parser

from quern.llm.common import map_texts

MAX_STRINGS = 64
MAX_CLASS = 8
# Bytes of text that are indexed together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19


@dataclass(frozen=True)
class Rule:
    """``kind`` names the spans; ``least`` is the length that group ``group`` must reach."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base kinds.  Letters of the first are matched in either case, ASCII only.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
        2, 12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# A key block goes through its END line, whatever stands between them but another block's marker.
# Without one it goes on with the lines of base64, also where line ends are spaces or written as \n;
# a last line may be short.  No look-around and no references, so that SQL can have the same pattern.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:"
    r"[^-]*(?:(?:-{1,4}[^-]|-{5,}[^-BE])[^-]*)*-{5,}END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:(?:[\x20\t\r\n]|\\[rn])+(?:(?:Proc-Type|DEK-Info):[^\n\\]*|[A-Za-z0-9+/]{16,}={0,2}))*"
    r"(?:(?:\r?\n|(?:\\r)?\\n)[\x20\t]*[A-Za-z0-9+/]{1,15}(?:={1,2}|\r?(?m:$)))?)"
)
# Publicly documented credential formats.
MORE_RULES = (
    Rule("private_key", PRIVATE_KEY),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{24,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


# ---------------------------------------------------------------- queries from expressions
# A query is True (nothing is mandatory), a trigram, or ("and" | "or", queries).


def _join(kind: str, parts: list):
    """``and`` drops True; ``or`` with True is True."""
    if kind == "or" and any(part is True for part in parts):
        return True
    parts = list(dict.fromkeys(part for part in parts if part is not True))
    if not parts:
        return True
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]):
    """What a text must contain if it contains one of the strings."""
    return _join("or", [
        _join("and", [text[i:i + 3] for i in range(len(text) - 2)] or [True])
        for text in sorted(strings)
    ])


def _folded(code: int) -> str:
    """Only ASCII has a lower case here, in expressions as in texts."""
    return chr(code).lower() if code < 128 else chr(code)


def _class_strings(items) -> set[str] | None:
    chars: set[str] = set()
    for code, value in items:
        if code is codes.LITERAL:
            chars.add(_folded(value))
        elif code is codes.RANGE and value[1] - value[0] < 2 * MAX_CLASS:
            chars.update(map(_folded, range(value[0], value[1] + 1)))
        else:
            return None
    return chars if len(chars) <= MAX_CLASS else None


def _describe(tree) -> tuple[set[str] | None, object]:
    """The strings an expression can match, if few, else None; and its query."""
    strings: set[str] | None = {""}
    run, queries = {""}, []
    for code, value in tree:
        exact, query = _describe_item(code, value)
        joined = None
        if exact is not None and run is not None:
            joined = {a + b for a in run for b in exact}
        if joined is not None and len(joined) <= MAX_STRINGS:
            run = joined
            continue
        strings = None
        queries += [_of_strings(run), query]
        run = exact if exact is not None else {""}
    queries.append(_of_strings(run))
    return (run if strings is not None else None), _join("and", queries)


def _describe_item(code, value) -> tuple[set[str] | None, object]:
    if code is codes.LITERAL:
        return {_folded(value)}, True
    if code is codes.IN:
        return _class_strings(value), True
    if code is codes.SUBPATTERN:
        return (None, True) if _folds_unicode(value[1]) else _describe(value[3])
    if code is codes.BRANCH:
        made = [_describe(branch) for branch in value[1]]
        if all(exact is not None for exact, _ in made):
            union = set().union(*(exact for exact, _ in made))
            if len(union) <= MAX_STRINGS:
                return union, _of_strings(union)
        return None, _join("or", [query for _, query in made])
    if code in (codes.MAX_REPEAT, codes.MIN_REPEAT):
        least, most, inner = value
        exact, query = _describe(inner)
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, True
        if least == most == 1:
            return exact, query
        return None, query if least else True
    if code is codes.AT:
        return {""}, True
    return None, True


def _folds_unicode(flags: int) -> bool:
    return bool(flags & re.IGNORECASE) and not flags & re.ASCII


def trigram_query(pattern: str):
    tree = parser.parse(pattern)
    if _folds_unicode(tree.state.flags):
        return True
    exact, query = _describe(tree)
    return _of_strings(exact) if exact is not None else query


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def candidates(query, postings: dict[str, np.ndarray]) -> np.ndarray | None:
    """Documents that satisfy the query; None means all."""
    if query is True:
        return None
    if isinstance(query, str):
        return postings[query]
    parts = [candidates(part, postings) for part in query[1]]
    return reduce(np.intersect1d if query[0] == "and" else np.union1d, parts)


# ---------------------------------------------------------------- the scan


def byte_trigrams(gram: str) -> list[int]:
    """Three bytes each as one number; a trigram beyond ASCII has more than three bytes."""
    raw = gram.encode()
    return [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(rule, re.compile(rule.pattern), trigram_query(rule.pattern)) for rule in rules]
        grams = set().union(*(trigrams_of(query) for _, _, query in self.rules))
        self.grams = {gram: byte_trigrams(gram) for gram in grams}
        wanted = sorted({code for found in self.grams.values() for code in found})
        self.place = {code: place for place, code in enumerate(wanted, 1)}
        self.number = np.zeros(1 << 24, np.uint16)  # of each trigram, 0 if no rule asks for it
        self.number[wanted] = np.arange(1, len(wanted) + 1)

    def postings(self, texts: list[str]) -> dict[str, np.ndarray]:
        """For each trigram the texts that hold it, in order."""
        raw = [text.encode().lower() for text in texts]
        data = np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8).astype(np.uint32)
        number = self.number[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(number)
        starts = np.cumsum([0] + [len(r) + 2 for r in raw[:-1]])
        text = np.searchsorted(starts, at, side="right") - 1
        entries = np.unique(number[at].astype(np.int64) * len(texts) + text)
        lists = np.split(entries % max(len(texts), 1), np.searchsorted(
            entries, np.arange(1, len(self.place) + 1) * len(texts)))
        return {
            gram: reduce(np.intersect1d, [lists[self.place[code]] for code in found])
            for gram, found in self.grams.items()
        }

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text: (start, place of the rule, end), sorted."""
        found: list[list] = []
        for start, stop in self.blocks(texts):
            found += self.block_spans(texts[start:stop])
        return found

    @staticmethod
    def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
        start, size = 0, 0
        for place, text in enumerate(texts):
            if size and size + len(text) > BLOCK_BYTES:
                yield start, place
                start, size = place, 0
            size += len(text)
        if texts:
            yield start, len(texts)

    def block_spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        postings = self.postings(texts)
        found: list[list] = [[] for _ in texts]
        for place, (rule, pattern, query) in enumerate(self.rules):
            chosen = candidates(query, postings)
            for i in range(len(texts)) if chosen is None else chosen.tolist():
                found[i] += [
                    (match.start(), place, match.end()) for match in pattern.finditer(texts[i])
                    if match.end(rule.group) - match.start(rule.group) >= rule.least
                ]
        return [sorted(spans) for spans in found]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def secret_spans(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: ``spans``, an array of (kind, start, end) in code points, end exclusive."""
    def rows(texts: list[str]) -> list[list]:
        return [[
            [{"kind": rules[place].kind, "start": start, "end": end} for start, place, end in spans]
            for spans in scanner(rules).spans(texts)
        ]]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(
        docs, f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,`end`:long>>",
        rows, id_col, text_col,
    )


def secret_digest(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    base = len(BASE_RULES)

    def rows(texts: list[str]) -> list[list]:
        made: list[list] = [[], [], [], [], []]
        for spans in scanner(rules).spans(texts):
            named = [(place, f"{rules[place].kind}:{start}:{end}") for start, place, end in spans]
            for place in range(base):
                made[place].append(sum(1 for p, _ in named if p == place))
            digest = ",".join(name for place, name in named if place < base)
            made[3].append(hashlib.sha256(digest.encode()).hexdigest())
            made[4].append(",".join(name for _, name in named))
        return made

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(
        docs, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, "
        "base_sha256 string, spans string", rows, id_col, text_col,
    )


def redact_text(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """Each maximal stretch covered by spans becomes one mask."""
    parts, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], mask]
        at = end
    return "".join([*parts, text[at:]])


def redact_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "<SECRET>", text_col: str = "text"
) -> DataFrame:
    """The same rows and columns; secrets in the text are masked, a NULL text stays NULL."""
    import pyarrow as pa

    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            spans = scanner(rules).spans([text or "" for text in texts])
            masked = [
                redact_text(text, found, mask) if found else text
                for text, found in zip(texts, spans, strict=True)
            ]
            yield batch.set_column(place, batch.schema.field(place), pa.array(masked, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
