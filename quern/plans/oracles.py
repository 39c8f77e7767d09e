"""The same results as the registered queries, stated in SQL.

For code files the expected facts, cleaned texts and samples are written out per template; they
are not computed by the code under test.
"""

from __future__ import annotations

from quern.plans.corpus import FILE_PATH, SOURCES, by_template, sql_text
from quern.plans.queries import (
    CHOKES_ON, CODE_TARGET, COMPACT_SQL, EOS_TEXT, EVENT_CUT, GENERATED_SQL, PART_NAME_SQL,
    PROSE_TARGET, SECRET_SQL, SOURCE_CAP,
)
from quern.plans.tables import BLANK_IDS


# Fixed values, restated so that a wrong entry in the code shows.
KEYWORDS = [
    "def", "class", "if", "elif", "else", "for", "while", "try", "except", "finally", "with",
    "return", "yield", "raise", "import", "from", "print", "assert", "pass", "break", "continue",
    "global", "nonlocal", "del",
]
OPERATORS = [
    "<=", ">=", "==", "!=", "<<", ">>", "**", "//",
    "=", "+", "-", "*", "/", "%", "<", ">", "&", "|", "^",
]
BLOCK_WORDS = [
    "def ", "class ", "if ", "elif ", "else:", "for ", "while ", "try:", "except ", "finally:",
    "with ", "@",
]
VERB_BY_PREFIX = {
    "get": "获取",
    "set": "设置",
    "is_": "判断是否为",
    "has_": "检查是否包含",
    "calc": "计算",
    "find": "查找",
    "parse": "解析",
    "validate": "验证",
    "generate": "生成",
    "create": "创建",
    "init": "初始化",
    "clean": "清理",
    "process": "处理",
    "load": "加载",
    "save": "保存",
    "read": "读取",
    "write": "写入",
    "open": "打开",
    "close": "关闭",
    "start": "启动",
    "stop": "停止",
    "run": "运行",
    "test": "测试",
}


def redacted(text: str) -> str:
    rules = [
        ("-----BEGIN.*?PRIVATE KEY-----.*?-----END.*?PRIVATE KEY-----", "PRIVATE_KEY", "gs"),
        (r"\bAKIA[A-Z0-9]{16}\b", "AWS_KEY", "g"),
        (r"\b[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+\b", "EMAIL", "g"),
        (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "IP", "g"),
    ]
    for pattern, name, flags in rules:
        text = f"regexp_replace({text}, '{pattern}', '<REDACTED_{name}>', '{flags}')"
    return text


def stripped(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '^\s+', ''), '\s+$', '')"


def collapsed(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def bytes_of(text: str) -> str:
    return f"strlen({text})"


# ------------------------------------------------------------- stand-ins

DOC_SAMPLES = """
SELECT doc_id, lang, source, doc_id + 1 AS source_line,
  CASE doc_id % 5 WHEN 0 THEN 'completion' WHEN 1 THEN 'bug_fix' ELSE 'code_comment' END AS type,
  split_part(text, chr(10), 1) AS instruction,
  text AS code,
  CASE WHEN doc_id % 2 = 0 THEN '# original' || chr(10) || text END AS original_code,
  CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '# fixed' END AS fixed_code
FROM documents
"""
SOME_BLANK = f"""
SELECT * FROM ({DOC_SAMPLES})
UNION ALL
SELECT doc_id + {BLANK_IDS}, lang, source, source_line, type, instruction, ' ' || chr(10),
  NULL, '' FROM ({DOC_SAMPLES}) WHERE doc_id % 7 = 0
"""

PAIRS = """
SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS code
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""


def listing(where: str = "") -> str:
    return f"""
SELECT 'user/' || user_id AS repo, epoch_us(max(ts)) AS updated_at, count(*) AS stars,
  count(*) FILTER (event_type = 'click') AS forks
FROM events {where} GROUP BY user_id
"""


STATE = listing(f"WHERE ts < TIMESTAMP '{EVENT_CUT}'")
CHANGED = f"""
SELECT l.* FROM ({listing()}) l
WHERE NOT EXISTS (SELECT 1 FROM ({STATE}) s WHERE s.repo = l.repo AND s.updated_at = l.updated_at)
"""

PAGE_FILES = r"""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS repo,
  CASE page_id % 5 WHEN 0 THEN '../' WHEN 1 THEN 'a/../' WHEN 2 THEN 'a/../../a/' WHEN 3 THEN '/'
    ELSE './' END || regexp_replace(url, '^https?://[^/]+/', '') AS path,
  page_id % 5 IN (1, 4) AS path_ok
FROM pages
"""

# ----------------------------------------------------------- code corpus

CLEAN = {
    **{k: SOURCES[k] for k in (0, 1, 6, 7, 8, 9)},
    4: SOURCES[4].replace("# {begin}\n# MIIB{id}\n# {end}\n", "# <REDACTED_PRIVATE_KEY>\n")
    .replace("{mail}", "<REDACTED_EMAIL>").replace("{host}", "<REDACTED_IP>")
    .replace("{key}", "<REDACTED_AWS_KEY>"),
    5: """#!/usr/bin/env python
# -*- coding: utf-8 -*-
# {cmt}
#
x_{id} = 1 # tail
def run_{id}(items):
    total = 0
    for item in items:
        total += item   # sum
    return total


y = 2
z = 3
v = "a  b"
w = run_{id}([x_{id}, y, z])
print(w)
""",
}

FILES = f"""
files AS (
  SELECT doc_id, {FILE_PATH} AS file_path, {by_template(SOURCES)} AS source,
    {redacted('text')} AS r, doc_id % 10 AS k
  FROM documents
),
cleaned AS (
  SELECT *, {by_template(CLEAN, 'r')} AS clean FROM files WHERE k NOT IN (2, 3)
)
"""

# Per template: code lines of the source, lines, functions and imports of the cleaned file.
FACTS = """
facts(k, code_lines, line_count, function_count, imports) AS (VALUES
  (0, 13, 13, 1, 'json,os'), (1, 15, 15, 7, ''), (2, NULL, NULL, NULL, NULL),
  (3, 9, NULL, NULL, NULL), (4, 10, 10, 1, 'logging,os'), (5, 11, 11, 1, ''),
  (6, 25, 25, 8, ''), (7, 12, 12, 1, ''), (8, 13, 13, 3, 'numpy,os,pkg'), (9, 483, 483, 1, ''))
"""

PLAIN_FILE = "实现 mod {id} 模块的完整功能"
FILE_INSTRUCTION = {
    0: "{doc}", 1: PLAIN_FILE, 4: PLAIN_FILE, 5: PLAIN_FILE, 6: "Helpers {id}: {doc}",
    7: PLAIN_FILE, 8: PLAIN_FILE, 9: "{doc}",
}


def _body(k: int, first: str, last: str) -> str:
    """Lines of a cleaned template from the one that starts with `first` through `last`."""
    lines = CLEAN[k].split("\n")
    start = next(i for i, line in enumerate(lines) if line.strip().startswith(first))
    end = next(i for i in range(start, len(lines)) if lines[i].strip().startswith(last))
    return "\n".join([lines[start].strip(), *lines[start + 1:end + 1]])


# Per template: (kind, order, instruction, first line, last line).
DEFINITIONS = {
    0: [("function", 0, "Return the item {id} or the default.", "def get_item", "return total")],
    1: [
        ("function", 0, "获取 area，参数为 self", "def get_area", "return"),
        ("function", 1, "设置 width，参数为 self, width", "def set_width", "self.width = width"),
        ("function", 2, "判断是否为 open，参数为 self", "def is_open", "return"),
        ("function", 3, "检查是否包含 height，参数为 self", "def has_height", "return"),
        ("function", 4, "实现函数 scale，接收参数 self, factor", "def scale", "self.width = "),
        ("function", 5, "实现函数 reset，接收参数 self", "def reset", "self.width = 0"),
        ("function", 6, "关闭 close，参数为 self", "def close", "self.height = 0"),
        ("class", 0,
         "定义类 Shape{id}，包含方法 get_area、set_width、is_open、has_height、scale 等 7 个方法",
         "class Shape", "self.height = 0"),
    ],
    4: [("function", 0,
         "Lookup {id}: mail <REDACTED_EMAIL>, host <REDACTED_IP>, key <REDACTED_AWS_KEY> {flat}",
         "def lookup", "return path")],
    5: [("function", 0, "运行 {id}，参数为 items", "def run_", "return total")],
    6: [
        ("function", 0, "实现函数 init ，接收参数 self", "def __init__", "return self"),
        ("function", 1, "设置 value，参数为 self, value", "def set_value", "return self"),
        ("function", 2, "计算 sum，参数为 a, b", "def calcsum", "return total"),
        ("function", 3, "解析 line {id}，参数为 line", "def parse_line", "return parts"),
        ("function", 4, "实现函数 plain，无需参数", "def plain", "return value"),
        ("function", 5, "判断是否为 is ，参数为 x", "def is_", "return same"),
        # Too short once its blanks are collapsed, a name keeps them.
        ("function", 6, "加载 {pad}{id}", "def load_", "return value"),
        ("function", 7, "测试 {id}，参数为 a", "def test_", "return value"),
    ],
    7: [("function", 0, "Process all items up to a limit and return the total.", "def process",
         "return total")],
    8: [
        ("function", 0, "实现函数 outer {id}，接收参数 a, b", "def outer", "return total"),
        ("function", 1, "实现函数 inner，接收参数 x", "def inner", "return x"),
    ],
    9: [("function", 0, "实现函数 tail {id}，接收参数 rows", "def tail", "return")],
}
FLAT = {
    "flat": r"regexp_replace({text}, '\s+', ' ', 'g')",
    "pad": "CASE WHEN doc_id < 10 THEN ' ' ELSE '' END",
}


def _rows() -> str:
    rows = []
    for k, instruction in FILE_INSTRUCTION.items():
        rows.append(
            f"SELECT file_path, k, 'file' AS kind, 0 AS kind_rank, 0 AS node_ord, "
            f"{sql_text(instruction, 'r')} AS instruction, clean AS code FROM cleaned WHERE k = {k}"
        )
    for k, defs in DEFINITIONS.items():
        for kind, ord_, instruction, first, last in defs:
            code = _body(k, first, last)
            rows.append(
                f"SELECT file_path, k, '{kind}', {1 if kind == 'function' else 2}, {ord_}, "
                f"{sql_text(instruction, 'r', **FLAT)}, {sql_text(code, 'r')} "
                f"FROM cleaned WHERE k = {k}"
            )
    return "\nUNION ALL ".join(rows)


JSON_LENGTH = (
    "length(CAST(to_json({{'type': {type}, 'instruction': instruction, 'code': code}}) AS VARCHAR)) + 5"
)

SAMPLES = f"""
WITH {FILES},
all_rows AS ({_rows()}),
picked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY file_path, kind
      ORDER BY md5('42|' || file_path || '|' || kind || '|' || node_ord), node_ord) AS draw
    FROM all_rows)
  WHERE kind = 'file' OR draw <= CASE kind WHEN 'function' THEN 5 ELSE 3 END
),
checked AS (
  SELECT *, CASE
      WHEN kind = 'file' AND length(trim(code, chr(10))) < 200 THEN 'file_too_small'
      WHEN kind = 'file' AND length(code) > 8192 THEN 'file_too_large'
      WHEN {JSON_LENGTH.format(type="'code_comment'")} > 4096 THEN 'too_long_skipped'
      WHEN length({stripped('code')}) < 30 THEN 'code_too_short'
      WHEN length(trim(instruction)) < 5 THEN 'instruction_too_short'
    END AS reason,
    code || CASE WHEN code LIKE '%' || chr(10) THEN '' ELSE chr(10) END
      || '### End of Code ###' AS marked
  FROM picked
),
ranked AS (
  SELECT *, md5(marked) AS code_hash, row_number() OVER (
    PARTITION BY md5(marked) ORDER BY file_path, kind_rank, node_ord) AS copy
  FROM checked WHERE reason IS NULL
),
written AS (
  SELECT *, row_number() OVER (ORDER BY file_path, kind_rank, node_ord) AS source_line
  FROM ranked WHERE copy = 1
)
"""

# ------------------------------------------------------------- selection


def reason_chain(
    code_chars: tuple[int, int], indented: bool, bad_instruction: str, bad_code: str
) -> str:
    indentation = (
        "WHEN NOT (contains(c, chr(10) || '    ') OR contains(c, chr(10) || chr(9))) "
        "THEN 'no_indentation'" if indented else ""
    )
    return f"""CASE WHEN type IS DISTINCT FROM 'code_comment' THEN 'not_code_comment'
  WHEN i = '' THEN 'empty_instruction' WHEN c = '' THEN 'empty_code'
  WHEN length(i) < 10 THEN 'instruction_too_short'
  WHEN length(i) > 160 THEN 'instruction_too_long'
  WHEN length(c) < {code_chars[0]} THEN 'code_too_short'
  WHEN length(c) > {code_chars[1]} THEN 'code_too_long'
  {indentation}
  WHEN regexp_matches(i, '{bad_instruction}') THEN 'bad_instruction_pattern'
  WHEN regexp_matches(c, '{bad_code}') THEN 'bad_code_pattern'"""


def score(points: dict[str, int], imports: str, defs: str) -> str:
    shapes = " ".join(f"WHEN '{name}' THEN {value}" for name, value in points.items())
    return f"""CASE shape {shapes} ELSE 0 END
  + CASE WHEN length(c) BETWEEN 200 AND 1200 THEN 25
         WHEN length(c) BETWEEN 1201 AND 2000 THEN 10 ELSE 0 END
  + CASE WHEN length(i) BETWEEN 20 AND 120 THEN 20
         WHEN length(i) BETWEEN 10 AND 19 THEN 8 ELSE 0 END
  + CASE WHEN contains(c, chr(10) || '    ') OR contains(c, chr(10) || chr(9)) THEN 15 ELSE 0 END
  + CASE WHEN {imports} <= 2 THEN 10 ELSE 0 END + CASE WHEN {defs} = 1 THEN 10 ELSE 0 END
  + CASE WHEN contains(c, '\"\"\"') OR contains(c, chr(39) || chr(39) || chr(39)) THEN 5 ELSE 0 END"""


def selected(pool: str, target: int, major: str, minor: str) -> str:
    """CTEs from `pool` (source_line, shape, score, i, c) to `chosen` with its shuffle rank."""
    best = "ORDER BY score DESC, source_line"
    return f"""
by_shape AS (
  SELECT *, row_number() OVER (PARTITION BY shape {best}) AS shape_rank FROM {pool}
),
quota AS (
  SELECT least(count(*) FILTER (shape = '{minor}'), CAST(floor({target} * 0.2) AS BIGINT)) AS q
  FROM {pool}
),
first_pick AS (
  SELECT b.* FROM by_shape b, quota
  WHERE (shape = '{major}' AND shape_rank <= {target} - q) OR (shape = '{minor}' AND shape_rank <= q)
),
refill AS (
  SELECT * FROM (
    SELECT b.*, row_number() OVER ({best}) AS turn FROM by_shape b
    WHERE source_line NOT IN (SELECT source_line FROM first_pick))
  WHERE turn <= {target} - (SELECT count(*) FROM first_pick)
),
chosen AS (
  SELECT *, row_number() OVER (ORDER BY md5('42|' || source_line), source_line) AS shuffle_rank
  FROM (SELECT * EXCLUDE (shape_rank) FROM first_pick
        UNION ALL SELECT * EXCLUDE (shape_rank, turn) FROM refill)
)
"""


PROSE_JUDGED = rf"""
WITH items AS (
  SELECT *, lang AS shape, {collapsed('instruction')} AS i, {stripped('code')} AS c
  FROM ({DOC_SAMPLES})
),
judged AS (
  SELECT *, {reason_chain((100, 4000), False,
    r'(?im)(?:^\s*the\b|^\s*un\b|\d{4})',
    r'(?im)(?:\btoken\b|\bidiot\b|worthless|\bLicensed under\b.*$)')} END AS reason
  FROM items
),
scored AS (
  SELECT *, {score({'en': 40, 'de': 30}, '0', '1')} AS score FROM judged WHERE reason IS NULL
),
pool AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY source_line) AS copy FROM scored)
  WHERE copy = 1
)
"""

PROSE_SELECTED = PROSE_JUDGED + "," + selected("pool", PROSE_TARGET, "en", "de")

BAD_CODE = (
    r"(?im)(?:\bpytest\b|\bunittest\b|\bmock\b|\bassert\b|\btodo\b|\bfixme\b|\bpass\s*(#.*)?$"
    r"|NotImplementedError|raise\s+NotImplemented"
    r"|if\s+__name__\s*==\s*[\x27\x22]__main__[\x27\x22]|argparse\.|click\.)"
)
BAD_INSTRUCTION = (
    r"(?im)(?:^\s*(?:todo|fixme|test|deprecated|internal)\b|实现 .* 模块的完整功能|实现 .* 模块的功能)"
)

CODE_JUDGED = SAMPLES + rf""",
items AS (
  SELECT source_line, type, instruction AS i0, {collapsed('instruction')} AS i, marked AS c,
    CASE WHEN kind <> 'file' THEN kind WHEN k IN (4, 7) THEN 'function' WHEN k = 1 THEN 'class'
      ELSE 'other' END AS real_shape,
    CASE WHEN kind = 'file' AND k = 4 THEN 2 ELSE 0 END AS imports
  FROM (SELECT *, 'code_comment' AS type FROM written)
),
texted AS (
  SELECT *, {reason_chain((100, 2000), True, BAD_INSTRUCTION, BAD_CODE)} END AS text_reason
  FROM items
),
judged AS (
  SELECT *, CASE WHEN text_reason IS NOT NULL THEN text_reason
      WHEN real_shape = 'other' THEN 'not_function_or_class' END AS reason,
    CASE WHEN text_reason IS NULL THEN real_shape END AS shape
  FROM texted
),
scored AS (
  SELECT *, CASE WHEN reason IS NULL
    THEN {score({'function': 40, 'class': 30}, 'imports', '1')} END AS score
  FROM judged
),
pool AS (SELECT * FROM scored WHERE reason IS NULL)
"""

# ---------------------------------------------------------------- tokens

def typed(rows: str) -> str:
    return f"""
SELECT *, trim(code, ' ' || chr(10)) = '' AS is_blank FROM (
  SELECT * REPLACE (CASE type
      WHEN 'completion' THEN coalesce(nullif(original_code, ''), code)
      WHEN 'bug_fix' THEN coalesce(nullif(fixed_code, ''), code) ELSE code END AS code)
  FROM ({rows}))
"""


def ints(hexes: str) -> str:
    """A list of two-digit hex strings as numbers."""
    return f"list_transform({hexes}, lambda b: CAST('0x' || b AS INTEGER))"


def pairs_of(text: str, first: str, last: str) -> str:
    """The hex pairs of the bytes first..last (from 1, end inclusive) of a text."""
    return (
        f"list_transform(range(CAST({first} AS BIGINT), CAST({last} AS BIGINT) + 1), lambda q: "
        f"substr(substr(hex({text}), 1, 4096), CAST(2 * q - 1 AS BIGINT), 2))"
    )


def repeated(value: str, n: str) -> str:
    return f"list_transform(range(CAST({n} AS BIGINT)), lambda z: {value})"


def joined_md5(*lists: str) -> str:
    return f"md5(array_to_string({' || '.join(lists)}, ' '))"


TYPED = typed(DOC_SAMPLES)
TOKENS = f"""
SELECT doc_id, source_line, type, nullif(instruction, '') AS instruction, code,
  least({bytes_of('code')} + 1, 2048) AS n_tokens, {bytes_of('code')} + 1 AS original_tokens,
  {bytes_of('code')} + 1 > 2048 AS truncated
FROM ({TYPED}) WHERE NOT is_blank
"""
IDS = (
    f"({ints(pairs_of('code', '1', 'least(n_tokens, original_tokens - 1)'))}"
    " || CASE WHEN truncated THEN [] ELSE [256] END)"
)
CHOSEN = f"""
SELECT *, contains(code, '{CHOKES_ON}') AS failed FROM (
  {TOKENS.replace(TYPED, typed(SOME_BLANK))})
"""

# --------------------------------------------------------------- prompts

HEAD = "'### Instruction:' || chr(10) || {i} || chr(10) || chr(10) || '### Response:' || chr(10)"


def prompt_sql(instruction: str, fence: bool = False) -> str:
    head = HEAD.format(i=stripped(instruction))
    return head + (" || '```python' || chr(10)" if fence else "")


FENCED = f"{prompt_sql('instruction', True)} || {stripped('code')} || chr(10) || '```'"
SYSTEM = (
    "'### System:' || chr(10) || 'You are a Python coding assistant.Use Python 3 syntax."
    "Write only the code required to fulfill the user''s instruction. Stop after ## End of Code ##.'"
    " || chr(10) || chr(10)"
)

MASKS = f"""
SELECT *, least({bytes_of('head')}, 2048) AS p, least({bytes_of('full_text')}, 2048) AS n
FROM (SELECT *, {prompt_sql('instruction', True)} AS head, {FENCED} AS full_text FROM ({{rows}}))
"""

# ------------------------------------------------------------ perplexity

LOSSES = r"""
words AS (
  SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS token FROM documents
),
kept AS (SELECT * FROM words WHERE token <> ''),
vocabulary AS (SELECT token, count(*) AS seen FROM kept GROUP BY token),
totals AS (SELECT sum(seen) + count(*) AS mass FROM vocabulary),
losses AS (
  SELECT doc_id, avg(-ln((seen + 1) / mass)) AS loss, count(*) AS n_tokens
  FROM kept JOIN vocabulary USING (token), totals GROUP BY doc_id
  UNION ALL
  SELECT doc_id + BLANK_IDS, NULL, 0 FROM documents WHERE doc_id % 7 = 0
)
""".replace("BLANK_IDS", str(BLANK_IDS))

HELD_OUT_LOSSES = r"""
split AS (
  SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents
),
pairs AS (
  SELECT doc_id, doc_id % 5 = 0 AS held_out, unnest(w) AS token,
    unnest(list_concat([''], w)[1:len(w)]) AS prev FROM split
),
seen AS (SELECT prev, token, count(*) AS c FROM pairs WHERE NOT held_out GROUP BY ALL),
contexts AS (SELECT prev, sum(c) AS total, count(*) AS followers FROM seen GROUP BY prev),
continuations AS (SELECT token, count(*) AS precursors FROM seen GROUP BY token),
totals AS (
  SELECT count(*) AS kinds, count(DISTINCT token) AS known,
    coalesce(CASE WHEN count(*) FILTER (c = 2) > 0 THEN nullif(count(*) FILTER (c = 1), 0)
      / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2)) END, 0.75)::DOUBLE AS d FROM seen
),
vocabulary AS (SELECT token, count(*) AS n FROM pairs WHERE NOT held_out GROUP BY token),
mass AS (SELECT sum(n) + count(*) AS mass FROM vocabulary),
lower_order AS (
  SELECT p.*, c, total, followers, d,
    (greatest(coalesce(precursors, 0) - d, 0) + d * known / (known + 1)) / kinds AS low,
    -ln((coalesce(n, 0) + 1) / mass) AS one
  FROM pairs p LEFT JOIN seen USING (prev, token) LEFT JOIN contexts USING (prev)
    LEFT JOIN continuations USING (token) LEFT JOIN vocabulary USING (token), totals, mass
),
costs AS (
  SELECT doc_id, held_out, one, -ln(coalesce(
    greatest(coalesce(c, 0) - d, 0) / total + d * followers / total * low, low)) AS two FROM lower_order
),
losses AS (
  SELECT doc_id, doc_id % 5 = 0 AS held_out, avg(one) AS one, avg(two) AS two, count(token) AS n_tokens
  FROM documents LEFT JOIN (SELECT doc_id, one, two, 1 AS token FROM costs) USING (doc_id) GROUP BY doc_id
)
"""

# ------------------------------------------------------- generated texts


def replaced(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


def _clean_generated() -> str:
    text = "replace(replace(text, 'Ċ', chr(10)), 'Ġ', ' ')"
    text = replaced(text, [
        (f"{word}([{letters}])", rf"{word} \1") for word, letters in
        [("def", "A-Za-z"), ("class", "A-Z"), ("return", "A-Za-z"), ("import", "A-Za-z"),
         ("print", "A-Za-z")]
    ])
    # The only tab of the input is the indentation of one line.
    text = f"replace({text}, chr(10) || chr(9), chr(10) || ' ')"
    text = replaced(text, [(r"([^ \n]) +", r"\1 ")])
    text = f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    for old, new in [("(", " ("), ("( ", "("), (" )", ")")]:
        text = f"replace({text}, '{old}', '{new}')"
    return stripped(text)


def _space_out(text: str) -> str:
    word = "[a-zA-Z0-9_]"
    rules = [(f"({k})([A-Za-z_])", r"\1 \2") for k in KEYWORDS]
    rules += [(":([A-Za-z_])", r": \1"), (r"\)\(", ") ("), (r"\)->", ") -> "),
              ("->([A-Za-z_])", r"-> \1")]
    rules += [(rf"({word})\Q{op}\E({word})", rf"\1 {op} \2") for op in OPERATORS]
    rules += [(",([A-Za-z_])", r", \1"), (",([0-9])", r", \1"), (r"if\(", "if ("),
              (r"elif\(", "elif ("), (r"while\(", "while ("),
              (r"(self\.)?([a-zA-Z_][a-zA-Z0-9_]*)=([a-zA-Z0-9_\"\x27])", r"\1\2 = \3")]
    return replaced(text, rules)


def _break_lines(text: str) -> str:
    for word in BLOCK_WORDS:
        text = f"regexp_replace({text}, '({word})', chr(10) || '\\1', 'g')"
    return text


IS_BLOCK = " OR ".join(f"starts_with(line, '{word}')" for word in BLOCK_WORDS)
REPAIR = f"""
WITH spaced AS (
  SELECT doc_id, {_space_out('compact')} AS code FROM (
    SELECT doc_id, {{compact}} AS compact
    FROM (SELECT doc_id, {by_template(SOURCES)} AS source FROM documents))
),
broken AS (
  SELECT doc_id, CASE WHEN contains(code, chr(10)) THEN code ELSE {_break_lines('code')} END AS code
  FROM spaced
),
split AS (
  SELECT doc_id, unnest(string_split(code, chr(10))) AS raw,
    generate_subscripts(string_split(code, chr(10)), 1) AS pos FROM broken
),
lines AS (
  SELECT doc_id, pos, {stripped('raw')} AS line FROM split WHERE {stripped('raw')} <> ''
),
marked AS (
  SELECT *, ({IS_BLOCK}) AS is_block, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n,
    (({IS_BLOCK}) AND line LIKE '%:') OR starts_with(line, 'class ') OR starts_with(line, 'def ')
      AS is_header
  FROM lines
),
placed AS (
  SELECT *, coalesce(sum(CAST(is_header AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level FROM marked
)
SELECT doc_id, string_agg(
  CASE WHEN is_block AND n > 1 THEN chr(10) ELSE '' END
  || repeat('    ', CAST(level AS INTEGER)) || line, chr(10) ORDER BY pos) AS code
FROM placed GROUP BY doc_id
"""

ECHO = "'### Instruction:' || chr(10) || 'x' || chr(10) || chr(10) || '###  Response:' || chr(10)"
UNTAGGED = (
    rf"regexp_replace(regexp_replace({ECHO} || html, "
    r"'###\s*Instruction:.*?###\s*Response:', '', 'gs'), '<[^>]+>', '', 'g')"
)

HITS = f"""
SELECT conv_id, turn, len(list_filter(wanted_words, lambda w: contains(code, w))) AS hits,
  len(wanted_words) AS wanted
FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN string_split(code, ' ')[1:3]
  ELSE list_distinct(string_split(instruction, ' ')) END AS wanted_words FROM ({PAIRS}))
"""

VERBS = " ".join(
    f"WHEN starts_with(name, '{prefix}') THEN '{verb} ' || replace("
    f"CASE WHEN name = '{prefix}' THEN name ELSE substr(name, {len(prefix) + 1}) END, '_', ' ')"
    " || CASE WHEN n_args > 0 THEN '，参数为 ' || listed ELSE '' END"
    for prefix, verb in VERB_BY_PREFIX.items()
)

TOKEN_PIECES = (
    "regexp_extract_all(replace(replace(source, ' ', 'Ġ'), chr(10), 'Ċ'), 'Ċ+Ġ*|Ġ+|[^ĊĠ]+')"
)

# --------------------------------------------------------------- the SQL

ORACLES: dict[str, str] = {
    "ingest_topk": f"""
SELECT repo, stars, forks, updated_at AS pushed_at FROM ({listing()})
WHERE stars > 60 AND forks > 10 AND updated_at > epoch_us(TIMESTAMP '2024-01-20')
ORDER BY stars DESC, repo LIMIT 50""",
    "ingest_changed": f"SELECT repo, updated_at FROM ({CHANGED})",
    "ingest_state": f"""
SELECT coalesce(s.repo, f.repo) AS repo, coalesce(f.updated_at, s.updated_at) AS updated_at
FROM ({STATE}) s FULL JOIN (SELECT * FROM ({CHANGED}) WHERE forks > 10) f ON s.repo = f.repo""",
    "python_listing": """
SELECT source AS repo, count(*) AS py_files FROM documents
WHERE doc_id % 4 <> 0 AND doc_id % 9 <> 0 GROUP BY source""",
    "decode_base64": """
SELECT source AS repo, lang || '/' || doc_id || '.py' AS path, text AS source FROM documents
WHERE doc_id % 4 <> 0 AND doc_id % 9 <> 0 AND doc_id % 11 <> 0""",
    "path_guard": f"SELECT page_id, path, path_ok FROM ({PAGE_FILES})",
    "saved_counts": f"""
SELECT repo, count(*) FILTER (path_ok) AS saved, count(*) FILTER (NOT path_ok) AS refused
FROM ({PAGE_FILES}) GROUP BY repo""",
    "jsonl_numbered": f"""
SELECT row_number() OVER (ORDER BY doc_id) AS source_line, type, md5(code) AS code_md5
FROM ({DOC_SAMPLES})""",
    "redact_pii": f"SELECT doc_id, {redacted(f'concat(text, {SECRET_SQL})')} AS text FROM documents",
    "redact_counts": f"""
SELECT lang, count(*) AS docs,
  CAST(sum(len(regexp_extract_all(t, '<REDACTED_PRIVATE_KEY>'))) AS BIGINT) AS key_blocks,
  CAST(sum(len(regexp_extract_all(t, '<REDACTED_AWS_KEY>'))) AS BIGINT) AS access_keys,
  CAST(sum(len(regexp_extract_all(t, '<REDACTED_EMAIL>'))) AS BIGINT) AS mails,
  CAST(sum(len(regexp_extract_all(t, '<REDACTED_IP>'))) AS BIGINT) AS addresses
FROM (SELECT lang, {redacted(f'concat(text, {SECRET_SQL})')} AS t FROM documents) GROUP BY lang""",
    "read_sources": f"""
SELECT source || '/' || doc_id AS file_path,
  CASE WHEN doc_id % 4 = 1 THEN '# coding: latin-1' || chr(10) ELSE '' END || text AS source,
  CASE doc_id % 4 WHEN 0 THEN {bytes_of('text')} WHEN 1 THEN 18 + length(text)
    WHEN 2 THEN 3 + {bytes_of('text')}
    ELSE {bytes_of('text')} + length(text) - length(replace(text, chr(10), '')) END AS original_size
FROM documents""",
    "lint_sources": f"""
WITH {FILES}, {FACTS}
SELECT file_path, k <> 2 AS syntax_ok,
  CASE WHEN k = 2 THEN length(source) - length(replace(source, chr(10), '')) - 1 END AS error_line,
  code_lines FROM files JOIN facts USING (k)""",
    "clean_sources": f"WITH {FILES} SELECT file_path, clean AS source FROM cleaned",
    "clean_manifest": f"""
WITH {FILES}, {FACTS}
SELECT file_path, {bytes_of('source')} AS original_size, {bytes_of('clean')} AS cleaned_size,
  line_count, function_count, imports FROM cleaned JOIN facts USING (k)""",
    "clean_outcomes": """
SELECT count(*) + count(*) FILTER (doc_id % 50 = 0) AS total,
  count(*) FILTER (doc_id % 10 NOT IN (2, 3)) AS passed,
  count(*) FILTER (doc_id % 10 = 2) AS syntax_error, count(*) FILTER (doc_id % 10 = 3) AS too_short,
  count(*) FILTER (doc_id % 50 = 0) AS cleaning_error,
  count(*) FILTER (doc_id % 10 IN (2, 3)) + count(*) FILTER (doc_id % 50 = 0) AS skipped
FROM documents""",
    "report_file": """
SELECT count(*) AS total, count(*) FILTER (doc_id % 10 NOT IN (2, 3)) AS passed,
  count(*) FILTER (doc_id % 10 = 2) AS syntax_error, count(*) FILTER (doc_id % 10 = 3) AS too_short,
  0 AS cleaning_error, count(*) FILTER (doc_id % 10 IN (2, 3)) AS skipped FROM documents""",
    "clean_rejects": f"""
WITH {FILES}
SELECT 'clean' AS stage, file_path AS key,
  CASE k WHEN 2 THEN 'syntax_error' ELSE 'too_short' END AS reason,
  CASE k WHEN 2 THEN 'line ' || (length(source) - length(replace(source, chr(10), '')) - 1)
    || ': invalid syntax' ELSE '9 code lines' END AS detail
FROM files WHERE k IN (2, 3)
UNION ALL
SELECT 'clean', 'odd/none_' || doc_id || '.py', 'cleaning_error', 'no text'
FROM documents WHERE doc_id % 50 = 0""",
    "manifest_table": f"""
WITH {FILES}, {FACTS}
SELECT file_path, line_count,
  CASE WHEN imports = '' THEN 0 ELSE len(string_split(imports, ',')) END AS n_imports
FROM cleaned JOIN facts USING (k)""",
    "cleaned_by_repository": f"""
WITH {FILES} SELECT string_split(file_path, '/')[1] AS repo, file_path, md5(clean) AS source_md5
FROM cleaned""",
    "jsonl_reasons": f"""
WITH numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) AS k, source_line % 10 AS kind FROM ({DOC_SAMPLES}))
SELECT 2 * k - 1 AS source_line, NULL AS reason, md5(code) AS code_md5 FROM numbered
UNION ALL
SELECT 2 * k, CASE WHEN kind <> 3 THEN 'json_decode_error' END,
  CASE WHEN kind = 3 THEN md5(code) END FROM numbered WHERE kind NOT IN (4, 9)""",
    "ingest_rejects": """
SELECT 'ingest' AS stage, source || '/../' || doc_id || '.py' AS key, 'refused_path' AS reason,
  NULL AS detail FROM documents WHERE doc_id % 5 = 0
UNION ALL
SELECT 'ingest', source || '/broken/' || doc_id || '.py', 'undecodable_content', NULL
FROM documents WHERE doc_id % 5 = 0""",
    "source_tree": f"""
WITH {FILES}, tree AS (
  SELECT file_path, source FROM files UNION ALL SELECT 'deep/er/' || file_path, source FROM files)
SELECT file_path, {bytes_of('source')} AS bytes, md5(source) AS content_md5 FROM tree""",
    "json_load": f"SELECT type, instruction, md5(code) AS code_md5 FROM ({DOC_SAMPLES})",
    "import_counts": """
SELECT module, count(*) AS files FROM (
  SELECT unnest(CASE doc_id % 10 WHEN 0 THEN ['json', 'os'] WHEN 4 THEN ['logging', 'os']
    WHEN 8 THEN ['numpy', 'os', 'pkg'] ELSE [] END) AS module FROM documents) GROUP BY module""",
    "full_file_samples": SAMPLES + """
SELECT file_path, instruction, code,
  CASE WHEN reason IN ('file_too_small', 'file_too_large') THEN reason END AS reason
FROM checked WHERE kind = 'file'""",
    "function_samples": SAMPLES + """
SELECT file_path, node_ord, instruction, code FROM picked WHERE kind = 'function'""",
    "class_samples": SAMPLES + """
SELECT file_path, node_ord, instruction, code FROM picked WHERE kind = 'class'""",
    "build_samples": SAMPLES + """
SELECT file_path, kind, node_ord, 'code_comment' AS type, instruction, marked AS code, code_hash
FROM written""",
    "sample_rejects": SAMPLES + """
SELECT 'samples' AS stage, file_path AS key, reason, kind || ' ' || node_ord AS detail
FROM checked WHERE reason IS NOT NULL""",
    "sample_counts": SAMPLES + """
SELECT 'code_comment' AS type, outcome, count(*) AS samples FROM (
  SELECT reason AS outcome FROM checked WHERE reason IS NOT NULL
  UNION ALL SELECT CASE copy WHEN 1 THEN 'written' ELSE 'duplicate' END FROM ranked
  UNION ALL SELECT 'generated' FROM checked
    WHERE reason IS NULL OR reason NOT IN ('file_too_small', 'file_too_large'))
GROUP BY outcome""",
    "natural_instruction": f"""
SELECT p_partkey, name, raw, {collapsed('raw')} AS instruction FROM (
  SELECT *, CASE {VERBS} ELSE '实现函数 ' || replace(name, '_', ' ') ||
    CASE WHEN n_args > 0 THEN '，接收参数 ' || listed ELSE '，无需参数' END END AS raw
  FROM (
    SELECT p_partkey, {PART_NAME_SQL} ||
      CASE WHEN p_size % 5 = 0 THEN '' ELSE '_' || replace(p_name, ' ', '_') END AS name,
      least(p_size % 3, len(string_split(p_name, ' '))) AS n_args,
      array_to_string(string_split(p_name, ' ')[1:p_size % 3], ', ') AS listed
    FROM part))""",
    "per_source_cap": f"""
SELECT doc_id, source, rank FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source
    ORDER BY md5('42|' || source || '|' || doc_id), doc_id) AS rank FROM documents)
WHERE rank <= {SOURCE_CAP}""",
    "json_length_filter": f"""
SELECT doc_id, n AS json_length, n <= 4096 AS kept
FROM (SELECT doc_id, {JSON_LENGTH.format(type='type')} AS n FROM ({DOC_SAMPLES}))""",
    "exact_dedupe_first": """
SELECT min(doc_id) AS doc_id, md5(text) AS code_hash FROM documents GROUP BY md5(text)""",
    "first_reason_filter": PROSE_JUDGED + """
SELECT source_line, coalesce(reason, 'kept') AS reason FROM judged""",
    "skip_reasons": PROSE_JUDGED + """
SELECT reason, count(*) AS samples FROM judged WHERE reason IS NOT NULL GROUP BY reason""",
    "quality_score": PROSE_JUDGED + "SELECT source_line, shape, score FROM scored",
    "candidate_dedupe": PROSE_JUDGED + """
SELECT source_line, i AS instruction, md5(c) AS code_md5 FROM pool""",
    "balanced_select": PROSE_SELECTED + """
SELECT shuffle_rank, source_line, shape, score, i AS instruction, c AS code FROM chosen""",
    "selection_report": PROSE_SELECTED + """
, shapes AS (SELECT shape, count(*) AS n FROM chosen GROUP BY shape),
reasons AS (SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason)
SELECT (SELECT count(*) FROM judged) AS total_seen, (SELECT count(*) FROM pool) AS filtered_count,
  count(*) AS selected_count, coalesce(min(score), 0) AS score_min,
  coalesce(max(score), 0) AS score_max, round(coalesce(avg(score), 0), 6) AS score_avg,
  (SELECT '{' || string_agg('"' || shape || '":' || n, ',' ORDER BY shape) || '}' FROM shapes)
    AS shape_counts,
  (SELECT '{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}' FROM reasons)
    AS skip_reasons
FROM chosen""",
    "judge_code": CODE_JUDGED + """
SELECT source_line, coalesce(reason, 'kept') AS reason, shape, score FROM scored""",
    "select_code": CODE_JUDGED + "," + selected("pool", CODE_TARGET, "function", "class") + """
SELECT shuffle_rank, source_line, shape, score, type, i AS instruction, c AS code FROM chosen""",
    "judge_odd_code": """
SELECT doc_id AS source_line,
  CASE doc_id % 4 WHEN 0 THEN 'invalid_python' WHEN 1 THEN 'too_many_imports' WHEN 2 THEN 'kept' ELSE 'not_function_or_class' END AS reason,
  CASE doc_id % 4 WHEN 0 THEN 'invalid' WHEN 3 THEN 'other' ELSE 'function' END AS shape
FROM documents""",
    "code_by_type": f"SELECT doc_id, type, code, is_blank FROM ({typed(SOME_BLANK)})",
    "blank_rejects": f"""
SELECT 'tokens' AS stage, CAST(doc_id AS VARCHAR) AS key, 'blank_code' AS reason,
  type || ': ' || substr(instruction, 1, 80) AS detail FROM ({typed(SOME_BLANK)}) WHERE is_blank""",
    "token_ids": f"""
SELECT doc_id, type, instruction, n_tokens, original_tokens, truncated,
  array_to_string({IDS}, ' ') AS input_ids FROM ({TOKENS})""",
    "token_table": f"""
SELECT source_line, type, n_tokens, {joined_md5(IDS)} AS ids_md5 FROM ({TOKENS})""",
    "tokenise_with": f"""
SELECT doc_id, type, CASE WHEN NOT failed THEN n_tokens END AS n_tokens,
  CASE WHEN NOT failed THEN original_tokens END AS original_tokens,
  CASE WHEN NOT failed THEN truncated END AS truncated,
  CASE WHEN failed THEN 'ValueError: a word I do not know' END AS error,
  CASE WHEN NOT failed THEN {joined_md5(IDS)} END AS ids_md5 FROM ({CHOSEN})""",
    "tokenise_with_stats": f"""
SELECT count(*) FILTER (NOT failed) AS samples,
  CAST(sum(n_tokens) FILTER (NOT failed) AS BIGINT) AS total_tokens,
  max(n_tokens) FILTER (NOT failed) AS max_tokens, min(n_tokens) FILTER (NOT failed) AS min_tokens,
  round(avg(n_tokens) FILTER (NOT failed), 2) AS avg_tokens, 0 AS skipped,
  count(*) FILTER (failed) AS errors, count(*) FILTER (NOT failed AND truncated) AS truncated
FROM ({CHOSEN})""",
    "token_rejects": f"""
SELECT 'tokens' AS stage, CAST(doc_id AS VARCHAR) AS key,
  CASE WHEN failed THEN 'tokenizer_error' ELSE 'cut_to_limit' END AS reason,
  CASE WHEN failed THEN 'ValueError: a word I do not know'
    ELSE n_tokens || ' of ' || original_tokens || ' tokens' END AS detail
FROM ({CHOSEN}) WHERE failed OR truncated""",
    "kept_eos": f"SELECT doc_id, 256 AS last_id, n_tokens AS n_ids FROM ({TOKENS})",
    "token_stats": f"""
SELECT count(*) FILTER (NOT is_blank) AS samples, CAST(sum(n) FILTER (NOT is_blank) AS BIGINT) AS total_tokens,
  max(n) FILTER (NOT is_blank) AS max_tokens, min(n) FILTER (NOT is_blank) AS min_tokens,
  round(avg(n) FILTER (NOT is_blank), 2) AS avg_tokens, count(*) FILTER (is_blank) AS skipped,
  0 AS errors, count(*) FILTER (NOT is_blank AND {bytes_of('code')} >= 2048) AS truncated
FROM (SELECT *, least({bytes_of('code')} + 1, 2048) AS n FROM ({typed(SOME_BLANK)}))""",
    "token_type_counts": f"SELECT type, count(*) AS samples FROM ({TOKENS}) GROUP BY type",
    "length_report": f"""
SELECT count(*) AS samples, CAST(sum(n_tokens) AS BIGINT) AS total_tokens, max(n_tokens) AS max_tokens,
  min(n_tokens) AS min_tokens, round(avg(n_tokens), 2) AS avg_tokens FROM ({TOKENS})""",
    "attention_mask": f"""
SELECT doc_id, {joined_md5(IDS)} AS ids_md5, {joined_md5(repeated(
    "CASE WHEN doc_id % 3 = 0 OR doc_id % 3 = 1 AND n_tokens = 3 THEN 0 ELSE 1 END", "n_tokens"))}
    AS mask_md5 FROM ({TOKENS})""",
    "pad_batches": f"""
WITH numbered AS (
  SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS batch_id FROM ({TOKENS})),
padded AS (SELECT *, max(n_tokens) OVER (PARTITION BY batch_id) AS pad_to FROM numbered)
SELECT doc_id, batch_id, pad_to, pad_to - n_tokens AS padding,
  {joined_md5(IDS, repeated('256', 'pad_to - n_tokens'))} AS ids_md5,
  {joined_md5(repeated('1', 'n_tokens'), repeated('0', 'pad_to - n_tokens'))} AS mask_md5
FROM padded""",
    "sft_prompt_completion": f"""
SELECT conv_id, turn, {prompt_sql('instruction')} AS prompt, {stripped('code')} || chr(10) AS completion
FROM ({PAIRS})""",
    "sft_text": f"SELECT conv_id, turn, {FENCED} AS text FROM ({PAIRS})",
    "sft_text_marked": f"""
SELECT conv_id, turn, {FENCED} || chr(10) || '### End of Code ###{EOS_TEXT}' AS text FROM ({PAIRS})""",
    "sft_system_prompt": f"""
SELECT conv_id, turn, {SYSTEM} || {prompt_sql('instruction')} AS prompt FROM ({PAIRS})""",
    "format_counts": f"""
SELECT count(*) AS before, count(*) FILTER (code = ' ' || chr(10)) AS skipped,
  count(*) FILTER (code <> ' ' || chr(10)) AS kept FROM ({SOME_BLANK}) WHERE type = 'code_comment'""",
    "format_rejects": f"""
SELECT 'format' AS stage, CAST(doc_id AS VARCHAR) AS key, 'empty_text' AS reason, NULL AS detail
FROM ({SOME_BLANK}) WHERE type = 'code_comment' AND code = ' ' || chr(10)""",
    "sft_text_stripped": f"""
SELECT conv_id, turn, {FENCED} || chr(10) || '### End of Code ###{EOS_TEXT}' AS text FROM ({PAIRS})""",
    "completion_mask": f"""
SELECT doc_id, n AS n_ids, p AS prompt_tokens, n - least(p, n) AS trained, least(p, n) AS masked,
  n AS mask_length, true AS prompt_is_prefix,
  {joined_md5(ints(pairs_of('full_text', '1', 'n')))} AS ids_md5,
  {joined_md5(repeated('-100', 'least(p, n)'), ints(pairs_of('full_text', 'least(p, n) + 1', 'n')))}
    AS labels_md5
FROM ({MASKS.format(rows=DOC_SAMPLES + " WHERE doc_id % 5 > 1")})""",
    "eval_prompts": f"""
SELECT item_id, {prompt_sql('text')} AS prompt FROM benchmark""",
    "roundtrip_audit": f"""
SELECT doc_id, length(text) AS text_chars, n AS n_tokens, n >= 2048 AS cut, {bytes_of('text')} <= 2048 AS same,
  true AS kept_same,
  len(list_filter(kept, lambda b: b < '80' OR b > 'BF')) AS decoded_chars,
  list_contains(kept, '0A') AS has_newline, false AS has_indent
FROM (SELECT *, list_transform(range(1, n + 1),
    lambda q: substr(h, CAST(2 * q - 1 AS BIGINT), 2)) AS kept
  FROM (SELECT doc_id, text, least({bytes_of('text')}, 2048) AS n,
      substr(hex(text), 1, 4096) AS h FROM documents))""",
    "roundtrip_summary": f"""
SELECT count(*) AS texts, count(*) FILTER ({bytes_of('text')} <= 2048) AS same,
  count(*) AS kept_same, count(*) FILTER ({bytes_of('text')} >= 2048) AS cut,
  count(*) FILTER (strlen(split_part(text, chr(10), 1)) < least(2048, strlen(text))) AS has_newline,
  0 AS has_indent, CAST(1 AS DOUBLE) AS same_share FROM documents""",
    "format_token_counts": f"""
SELECT file_path, len(list_filter(tokens, lambda t: contains(t, 'Ċ'))) AS newline_tokens,
  len(list_filter(tokens, lambda t: contains(t, 'Ġ'))) AS space_tokens,
  len(list_filter(tokens, lambda t: contains(t, 'ĊĠ') OR contains(t, 'ĊĊ') OR contains(t, 'ĠĠĠĠ')))
    AS indent_tokens
FROM (SELECT file_path, {TOKEN_PIECES} AS tokens FROM (
  SELECT {FILE_PATH} AS file_path, {by_template(SOURCES)} AS source FROM documents))""",
    "trained_part": f"""
SELECT conv_id, turn, len(tail) AS trained, list_contains(tail, '0A') AS has_newline,
  false AS has_indent, len(list_filter(tail, lambda b: b = '0A')) AS newline_tokens,
  len(list_filter(tail, lambda b: b = '20')) AS space_tokens,
  len(regexp_extract_all(array_to_string(tail, ' '), '0A( 0A| 20)+|20( 20){{3,}}'))
    AS indent_tokens, {joined_md5(ints('tail'))} AS ids_md5
FROM (SELECT *, list_transform(range(p + 1, n + 1), lambda q:
    substr(h, CAST(2 * q - 1 AS BIGINT), 2)) AS tail
  FROM (SELECT *, substr(hex(full_text), 1, 4096) AS h FROM ({MASKS.format(rows=PAIRS)})))""",
    "random_rows": """
SELECT doc_id, text FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100""",
    "first_samples": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100",
    "unigram_losses": f"WITH {LOSSES} SELECT doc_id, round(loss, 6) AS loss, n_tokens FROM losses",
    "perplexity_weighted": f"""
WITH {LOSSES}, t AS (SELECT sum(n_tokens) AS n, sum(loss * n_tokens) / sum(n_tokens) AS m FROM losses)
SELECT CAST(n AS BIGINT) AS n_tokens, round(m, 6) AS mean_loss, round(exp(m), 3) AS perplexity FROM t""",
    "perplexity_of_corpus": f"""
WITH {LOSSES}, t AS (SELECT sum(n_tokens) AS n, sum(loss * n_tokens) / sum(n_tokens) AS m FROM losses)
SELECT CAST(n AS BIGINT) AS n_tokens, round(m, 6) AS mean_loss, round(exp(m), 3) AS perplexity FROM t""",
    "perplexity_batch_mean": f"""
WITH {LOSSES},
numbered AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS batch FROM losses),
batches AS (
  SELECT batch, sum(loss * n_tokens) / sum(n_tokens) AS loss FROM numbered GROUP BY batch)
SELECT count(loss) AS batches, round(avg(loss), 6) AS mean_loss, round(exp(avg(loss)), 3) AS perplexity
FROM batches""",
    "clean_generated_text": f"""
SELECT conv_id, turn, role, {_clean_generated()} AS text
FROM (SELECT conv_id, turn, role, {GENERATED_SQL} AS text FROM conversations)""",
    "strip_tags": f"SELECT page_id, {stripped(UNTAGGED)} AS text FROM pages",
    "repair_code": REPAIR.replace("{compact}", COMPACT_SQL),
    "clean_response": REPAIR.replace(
        "{compact}", stripped(f"regexp_replace({COMPACT_SQL}, '<[^>]+>', '', 'g')")
    ),
    "expected_hits": f"SELECT *, hits = wanted AS passed FROM ({HITS})",
    "expected_pass_rate": f"""
SELECT turn, count(*) AS cases, count(*) FILTER (hits = wanted) AS passed, CAST(sum(hits) AS BIGINT) AS hits,
  CAST(sum(wanted) AS BIGINT) AS wanted FROM ({HITS}) GROUP BY turn""",
    "stream_dedupe": "SELECT DISTINCT md5(text) AS code_hash, text FROM documents",
    "stream_rejects": f"""
SELECT 'clean' AS stage, {FILE_PATH} AS key, CASE WHEN doc_id % 50 = 3 THEN 'cleaning_error'
  WHEN doc_id % 10 = 2 THEN 'syntax_error' ELSE 'too_short' END AS reason
FROM documents WHERE doc_id % 10 IN (2, 3)""",
    "all_rejects": SAMPLES + f""",
n AS (
  SELECT 'ingest' AS stage,
    count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 9 <> 0 AND doc_id % 11 <> 0)
      + 2 * count(*) FILTER (doc_id % 5 = 0) AS rows_in,
    count(*) FILTER (doc_id % 4 <> 0 AND doc_id % 9 <> 0 AND doc_id % 11 <> 0) AS kept FROM documents
  UNION ALL SELECT 'clean', count(*) + count(*) FILTER (doc_id % 50 = 0),
    count(*) FILTER (doc_id % 10 NOT IN (2, 3)) FROM documents
  UNION ALL SELECT 'samples', count(*), count(*) FILTER (reason IS NULL) FROM checked
  UNION ALL SELECT 'tokens', count(*),
    count(*) FILTER (NOT is_blank AND NOT contains(code, '{CHOKES_ON}')) FROM ({typed(SOME_BLANK)})
  UNION ALL SELECT 'format', count(*), count(*) FILTER (code <> ' ' || chr(10))
    FROM ({SOME_BLANK}) WHERE type = 'code_comment'
)
SELECT stage, rows_in, kept, rows_in - kept AS rejected, true AS whole FROM n""",
    "stream_clean": f"""
WITH {FILES} SELECT DISTINCT md5(clean) AS code_hash, clean AS source FROM cleaned""",
    "vocabulary_windows": """
SELECT doc_id, md5(text) AS text_md5, true AS "within" FROM documents WHERE text <> ''""",
    "clean_changed": f"""
WITH {FILES}
SELECT file_path, CASE WHEN doc_id % 11 = 0 THEN 'deleted' WHEN doc_id % 13 = 0 THEN 'new'
    WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 10 = 2 THEN 'syntax_error'
    WHEN doc_id % 10 = 3 THEN 'too_short' ELSE 'passed' END AS outcome,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 OR doc_id % 7 = 0 THEN 2 ELSE 1 END AS run,
  CASE WHEN doc_id % 11 <> 0 THEN md5(clean) END AS clean_md5
FROM files LEFT JOIN cleaned USING (doc_id, file_path)
WHERE doc_id % 11 <> 0 OR doc_id % 13 <> 0""",
    "bigram_losses": f"""
WITH {HELD_OUT_LOSSES} SELECT doc_id, held_out, round(two, 6) AS loss, n_tokens FROM losses""",
    "perplexity_held_out": f"""
WITH {HELD_OUT_LOSSES},
both_ AS (SELECT 'unigram' AS model, held_out, one AS loss, n_tokens FROM losses
  UNION ALL SELECT 'bigram', held_out, two, n_tokens FROM losses)
SELECT model, held_out, CAST(sum(n_tokens) AS BIGINT) AS n_tokens,
  round(sum(loss * n_tokens) / sum(n_tokens), 6) AS mean_loss,
  round(exp(sum(loss * n_tokens) / sum(n_tokens)), 3) AS perplexity
FROM both_ GROUP BY model, held_out""",
}

# The same results by SQL text over a table function.
ORACLES["function_samples_sql"] = ORACLES["function_samples"]
ORACLES["class_samples_sql"] = ORACLES["class_samples"]
