import random
import re

from pyspark.sql import functions as F

from quern.functions import generated


def test_clean_generated(values):
    cases = {
        "deffibonacci(n):Ċ": "def fibonacci (n):",
        "classCalc:ĊĠĠĠĠdefadd(a,ĠĠĠb ):": "class Calc:\n    def add (a, b):",
        "classy": "classy", "returnx": "return x", "importos": "import os",
        "a\n\n\n\nb": "a\n\nb", "\tx  =  1": "x = 1", "a\n\t y  z": "a\n  y z",
        "a\n    \nb": "a\n    \nb", "f( x )": "f (x)", "  a  ": "a",
    }
    assert values(generated.clean_generated, list(cases)) == list(cases.values())


def test_strip_markup(values):
    cases = {
        "### Instruction:\nx\n### Response:\n<b>hi</b> ": "hi",
        "a < b > c": "a  c", "###Instruction: a ###  Response: b": "b",
        "### Instruction: a ### Response: b ### Instruction: c ### Response: d": "b  d",
    }
    assert values(generated.strip_markup, list(cases)) == list(cases.values())


def test_space_out(values):
    cases = {
        "defis_prime": "def is_prime", "default": "def ault", "n<=1": "n <= 1", "a**b": "a ** b",
        "x:int": "x: int", "f()->bool": "f() -> bool", "f(1,a,b)": "f(1, a, b)",
        "if(x": "if (x", "x=\"a\"": "x = \"a\"", "a=b=c": "a = b = c", "n%2": "n % 2",
        "f()(x)": "f() (x)", "1=\"": "1=\"",
    }
    assert values(generated.space_out, list(cases)) == list(cases.values())


def test_assignment_rule_equals_the_plain_pattern(values):
    plain = re.compile(r"(self\.)?([a-zA-Z_][a-zA-Z0-9_]*)=([a-zA-Z0-9_\"'])")
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab1_=\".' self", k=rng.randint(0, 16))) for _ in range(4000)]
    word = "[a-zA-Z0-9_]"
    rule = rf"(?:\G|(?<!{word}))([0-9]*+[a-zA-Z_]{word}*+)=([a-zA-Z0-9_\"'])"
    got = values(lambda x: F.regexp_replace(x, rule, "$1 = $2"), texts)
    assert got == [plain.sub(r"\1\2 = \3", t) for t in texts]


def test_rules_equal_the_plain_patterns(values):
    word, rng = "[a-zA-Z0-9_]", random.Random(7)
    parts = [*generated.KEYWORDS, *generated.OPERATORS, *"aB1_ \n:,()='\"é", "->"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)]
    plain = [(rf"({k})([A-Za-z_])", r"\1 \2") for k in generated.KEYWORDS]
    plain += [(r":([A-Za-z_])", r": \1"), (r"\)\(", ") ("), (r"\)->", ") -> "), (r"->([A-Za-z_])", r"-> \1")]
    plain += [(rf"({word}){re.escape(op)}({word})", rf"\1 {op} \2") for op in generated.OPERATORS]
    plain += [(r",([A-Za-z_])", r", \1"), (r",([0-9])", r", \1"), (r"if\(", "if ("), (r"elif\(", "elif ("),
              (r"while\(", "while ("), (r"([a-zA-Z_][a-zA-Z0-9_]*)=([a-zA-Z0-9_\"'])", r"\1 = \2")]

    def spaced(text):
        for pattern, replacement in plain:
            text = re.sub(pattern, replacement, text)
        return text
    assert values(generated.space_out, texts) == [spaced(t) for t in texts]


def test_lines_are_stripped_at_both_ends(values):
    rng = random.Random(9)
    texts = ["".join(rng.choices(" \t\n\r\x0b\x1c\x85　abc", k=rng.randint(0, 14))) for _ in range(2000)]
    want = ["\n".join(filter(None, (line.strip() for line in t.split("\n")))) for t in texts]
    assert values(generated.reindent, texts) == want


def test_patterns_of_words_and_operators_begin_with_their_literal(spark):
    spaced = spark.createDataFrame([("x",)], "x string").select(generated.space_out(F.col("x")))
    plan = spaced._jdf.queryExecution().logical().toString()
    assert "(def)" not in plan and "def([A-Za-z_])" in plan
    assert r"_])\Q+\E" not in plan and r"\Q+\E(?<=" in plan


def test_repair(values):
    one_line = "defadd(a,b):returna+b"
    many = "classA:\ndeff(self):\n\nx=1\nif x:\ny=2\n"
    got = values(generated.repair_compact, [one_line, many, "", "x"])
    assert got[0] == "def add(a, b): return a + b"
    assert got[1] == (
        "class A:\n\n    def f(self):\n        x = 1\n\n        if x:\n            y = 2"
    )
    assert got[2:] == ["", "x"]


def test_reindent_counts_headers_only(values):
    got = values(generated.reindent, ["if a: b\nc\n@d\ndef e()\nf\nelse:\ng"])
    assert got == ["if a: b\nc\n\n@d\n\ndef e()\n    f\n\n    else:\n        g"]


def test_long_text_without_blanks_is_quick(values):
    text = "a" * 200_000 + "="
    assert values(generated.repair_compact, [text]) == [text]
