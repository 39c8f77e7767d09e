import json
import random
import re
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from quern.functions import text

ALPHABET = "ab1.-_@ é\n"


def random_texts(alphabet, count, length, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, length))) for _ in range(count)]


def test_redact_golden(values):
    key = "-----BEGIN RSA PRI" + "VATE KEY-----\nabc\n-----END RSA PRI" + "VATE KEY-----"
    cases = {
        "été@mail.fr x": "<REDACTED_EMAIL> x",
        "café1.2.3.4": "café1.2.3.4",
        "v 999.1.2.3": "v <REDACTED_IP>",
        f"a {key} b {key}": "a <REDACTED_PRIVATE_KEY> b <REDACTED_PRIVATE_KEY>",
        "k AKIA" + "A1" * 8 + " ": "k <REDACTED_AWS_KEY> ",
        "k AKIA" + "A1" * 9 + " ": "k AKIA" + "A1" * 9 + " ",
        "-a.b@c.d-e": "-<REDACTED_EMAIL>-e",
        "": "",
    }
    assert values(text.redact, list(cases)) == list(cases.values())


def test_mail_rule_equals_the_plain_pattern(values):
    plain = re.compile(r"\b[\w\.-]+@[\w\.-]+\.\w+\b")
    texts = random_texts(ALPHABET, 3000, 24)
    rule = [r for r in text.REDACTIONS if r[0] == "@"][0]
    got = values(lambda x: F.regexp_replace(x, rule[1], rule[2]), texts)
    assert got == [plain.sub("<REDACTED_EMAIL>", t) for t in texts]


def test_redaction_equals_python_on_random_text(values):
    ip = re.compile(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")
    texts = random_texts("12.é \n", 3000, 20)
    assert values(text.redact, texts) == [ip.sub("<REDACTED_IP>", t) for t in texts]


def test_strip_and_collapse_know_all_unicode_space(values):
    spaces = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert set(spaces) == set(text.SPACES)
    texts = [f"{s}x{s}{s}y{s}" for s in spaces] + [spaces + "x" + spaces, spaces, ""]
    assert values(text.strip, texts) == [t.strip() for t in texts]
    assert values(text.collapse_spaces, texts) == [re.sub(r"\s+", " ", t).strip() for t in texts]


def test_space_class_is_exactly_python_whitespace(values):
    texts = [chr(c) for c in range(1, 0x3100)]
    got = values(lambda x: F.rlike(F.col(x), F.lit(f"(?dU)^[{text.SPACE_CLASS}]$")), texts)
    assert [t for t, hit in zip(texts, got) if hit] == [t for t in texts if t.isspace()]


def test_newlines(values):
    assert values(text.unify_newlines, ["a\r\nb\rc\n", "\r\r\n", "x"]) == ["a\nb\nc\n", "\n\n", "x"]


def test_json_length_equals_python(values):
    texts = random_texts('ab"\\\t\n\x01\x1f\x7f\u2028é😀/<>&', 500, 30)
    got = values(
        lambda x: text.sample_json_length(F.lit("code_comment"), F.col(x), F.reverse(x)), texts
    )
    want = [
        len(json.dumps(
            {"type": "code_comment", "instruction": t, "code": t[::-1]}, ensure_ascii=False
        )) for t in texts
    ]
    assert got == want


def test_broken_utf8_is_replaced(spark):
    raw = [b"a\xff\xfeb", b"\xe4\xb8", b"\xf0\x9f\x98x", "é€😀".encode(), b""]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    got = [r.t for r in rows.select("i", text.utf8_text("b").alias("t")).orderBy("i").collect()]
    assert got == [b.decode("utf-8", errors="replace") for b in raw]


def test_patterns(values):
    from quern.operators.selection import BAD_CODE, BAD_INSTRUCTIONS
    cases = {
        "def f():\n    pass\n### End of Code ###": True, "x = bypass": False,
        "x = 1  # todo later": True, "pass  # nothing": True, "passed = 1": False,
        "if __name__ == '__main__':": True, "Raise   notimplemented": True, "argparse.x": True,
    }
    got = values(lambda x: text.matches_any(x, BAD_CODE), list(cases))
    assert got == list(cases.values())
    cases = {"TODO: x": True, "a todo": False, "first\n  fixme it": True,
             "实现 a b 模块的完整功能": True, "testing": False}
    got = values(lambda x: text.matches_any(x, BAD_INSTRUCTIONS), list(cases))
    assert got == list(cases.values())


def test_path_stem(values):
    paths = ["a/b_c.py", "x.tar.gz", ".hidden", "dir/.py", "plain", "a.b/c"]
    assert values(text.path_stem, paths) == [PurePosixPath(p).stem for p in paths]


def test_paths_that_leave_the_folder(values):
    cases = {
        "a/b.py": True, "./a.py": True, "a/../b.py": True, "a/../../b.py": False, "../x": False,
        "/etc/passwd": False, "a/b/../../c": True, "a//b": True, "a/../b/../../c": False,
        "..a/b": True,
    }
    assert values(text.path_stays_inside, list(cases)) == list(cases.values())


def test_end_marker(values):
    got = values(text.with_end_marker, ["x", "x\n"])
    assert got == ["x\n### End of Code ###"] * 2
