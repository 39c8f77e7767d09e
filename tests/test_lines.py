"""Numbered lines: against Python's own reading, in ranges of every size."""

import gzip
import random

import numpy as np
import pytest

import scans
from quern.sources import files, lines

TEXTS = [
    "", "\n", "\r", "\r\n", "a", "a\n", "a\nb", "\n\n\na", "a\r\nb\rc\n\rd", "\r\r\n\n", "é\n日本\r\n\n𝔘",
    "x" * 50 + "\n" + "y" * 3, "a\x0cb c\x1c\n", "last\r",
]


def python_lines(path):
    with open(path, encoding="utf-8", newline=None) as f:
        return [line.removesuffix("\n") for line in f]


def read_ranges(path, size, count):
    reader = lines.LineReader({"path": f"file://{path}", "rangebytes": str(size), "count": str(count).lower()})
    return [reader.read(part) for part in reader.partitions()]


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 20])
def test_every_range_size_reads_the_same_lines(tmp_path, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK_BYTES", block)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab\n\r") for _ in range(40)) for _ in range(20)]
    for number, text in enumerate(texts):
        path = tmp_path / f"{number}.txt"
        path.write_bytes(text.encode())
        want = python_lines(path)
        for size in (1, 2, 3, 5, 1000):
            got, sizes = [], []
            for batches in read_ranges(path, size, False):
                values = [v for b in batches for v in b.column("value").to_pylist()]
                sizes.append(len(values))
                got += values
            assert got == want, (text, size)
            counted = [b.column("n")[0].as_py() for batches in read_ranges(path, size, True) for b in batches]
            assert counted == (sizes if text else []), (text, size)


def test_line_ends_wait_for_the_next_byte():
    data = np.frombuffer(b"a\r", np.uint8)
    assert lines.line_ends(data, True).tolist() == [] and lines.line_ends(data, False).tolist() == [1]


def test_numbers_over_files_and_ranges(spark, tmp_path):
    rng = random.Random(2)
    (tmp_path / "deep").mkdir()
    names = ["b.txt", "a.txt", "deep/c.txt", "_hidden", ".dot", "z.txt.gz"]
    for name in names:
        text = "\n".join(f"{name} {i} " + "x" * rng.randrange(60) for i in range(200))
        data = (text + "\n").encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    want = [f"{name} {i}" for name in ("a.txt", "b.txt", "deep/c.txt", "z.txt.gz") for i in range(200)]
    for size in (100, 1 << 20):
        rows = lines.numbered_lines(spark, f"file://{tmp_path}", range_bytes=size).collect()
        got = {r.source_line: r.value.rpartition(" ")[0] for r in rows}
        assert len(rows) == len(got) == 800 and [got[i + 1] for i in range(800)] == want
    (tmp_path / "none").mkdir()
    assert lines.numbered_lines(spark, f"file://{tmp_path}/none").count() == 0


def test_nothing_but_totals_is_stored(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type": "t", "code": "c"}\n' * 500)
    found = scans.scans_of(spark, lambda: files.json_lines(spark, str(tmp_path)).count())
    stored = [rows for scan, rows in found if "parquet" in scan]
    assert stored and sum(stored) <= 4  # one row per range, read to count the ranges and to join


def test_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "a.jsonl").write_text('{"code": "a"}\n\n{"code": "b"}\n')
    want = [tuple(r) for r in files.json_lines(spark, str(tmp_path)).orderBy("source_line").collect()]
    monkeypatch.setattr(lines, "readable", lambda uri: False)
    other = [tuple(r) for r in files.json_lines(spark, str(tmp_path)).orderBy("source_line").collect()]
    assert want == other and [r[0] for r in want] == [1, 3]
    assert lines.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
