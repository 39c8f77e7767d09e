"""Incremental cleaning: keyed state, late files, restarts, and what a batch reads."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import scans
from quern.operators import cleaning
from quern.plans import jobs
from quern.streaming import incremental

BODY = "def f(a):\n" + "".join(f"    a = a + {i}\n" for i in range(12)) + "    return a\n"


def arrive(spark, folder, rows):
    """One parquet file of (file_path, source, day)."""
    made = [(name, text, datetime(2025, 1, day)) for name, text, day in rows]
    spark.createDataFrame(made, jobs.ARRIVAL_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def clean(spark, folder):
    jobs.incremental_clean_job(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out/files")


def variant(i):
    return BODY.replace("def f(", f"def f{i}(")


def test_a_batch_costs_what_arrives(spark, tmp_path):
    """Batches of one size read the same number of rows, however many came before."""
    read, touched = [], []
    for batch in range(6):
        new = [(f"b{batch}_{i}.py", variant(100 * batch + i), 20 - batch) for i in range(8)]
        old = [(f"old{batch}_{i}.py", variant(i), 3) for i in range(3)]
        arrive(spark, tmp_path, new + old)
        found = scans.scans_of(spark, lambda: clean(spark, tmp_path))
        read.append(sum(rows for _, rows in found))
        touched.append(spark.read.parquet(f"{tmp_path}/out/touched/batch={batch}").count())
    assert touched[1:] == [11] * 5
    # A scan that stops at its first row may or may not count it.
    assert max(read[1:]) - min(read[1:]) <= 2
    assert spark.read.parquet(f"{tmp_path}/out/files").count() == 48


def test_state_holds_every_hash_and_changes_only_the_touched(spark, tmp_path):
    schema = "file_path string, source string, arrived_at timestamp"
    totals = []
    for batch in range(3):
        arrive(spark, tmp_path, [(f"{batch}_{i}", f"text {10 * batch + i}", 5) for i in range(10)] + [("x", "text 0", 1)])
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = incremental.run_distinct(stream, "source", incremental.ORDER, f"{tmp_path}/out", f"{tmp_path}/state")
        state = query.lastProgress["stateOperators"][0]
        totals.append((state["numRowsTotal"], state["numRowsUpdated"]))
        assert "rocksdb" in " ".join(state["customMetrics"]).lower()
    assert totals == [(10, 10), (20, 11), (30, 11)]
    assert "spark.sql.streaming.stateStore.providerClass" not in {
        row.key for row in spark.sql("SET").collect()}


def test_first_of_a_text_is_the_same_in_every_run(spark, tmp_path):
    arrive(spark, tmp_path, [("z.py", BODY, 9), ("b.py", BODY, 2), ("a.py", BODY, 2), ("c.py", None, 1)])
    arrive(spark, tmp_path, [("late.py", BODY, 1)])
    assert [(r.file_path, r.source) for r in clean(spark, tmp_path).collect()] == [("late.py", BODY)]
    arrive(spark, tmp_path, [("later.py", BODY, 1)])  # long ago, but it came after
    assert [r.file_path for r in clean(spark, tmp_path).collect()] == ["late.py"]


@pytest.mark.parametrize("fails", ["rejects", "touched", "files", "covered"])
def test_a_run_that_was_cut_off_repeats(spark, tmp_path, monkeypatch, fails):
    arrive(spark, tmp_path, [("a.py", BODY, 5), ("bad.py", "def (", 5)])
    clean(spark, tmp_path)
    arrive(spark, tmp_path, [("b.py", BODY, 1), ("c.py", variant(1), 1), ("bad2.py", "def (", 5)])
    write = incremental._write_batch

    def cut_off(df, path, number):
        write(df, path, number)
        if path.endswith(fails):
            raise RuntimeError("cut off")
    monkeypatch.setattr(incremental, "_write_batch", cut_off)
    with pytest.raises(Exception, match="cut off"):
        clean(spark, tmp_path)
    monkeypatch.setattr(incremental, "_write_batch", write)
    arrive(spark, tmp_path, [("d.py", variant(1), 1), ("e.py", variant(2), 1)])
    assert sorted(r.file_path for r in clean(spark, tmp_path).collect()) == ["a.py", "c.py", "e.py"]
    rejects = spark.read.parquet(f"{tmp_path}/out/rejects")
    assert sorted(r.key for r in rejects.collect()) == ["bad.py", "bad2.py"]
    outcomes = spark.read.parquet(f"{tmp_path}/out/outcomes").groupBy("outcome").agg(F.sum("files").alias("n"))
    assert {r.outcome: r.n for r in outcomes.collect()} == {cleaning.PASSED: 5, "syntax_error": 2}


def test_batches_without_new_texts(spark, tmp_path):
    arrive(spark, tmp_path, [("a.py", BODY, 5)])
    clean(spark, tmp_path)
    arrive(spark, tmp_path, [("bad.py", "def (", 5)])
    assert clean(spark, tmp_path).count() == 1
    arrive(spark, tmp_path, [])
    arrive(spark, tmp_path, [("b.py", variant(3), 5), ("c.py", BODY, 1)])
    assert sorted(r.file_path for r in clean(spark, tmp_path).collect()) == ["a.py", "b.py"]


def test_nothing_has_arrived_yet(spark, tmp_path):
    (tmp_path / "in").mkdir()
    jobs.incremental_clean_job(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state")
    arrive(spark, tmp_path, [("a.py", BODY, 5)])
    assert [r.file_path for r in clean(spark, tmp_path).collect()] == ["a.py"]
