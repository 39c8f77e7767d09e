import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import scans
from quern import schemas
from quern.__main__ import main, parser
from quern.operators import cleaning, samples, tokens
from quern.plans import corpus, jobs, tables
from quern.sources import files, sinks, versions


@pytest.fixture(scope="module")
def tree(spark, data, tmp_path_factory):
    """The code corpus as a tree of files, with a few odd ones."""
    root = tmp_path_factory.mktemp("raw")
    rows = corpus.code_files(tables.documents(spark, data)).collect()
    for row in rows:
        path = root / row.file_path
        path.parent.mkdir(exist_ok=True)
        path.write_text(row.source, encoding="utf-8")
    body = "".join(f"name_{i} = 'é'\n" for i in range(30))
    (root / "src0" / "latin.py").write_bytes(b"# coding: latin-1\n" + body.encode("latin-1"))
    (root / "src0" / "broken.py").write_bytes(b"\xff\xfe")
    (root / "src0" / "notes.md").write_text("no code")
    return root, len(rows)


@pytest.fixture(scope="module")
def stages(spark, tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    jobs.clean_job(spark, str(tree[0]), f"{out}/clean")
    jobs.samples_job(spark, f"{out}/clean", f"{out}/samples")
    jobs.select_job(spark, f"{out}/samples/samples_jsonl", f"{out}/select", target=60)
    return out


def test_clean(spark, tree, stages):
    outcomes = spark.read.json(f"{stages}/clean/outcomes").first().asDict()
    assert outcomes["total"] == tree[1] + 2
    assert outcomes["passed"] + outcomes["skipped"] == outcomes["total"]
    assert outcomes["cleaning_error"] == 1
    manifest = files.manifest(spark, f"{stages}/clean/manifest")
    assert manifest.schema == schemas.MANIFEST
    assert manifest.count() == outcomes["passed"]
    rejects = spark.read.parquet(f"{stages}/clean/rejects")
    assert rejects.count() == outcomes["skipped"]
    latin = spark.read.parquet(f"{stages}/clean/files").filter("file_path = 'src0/latin.py'")
    assert "é" in latin.first().source


def test_samples(spark, data, stages):
    lines = files.json_lines(spark, f"{stages}/samples/samples_jsonl")
    table = spark.read.parquet(f"{stages}/samples/samples")
    both = lines.join(table, "source_line")
    assert both.count() == lines.count() == table.count()
    assert both.filter(lines.code != table.code).count() == 0
    written = {r.outcome: r.samples for r in spark.read.parquet(f"{stages}/samples/counts").collect()}
    assert written["written"] == table.count()
    rejects = spark.read.parquet(f"{stages}/samples/rejects").count()
    checked = spark.read.parquet(f"{stages}/samples/checked").count()
    assert checked == rejects + written["written"] + written["duplicate"]


def test_select(spark, stages):
    report = spark.read.json(f"{stages}/select/report").first().asDict(recursive=True)
    assert report["selected_count"] == 60
    assert report["shape_counts"] == {"class": 12, "function": 48}
    skipped = sum(v for v in report["skip_reasons"].values() if v)
    assert report["filtered_count"] + skipped <= report["total_seen"]
    chosen = spark.read.json(f"{stages}/select/samples_jsonl")
    assert sorted(chosen.columns) == ["code", "instruction", "type"] and chosen.count() == 60


def test_tokens_and_formats(spark, stages):
    source = f"{stages}/select/samples_jsonl"
    stats = jobs.tokens_job(spark, source, f"{stages}/tokens").first()
    assert stats.samples == 60 == files.token_table(spark, f"{stages}/tokens/tokens").count()
    for style, (_, columns) in jobs.STYLES.items():
        counts = jobs.format_job(spark, source, f"{stages}/{style}", style).first()
        assert counts.kept == 60
        texts = spark.read.json(f"{stages}/{style}/texts")
        assert sorted(texts.columns) == sorted(columns) and texts.count() == 60


def test_command_line(spark, stages):
    source = f"{stages}/select/samples_jsonl"
    main(["format", "--jsonl", source, "--out", f"{stages}/cli", "--style", "marked-text"])
    assert spark.read.json(f"{stages}/cli/texts").count() == 60
    with pytest.raises(SystemExit):
        parser().parse_args(["clean"])


def test_line_numbers_of_foreign_files(spark, tmp_path):
    good = json.dumps({"type": "code_comment", "instruction": "i", "code": "c d"})
    first = [good, "", "not json", good, '["a list"]', "  ", "3", "null", good]
    (tmp_path / "a.jsonl").write_text("\n".join(first) + "\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text(f"\n{good}", encoding="utf-8")
    rows = files.json_lines(spark, str(tmp_path)).orderBy("source_line").collect()
    bad = [r.source_line for r in rows if r[files.CORRUPT] is not None]
    assert bad == [3, 5, 7, 8]
    assert [r.source_line for r in rows if r.code] == [1, 4, 9, 11]
    report = jobs.select_job(spark, str(tmp_path), str(tmp_path / "out")).first()
    assert report.total_seen == 8
    assert report.skip_reasons == {"json_decode_error": 4, "instruction_too_short": 4}


def test_line_numbers_across_input_splits(spark, tmp_path):
    lines = [json.dumps({"type": "t", "instruction": str(i), "code": "x" * (i % 50)})
             for i in range(1, 3001)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = files.json_lines(spark, str(tmp_path))
        wrong = rows.filter(F.col("source_line") != F.col("instruction").cast("long")).count()
        assert rows.count() == 3000 and wrong == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ingest(spark, tmp_path):
    now, before = datetime(2025, 6, 1), datetime(2025, 5, 1)
    listing = [(r, now, 500, 50, now, "Python") for r in ("o/new", "o/same", "o/bad", "o/empty")]
    spark.createDataFrame(listing, schemas.REPO_LISTING).write.parquet(f"{tmp_path}/listing")
    state = [("o/same", now), ("o/new", before), ("o/gone", before)]
    spark.createDataFrame(state, schemas.CRAWL_STATE).write.parquet(f"{tmp_path}/state")
    code = base64.encodebytes("x = 'é'\n".encode() * 20).decode()
    contents = [
        ("o/new", "a/b.py", "file", "base64", code), ("o/new", "../x.py", "file", "base64", code),
        ("o/new", "a/c.md", "file", "base64", code), ("o/new", "a/d.py", "dir", None, None),
        ("o/new", "e.py", "file", "none", ""), ("o/same", "a.py", "file", "base64", code),
        ("o/bad", "a.py", "file", "base64", "###"), ("o/bad", "b.py", "file", "base64", code),
        ("o/empty", "readme.md", "file", "base64", code),
    ]
    spark.createDataFrame(contents, schemas.REPO_CONTENTS).write.parquet(f"{tmp_path}/contents")
    jobs.ingest_job(
        spark, f"{tmp_path}/listing", f"{tmp_path}/contents", f"{tmp_path}/state", f"{tmp_path}/out"
    )
    out = versions.current(spark, f"{tmp_path}/out")
    landed = spark.read.parquet(f"{out}/files").collect()
    assert {(r.repo, r.path) for r in landed} == {("o/new", "a/b.py"), ("o/bad", "b.py")}
    assert landed[0].source == "x = 'é'\n" * 20
    after = {r.repo: r.updated_at for r in spark.read.parquet(f"{out}/state").collect()}
    assert after == {"o/new": now, "o/same": now, "o/gone": before, "o/empty": now}
    rejects = spark.read.parquet(f"{out}/rejects").collect()
    assert {(r.stage, r.key, r.reason) for r in rejects} == {
        ("ingest", "o/new/../x.py", "refused_path"), ("ingest", "o/bad/a.py", "undecodable_content"),
    }


def test_incremental_clean(spark, tmp_path):
    body = "def f(a):\n" + "".join(f"    a = a + {i}\n" for i in range(12)) + "    return a\n"
    out = f"{tmp_path}/out"

    def arrive(name, day, texts):
        rows = [(f"{name}_{i}.py", text, datetime(2025, 1, day)) for i, text in enumerate(texts)]
        spark.createDataFrame(rows, jobs.ARRIVAL_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/in"
        )
        jobs.incremental_clean_job(spark, f"{tmp_path}/in", out, f"{tmp_path}/state")
        return spark.read.parquet(f"{out}/files")
    assert arrive("a", 20, [body, body, body + "#x\n", "def (", None]).count() == 2
    # Much older than everything seen so far, and still not lost.
    late = arrive("b", 1, [body, body.replace("f(", "g("), "x = 1\n"])
    assert late.count() == 3
    files_ = arrive("c", 2, [])
    assert files_.select("code_hash").distinct().count() == files_.count() == 3
    assert files_.filter(F.col("source").endswith("# x\n")).count() == 1
    rejects = {(r.key, r.reason) for r in spark.read.parquet(f"{out}/rejects").collect()}
    assert rejects == {
        ("a_3.py", "syntax_error"), ("a_4.py", "cleaning_error"), ("b_2.py", "too_short")
    }
    counted = spark.read.parquet(f"{out}/outcomes").agg(F.sum("files")).first()[0]
    assert counted == 8


def test_rejects_are_replaced_when_a_job_runs_again(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "bad.py").write_text("def (")
    for _ in range(2):
        jobs.clean_job(spark, f"{tmp_path}/raw", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/rejects").count() == 1


LINES = [
    '{"code": "a"}', '{"code": "a"} tail', '{"code": "a"}{"code": "b"}', "{'code': 'a'}",
    '\t{"code": "tab"}', '{"code": "a"}, {"code": "b"}', "3", "null", '"x"', "[]", '["a"]', "{}",
    '{"code": "\\u00e9\\n"}', '{"code": "\\x"}', '{"code": }', '{"code": "a"',
    ' {"code": "b"} \r', '{"code": null}',
]


def test_lines_are_read_as_python_reads_them(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join([*LINES, "\u3000", ""]), encoding="utf-8")
    got = {r.source_line: r for r in files.json_lines(spark, str(tmp_path)).collect()}
    assert len(got) == len(LINES)
    for number, line in enumerate(LINES, 1):
        try:
            value = json.loads(line)
        except ValueError:
            value = None
        row = got[number]
        assert (row[files.CORRUPT] is None) == isinstance(value, dict), line
        if isinstance(value, dict):
            assert row.code == value.get("code")


def test_evaluation_jobs(spark, stages, tmp_path):
    table = f"{stages}/samples/samples"
    stats = jobs.tokens_job(spark, table, f"{tmp_path}/tokens").first()
    report = jobs.batches_job(spark, f"{tmp_path}/tokens/tokens", f"{tmp_path}/batches").first()
    assert report.samples == stats.samples == spark.read.parquet(table).count()
    assert jobs.masks_job(spark, table, f"{tmp_path}/masks").first().trained > 0
    assert jobs.audit_job(spark, table, f"{tmp_path}/audit").first().kept_same == report.samples
    losses = [(1, 1.0, 1), (2, 2.0, 3)]
    spark.createDataFrame(losses, schemas.LOSS).write.parquet(f"{tmp_path}/losses")
    told = jobs.perplexity_job(spark, f"{tmp_path}/losses", f"{tmp_path}/perplexity").first()
    assert told.mean_loss == 1.75
    (tmp_path / "cases.json").write_text(
        '{"case_id": 1, "instruction": "i", "expected": ["a", "b"]}\n'
        '{"case_id": 2, "instruction": "i", "expected": ["a"]}\n'
    )
    (tmp_path / "answers.json").write_text('{"case_id": 1, "answer": "xbxa"}\n')
    rate = jobs.evaluate_job(
        spark, f"{tmp_path}/cases.json", f"{tmp_path}/answers.json", f"{tmp_path}/evaluated"
    ).first()
    assert (rate.cases, rate.passed, rate.hits, rate.wanted) == (2, 1, 2, 3)
    jobs.publish_job(spark, f"{stages}/clean", f"{tmp_path}/published")
    published = spark.read.parquet(f"{tmp_path}/published")
    assert published.filter("repo = 'src0'").count() > 0


def test_masks_and_audit_write_what_they_leave_out(spark, tmp_path):
    rows = [{"type": "code_comment", "instruction": "i", "code": "c d"},
            {"type": "code_comment", "instruction": "i"}, {"type": "x", "instruction": "i", "code": " "}]
    (tmp_path / "a.jsonl").write_text("\n".join([*map(json.dumps, rows), "not json"]) + "\n")
    for job, table in ((jobs.masks_job, "masked"), (jobs.audit_job, "roundtrip")):
        out = f"{tmp_path}/{table}"
        job(spark, f"{tmp_path}/a.jsonl", out)
        kept = {str(r.source_line) for r in spark.read.parquet(f"{out}/{table}").collect()}
        rejects = spark.read.parquet(f"{out}/rejects").collect()
        reasons = {r.key: r.reason for r in rejects}
        assert len(rejects) == len(reasons) and reasons["4"] == "json_decode_error"
        assert kept | set(reasons) == {"1", "2", "3", "4"} and not kept & set(reasons)
    assert reasons == {"2": "no_code", "4": "json_decode_error"}


def located(found, folder):
    return [rows for scan, rows in found if f"{folder}]" in scan or f"{folder}," in scan or f"{folder}/" in scan]


def test_reports_are_counted_while_writing(spark, stages, tree, tmp_path):
    """A job's table is read for its further outputs, never for its report."""
    report = []
    found = scans.scans_of(
        spark, lambda: report.append(jobs.clean_job(spark, str(tree[0]), f"{tmp_path}/clean").first()))
    assert len(located(found, "clean/files")) == 2  # manifest and rejects
    cleaned = spark.read.parquet(f"{tmp_path}/clean/files")
    assert report[0] == cleaning.outcome_counts(cleaned).first()

    report.clear()
    found = scans.scans_of(
        spark, lambda: report.append(jobs.samples_job(spark, f"{tmp_path}/clean", f"{tmp_path}/samples").collect()))
    assert len(located(found, "samples/checked")) == 2  # distinct samples and rejects
    checked = spark.read.parquet(f"{tmp_path}/samples/checked")
    assert sorted(report[0]) == sorted(samples.sample_counts(checked).collect())

    report.clear()
    source = f"{tmp_path}/samples/samples"
    found = scans.scans_of(
        spark, lambda: report.append(jobs.tokens_job(spark, source, f"{tmp_path}/tokens", 500).first()))
    assert len(located(found, "tokens/tokens")) == 1  # rejects
    lines = spark.read.parquet(source).withColumns(
        {name: F.lit(None).cast("string") for name in ("original_code", "fixed_code")})
    want = tokens.token_stats(tokens.sizes(lines, 500)).first()
    assert report[0].asDict() == want.asDict() and want.truncated > 0


def test_format_and_select_write_what_they_leave_out(spark, tmp_path):
    rows = [{"type": "code_comment", "instruction": "i", "code": "c d"}, {"type": "x", "code": "c"},
            {"code": "c"}, {"type": "code_comment", "instruction": "i", "code": " "}]
    (tmp_path / "a.jsonl").write_text("\n".join([*map(json.dumps, rows), "not json"]) + "\n")
    report = jobs.format_job(spark, f"{tmp_path}/a.jsonl", f"{tmp_path}/texts").first()
    assert (report.before, report.skipped, report.kept) == (2, 1, 1)
    reasons = {r.key: r.reason for r in spark.read.parquet(f"{tmp_path}/texts/rejects").collect()}
    assert reasons == {"2": "other_type", "3": "other_type", "4": "empty_text", "5": "json_decode_error"}
    report = jobs.select_job(spark, f"{tmp_path}/a.jsonl", f"{tmp_path}/select").first()
    rejects = spark.read.parquet(f"{tmp_path}/select/rejects").groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in rejects} == {k: v for k, v in report.skip_reasons.items() if v}
    (tmp_path / "b.jsonl").write_text(json.dumps(rows[3]) + "\n")
    with pytest.raises(ValueError):
        jobs.format_job(spark, f"{tmp_path}/b.jsonl", f"{tmp_path}/none")


def test_tables_and_json_lines_are_told_by_their_files(spark, stages, tmp_path):
    table = spark.read.parquet(f"{stages}/samples/samples").limit(40)
    table.write.parquet(f"{tmp_path}/any-name")
    (tmp_path / "samples").mkdir()
    (tmp_path / "samples" / "x.jsonl").write_text('{"type": "code_comment", "code": "c"}\n')
    assert jobs.tokens_job(spark, f"{tmp_path}/any-name", f"{tmp_path}/a").first().samples == 40
    assert jobs.tokens_job(spark, f"{tmp_path}/samples", f"{tmp_path}/b").first().samples == 1


# ------------------------------------------------------------- versions


def test_a_run_that_was_cut_off_leaves_the_old_version_whole(spark, tmp_path, monkeypatch):
    now, later = datetime(2025, 6, 1), datetime(2025, 7, 1)
    code = base64.encodebytes(b"x = 1\n" * 20).decode()
    root = f"{tmp_path}/out"

    def run(name, updated):
        rows = [("o/a", updated, 500, 50, updated, "Python")]
        spark.createDataFrame(rows, schemas.REPO_LISTING).write.parquet(f"{tmp_path}/listing-{name}")
        files_ = [("o/a", f"{name}.py", "file", "base64", code), ("o/a", f"../{name}.py", "file", "base64", code)]
        spark.createDataFrame(files_, schemas.REPO_CONTENTS).write.parquet(f"{tmp_path}/contents-{name}")
        again(name)

    def again(name):
        jobs.ingest_job(spark, f"{tmp_path}/listing-{name}", f"{tmp_path}/contents-{name}", root, root)

    def seen():
        at = versions.current(spark, root)
        tables_ = [spark.read.parquet(f"{at}/{name}") for name in ("files", "rejects", "state")]
        return ([r.path for r in tables_[0].collect()], [r.key for r in tables_[1].collect()],
                [r.updated_at for r in tables_[2].collect()])

    run("first", now)
    old = (["first.py"], ["o/a/../first.py"], [now])
    assert seen() == old
    for stop in ("write_landed", "write_rejects"):
        write = getattr(sinks, stop)

        def cut_off(*args):
            write(*args)
            raise RuntimeError("cut off")
        monkeypatch.setattr(sinks, stop, cut_off)
        with pytest.raises(RuntimeError):
            run(stop, later)
        monkeypatch.setattr(sinks, stop, write)
        assert seen() == old and versions.published(spark, root) == [1]
    again("write_landed")
    assert seen() == (["write_landed.py"], ["o/a/../write_landed.py"], [later])
    assert versions.published(spark, root) == [1, 2]


def test_only_changed_files_are_cleaned(spark, tmp_path):
    raw, out = tmp_path / "raw", f"{tmp_path}/out"
    body = "".join(f"name_{i} = {i}\n" for i in range(12))
    (raw / "a").mkdir(parents=True)
    for name, text in (("same.py", body), ("edit.py", body), ("gone.py", body), ("bad.py", "def ("),
                       ("mended.py", "def ("), ("a/deep.py", body)):
        (raw / name).write_text(text)
    first = jobs.clean_changed_job(spark, str(raw), out).first()
    assert (first.total, first.passed, first.syntax_error, first.new, first.unchanged) == (6, 4, 2, 6, 0)
    (raw / "edit.py").write_text(body.replace("11", "12"))  # of the same length
    (raw / "gone.py").unlink()
    (raw / "mended.py").write_text(body)
    (raw / "new.py").write_text("x = 1\n")
    (raw / "notes.txt").write_text(body)
    (raw / "same.py").touch()
    second = jobs.clean_changed_job(spark, str(raw), out).first()
    assert (second.new, second.changed, second.deleted, second.unchanged) == (1, 2, 1, 3)
    assert (second.total, second.passed, second.syntax_error, second.too_short) == (6, 4, 1, 1)
    at = versions.current(spark, out)
    cleaned = spark.read.parquet(f"{out}/texts/run=2")
    assert sorted(r.file_path for r in cleaned.collect()) == ["edit.py", "mended.py", "new.py"]
    manifest = {r.file_path: r.run for r in spark.read.parquet(f"{at}/manifest").collect()}
    assert manifest == {"same.py": 1, "a/deep.py": 1, "edit.py": 2, "mended.py": 2}
    rejects = {r.key: r.reason for r in spark.read.parquet(f"{at}/rejects").collect()}
    assert rejects == {"bad.py": "syntax_error", "new.py": "too_short"}
    texts = {r.file_path: r.source for r in jobs.cleaned_texts(spark, out).collect()}
    assert set(texts) == set(manifest) and texts["edit.py"] == body.replace("11", "12")
    third = jobs.clean_changed_job(spark, str(raw), out).first()
    assert (third.unchanged, third.new, third.changed, third.deleted, third.total) == (6, 0, 0, 0, 6)
    counts = {r.outcome: r.samples for r in jobs.samples_job(spark, out, f"{tmp_path}/samples").collect()}
    assert counts == {"file_too_small": 4}


def test_a_cut_off_cleaning_is_cleaned_again(spark, tmp_path, monkeypatch):
    raw, out = tmp_path / "raw", f"{tmp_path}/out"
    body = "".join(f"name_{i} = {i}\n" for i in range(12))
    raw.mkdir()
    (raw / "a.py").write_text(body)
    jobs.clean_changed_job(spark, str(raw), out)
    (raw / "b.py").write_text(body)
    write = sinks.write_table

    def cut_off(df, path, *more):
        if path.endswith("manifest"):
            raise RuntimeError("cut off")
        write(df, path, *more)
    monkeypatch.setattr(sinks, "write_table", cut_off)
    with pytest.raises(RuntimeError):
        jobs.clean_changed_job(spark, str(raw), out)
    monkeypatch.setattr(sinks, "write_table", write)
    assert [r.file_path for r in jobs.cleaned_texts(spark, out).collect()] == ["a.py"]
    report = jobs.clean_changed_job(spark, str(raw), out).first()
    assert (report.new, report.unchanged) == (1, 1)
    assert sorted(r.file_path for r in jobs.cleaned_texts(spark, out).collect()) == ["a.py", "b.py"]
