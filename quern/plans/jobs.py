"""End-to-end jobs from paths to paths.  Every stage writes one full table and derives its other
outputs from that table, so nothing expensive runs twice.  Rows that a stage leaves out end in its
``rejects``; a job that runs again replaces them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quern import schemas
from quern.operators import (
    audit, changes, cleaning, evaluation, formats, ingest, samples, selection, tokens,
    vocabulary as merging,
)
from quern.operators.ordering import number_rows
from quern.session import job, spool, spread
from quern.sources import files, sinks, versions
from quern.streaming import incremental


EOS = "<|endoftext|>"
# Paths of files to clean, well under 1000 bytes each.
BROADCAST_PATHS = 100_000
MANIFEST_OF_RUNS = T.StructType([*schemas.MANIFEST.fields, schemas.INPUTS["run"]])


def vocabulary_rules() -> tuple[str, ...]:
    return merging.vocabulary.RULES


def _stored(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    sinks.write_table(df, path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _reject(rejects: DataFrame, out: str) -> None:
    sinks.write_rejects(rejects.withColumn("at", F.current_timestamp()), f"{out}/rejects")


@job
def ingest_job(
    spark: SparkSession, listing: str, contents: str, state: str, out: str,
    max_results: int = ingest.MAX_REPOS, **search,
) -> None:
    """Search, skip unchanged repositories, land their Python files, write the new state.

    A repository without Python files is recorded too; one with a file that failed to decode is
    not, so it is tried again.  Contents are joined and decoded once; files, rejects and state
    derive from that table and appear together, as a version below ``out``.  ``state`` is a state
    table, or the root of earlier versions, which may be ``out`` itself.
    """
    with versions.publication(spark, out) as (path, _):
        _ingest(spark, listing, contents, _known_state(spark, state), path, max_results, search)


def _known_state(spark: SparkSession, state: str) -> DataFrame:
    """A state table, or that of the newest version below a root; nothing before the first one."""
    reader = spark.read.schema(schemas.CRAWL_STATE)
    newest = versions.current(spark, state)
    if newest is not None:
        return reader.parquet(f"{newest}/state")
    if versions.is_empty(spark, state):
        return spark.createDataFrame([], schemas.CRAWL_STATE)
    return reader.parquet(state)


def _ingest(
    spark: SparkSession, listing: str, contents: str, known: DataFrame, out: str, max_results: int,
    search: dict,
) -> None:
    listed = spark.read.schema(schemas.REPO_LISTING).parquet(listing)
    wanted = ingest.top_repos(listed, max_results=max_results, **search)
    changed = spool(
        ingest.changed_repos(wanted, known).select("repo", "updated_at"), "changed"
    )
    keys = F.broadcast(changed) if max_results <= ingest.BROADCAST_REPOS else changed
    fetched = spark.read.schema(schemas.REPO_CONTENTS).parquet(contents).join(keys, "repo")
    decoded = _stored(
        ingest.landed(fetched).select("repo", "path", "source", "path_ok", "reason"),
        f"{out}/decoded",
    )
    sinks.write_landed(decoded.filter("reason is null").drop("reason"), f"{out}/files")
    _reject(ingest.landing_rejects(decoded), out)
    seen = spark.read.schema(schemas.REPO_CONTENTS).parquet(contents).select("repo").distinct()
    state_after = ingest.updated_state(
        known, ingest.complete_state(changed.join(seen, "repo", "left_semi"), decoded)
    )
    sinks.write_table(state_after, f"{out}/state")


@job
def clean_job(spark: SparkSession, raw: str, out: str) -> DataFrame:
    """Tree of ``*.py`` files to cleaned text, manifest, rejects and outcome counts."""
    sources = cleaning.read_sources(files.source_tree(spark, raw))
    counted = sinks.Counted(cleaning.clean(sources), *cleaning.outcome_totals())
    cleaned = _stored(counted.rows, f"{out}/files", ("outcome",))
    sinks.write_table(cleaning.manifest(cleaned), f"{out}/manifest")
    _reject(cleaning.rejects(cleaned).drop("at"), out)
    return sinks.write_report(counted.report(), f"{out}/outcomes")


def clean_changes(spark: SparkSession, contents: DataFrame, out: str) -> DataFrame:
    """A version of the cleaned tree (file_path, content) below ``out``, from what changed.

    Files are told by path, length and content hash.  New and changed ones are cleaned into
    ``texts`` of this run; what is known of the others moves on, and their texts stay where an
    earlier run wrote them; files that are gone are left out.  Inputs, manifest, rejects and report
    appear together.
    """
    before = versions.current(spark, out)

    def known(name: str, schema) -> DataFrame:
        if before is None:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{before}/{name}")

    with versions.publication(spark, out) as (path, run):
        current = spool(changes.fingerprints(contents), "fingerprints")
        compared = sinks.Counted(
            changes.compare(current, known("inputs", schemas.INPUTS)), *changes.change_totals())
        stored = _stored(compared.rows, f"{path}/changes")
        told = compared.counts()
        dirty = changes.of_kind(stored, changes.NEW, changes.CHANGED)
        if told[changes.NEW] + told[changes.CHANGED] <= BROADCAST_PATHS:
            dirty = F.broadcast(dirty)
        sources = cleaning.read_sources(contents.join(dirty, "file_path", "left_semi"))
        fresh = _stored(cleaning.clean(sources), f"{out}/texts/run={run}", ("outcome",))
        same = changes.of_kind(stored, changes.UNCHANGED).toDF("same_path")
        this_run = F.lit(run).cast("int").alias("run")

        def merged(name: str, schema, made: DataFrame, key: str = "file_path") -> DataFrame:
            old = known(name, schema).join(same, F.col(key) == F.col("same_path"), "left_semi")
            return old.unionByName(made.select(*schema.names))

        inputs = fresh.select("file_path", "outcome", this_run).join(current, "file_path")
        totals = sinks.Counted(merged("inputs", schemas.INPUTS, inputs), *cleaning.outcome_totals())
        sinks.write_table(totals.rows, f"{path}/inputs")
        sinks.write_table(
            merged("manifest", MANIFEST_OF_RUNS, cleaning.manifest(fresh).withColumn("run", this_run)),
            f"{path}/manifest")
        sinks.write_table(
            merged("rejects", schemas.REJECTS, cleaning.rejects(fresh), "key"), f"{path}/rejects")
        report = totals.report().withColumns({kind: F.lit(told[kind]) for kind in changes.KINDS})
        return sinks.write_report(report, f"{path}/report")


def cleaned_texts(spark: SparkSession, cleaned: str) -> DataFrame:
    """Cleaned files of ``clean_job``, or of the newest version of ``clean_changes``."""
    newest = versions.current(spark, cleaned)
    if newest is None:
        return cleaning.cleaned_files(spark.read.parquet(f"{cleaned}/files"))
    live = spark.read.schema(MANIFEST_OF_RUNS).parquet(f"{newest}/manifest").select("file_path", "run")
    texts = spark.read.parquet(f"{cleaned}/texts")
    return cleaning.cleaned_files(texts.join(live, ["file_path", "run"], "left_semi")).drop("run")


@job
def clean_changed_job(spark: SparkSession, raw: str, out: str) -> DataFrame:
    """``clean_job`` that cleans only the files that changed since the last run into ``out``."""
    return clean_changes(spark, files.source_tree(spark, raw), out)


@job
def publish_job(spark: SparkSession, cleaned: str, out: str) -> None:
    """Cleaned files under their relative path, in one folder per repository."""
    sinks.write_cleaned(cleaned_texts(spark, cleaned), out)


@job
def samples_job(spark: SparkSession, cleaned: str, out: str) -> DataFrame:
    """Cleaned files to distinct samples with line numbers, rejects and counts.

    Line numbers are worked out on the order key alone and joined to the samples, whose text is
    sorted within its range partitions once, to write the lines.
    """
    sources = spread(cleaned_texts(spark, cleaned))
    counted = sinks.Counted(samples.check(samples.extract(sources)), *samples.reason_totals())
    checked = _stored(counted.rows, f"{out}/checked")
    once = sinks.Counted(samples.distinct_samples(checked), F.count(F.lit(1)).alias("n"))
    distinct = spool(once.rows, "distinct")
    keys = distinct.select(*samples.ORDER)
    written = once.counts()["n"]
    numbers = number_rows(keys, samples.ORDER, "source_line", written)
    numbered = _stored(distinct.join(numbers, samples.ORDER), f"{out}/samples")
    sinks.write_json_samples(
        numbered.repartitionByRange("source_line").sortWithinPartitions("source_line"),
        f"{out}/samples_jsonl",
    )
    _reject(samples.rejects(checked).drop("at"), out)
    return _stored(samples.counts_of(spark, counted.counts(), written), f"{out}/counts")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Samples with their line number: a table of ``samples_job``, or JSON lines of any origin."""
    if files.holds_parquet(spark, path):
        table = spark.read.parquet(path)
        extra = [f.name for f in schemas.SAMPLE.fields if f.name not in table.columns]
        missing = {name: F.lit(None).cast("string") for name in [*extra, files.CORRUPT]}
        return table.withColumns(missing).select(
            "source_line", *schemas.SAMPLE.names, files.CORRUPT
        )
    return files.json_lines(spark, path)


@job
def select_job(
    spark: SparkSession, jsonl: str, out: str, target: int = 1000, seed: int = 42,
    rules: selection.Rules = selection.Rules(),
) -> DataFrame:
    """Sample lines to the best ``target`` samples and a report."""
    lines = _lines(spark, jsonl)
    judged = selection.judge(lines, rules, F.col(files.CORRUPT).isNotNull())
    judged = spool(selection.without_rejected_text(judged.select(
        "source_line", "type", "instruction", "code", "reason", "shape", "score"
    )), "judged")
    _reject(selection.rejects(judged), out)
    pool = spool(selection.candidates(judged), "pool")
    chosen = _stored(selection.select_balanced(pool, target, seed), f"{out}/chosen")
    sinks.write_json_samples(chosen.orderBy("shuffle_rank"), f"{out}/samples_jsonl")
    report = selection.selection_report(judged, pool, chosen, jsonl, out)
    return sinks.write_report(report, f"{out}/report")


@job
def tokens_job(
    spark: SparkSession, jsonl: str, out: str, limit: int = tokens.MAX_TOKENS,
    keep_eos: bool = False, vocabulary: str | None = None, eos: str = EOS,
) -> DataFrame:
    """Samples to token ids, their statistics and rejects.  Ids are bytes, or those of a vocabulary
    file with the end token ``eos``."""
    lines = spool(_lines(spark, jsonl), "lines")
    good = sinks.Counted(lines.filter(F.col(files.CORRUPT).isNull()), tokens.blank_total())
    if vocabulary is None:
        made = tokens.tokenise(good.rows, ["source_line"], limit, keep_eos)
    else:
        made = merging.tokenise(good.rows, vocabulary, eos, ["source_line"], limit)
    counted = sinks.Counted(made, *tokens.stat_totals(F.lit(False), tokens.failed_rows(made)))
    stored = _stored(counted.rows, f"{out}/tokens")
    _reject(
        tokens.line_rejects(lines, "source_line", files.CORRUPT)
        .unionByName(tokens.token_rejects(stored, "source_line")), out,
    )
    return sinks.write_report(counted.report(**good.counts()), f"{out}/stats")


@job
def batches_job(
    spark: SparkSession, table: str, out: str, rows: int = tokens.BATCH_ROWS, pad_id: int = 0
) -> DataFrame:
    """A token table to padded batches with masks, and a report of its lengths."""
    tokenised = files.token_table(spark, table)
    batches = tokens.padded_batches(tokenised, "source_line", rows, pad_id, tokenised.count())
    sinks.write_table(batches, f"{out}/batches")
    report = tokens.length_report(tokenised)
    return sinks.write_report(report, f"{out}/report")


@job
def masks_job(
    spark: SparkSession, jsonl: str, out: str, vocabulary: str | None = None, rule: str = "mask"
) -> DataFrame:
    """Samples to ids and labels of their completions, with an audit of the trained part.  With a
    vocabulary, ``rule`` says what becomes of tokens that span the end of the prompt."""
    lines = spool(_lines(spark, jsonl), "lines")
    good = lines.filter(F.col(files.CORRUPT).isNull())
    key = ["source_line"]
    made = (
        formats.completion_masks(good, key) if vocabulary is None
        else merging.completion_masks(good, vocabulary, key, rule=rule)
    )
    masked = _stored(made, f"{out}/masked")
    left_out = good.join(masked.select("source_line"), "source_line", "left_anti")
    _reject(
        tokens.undecodable_rejects(lines, "source_line", files.CORRUPT, "masks")
        .unionByName(tokens.rejects_of(left_out, "source_line", "masks", "other_type")), out,
    )
    trained = (
        audit.trained_part(masked, key) if vocabulary is None
        else merging.trained_part(masked, vocabulary, key)
    )
    report = trained.agg(
        F.count(F.lit(1)).alias("samples"), F.sum("trained").alias("trained"),
        *[F.sum(n).alias(n) for n in ("newline_tokens", "space_tokens", "indent_tokens")],
    )
    return sinks.write_report(report, f"{out}/report")


@job
def audit_job(
    spark: SparkSession, jsonl: str, out: str, vocabulary: str | None = None
) -> DataFrame:
    """Round trip of every sample through the tokenizer."""
    lines = spool(_lines(spark, jsonl), "lines")
    good = lines.filter(F.col(files.CORRUPT).isNull())
    coded = good.filter(F.col("code").isNotNull())
    made = (
        audit.roundtrip(coded, ["source_line"], "code") if vocabulary is None
        else merging.roundtrip(coded, vocabulary, ["source_line"], "code")
    )
    counted = sinks.Counted(made, *audit.roundtrip_totals())
    _stored(counted.rows, f"{out}/roundtrip")
    _reject(
        tokens.undecodable_rejects(lines, "source_line", files.CORRUPT, "audit")
        .unionByName(tokens.rejects_of(good.filter("code is null"), "source_line", "audit", "no_code")), out,
    )
    return sinks.write_report(counted.report(), f"{out}/report")


@job
def perplexity_job(spark: SparkSession, losses: str, out: str) -> DataFrame:
    """Weighted perplexity of a table of losses (sample_id, loss, n_tokens)."""
    report = evaluation.weighted_perplexity(spark.read.schema(schemas.LOSS).parquet(losses))
    return sinks.write_report(report, f"{out}/report")


@job
def evaluate_job(spark: SparkSession, cases: str, answers: str, out: str) -> DataFrame:
    """Expected strings of cases (case_id, instruction, expected) in answers (case_id, answer)."""
    asked = spark.read.schema(schemas.EVAL_CASE).json(cases)
    told = spark.read.schema("case_id long, answer string").json(answers)
    checked = _stored(
        evaluation.expected_hits(asked.join(told, "case_id", "left"), "answer", "expected"),
        f"{out}/checked",
    )
    report = evaluation.pass_rate(checked)
    return sinks.write_report(report, f"{out}/report")


STYLES = {
    "prompt-completion": (formats.prompt_completion, ("prompt", "completion")),
    "text": (formats.single_text, ("text",)),
    "marked-text": (formats.marked_text, ("text",)),
}


@job
def format_job(spark: SparkSession, jsonl: str, out: str, style: str = "text") -> DataFrame:
    """Samples to training texts, rejects and counts; fails if no text is left."""
    build, columns = STYLES[style]
    lines = spool(_lines(spark, jsonl), "lines")
    good = lines.filter(F.col(files.CORRUPT).isNull())
    counted = sinks.Counted(build(good).select("source_line", *columns), *formats.format_totals(*columns))
    built = _stored(counted.rows, f"{out}/built")
    kept = formats.drop_empty(built, *columns).select(*columns)
    kept.write.mode("overwrite").json(f"{out}/texts")
    _reject(
        tokens.undecodable_rejects(lines, "source_line", files.CORRUPT, "format")
        .unionByName(tokens.rejects_of(formats.of_other_type(good), "source_line", "format", "other_type"))
        .unionByName(formats.empty_rejects(built, "source_line", *columns)), out,
    )
    formats.require_some(counted.counts()["kept"])
    return sinks.write_report(counted.report(), f"{out}/counts")


ARRIVAL_SCHEMA = "file_path string, source string, arrived_at timestamp"


@job
def incremental_clean_job(spark: SparkSession, arrivals: str, out: str, checkpoint: str) -> None:
    """Clean what has arrived since the last run: new texts, rejects and outcomes."""
    stream = spark.readStream.schema(ARRIVAL_SCHEMA).parquet(arrivals)
    sources = cleaning.as_sources(stream, "file_path", "source", keep=("arrived_at",))
    incremental.run_clean(sources, out, checkpoint)
