"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.functions import bytes as byte_tokens, sql
from quern.functions.generated import (
    clean_generated, clean_response as response, repair_compact, strip_markup,
)
from quern.functions.naming import VERB_BY_PREFIX, function_instruction
from quern.functions.text import (
    collapse_spaces, redact, sample_json_length, seeded_rank, strip, with_end_marker,
)
from quern.operators import (
    audit, cleaning, evaluation, formats, ingest, samples, selection, tokens, vocabulary,
)
from quern.operators.ordering import first_rows, keep_first, number_rows, top_per_group
from quern.plans import corpus, jobs, tables
from quern.session import handovers, scratch_path, spool
from quern.sources import files, sinks, versions
from quern.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Rules for prose in place of code: same checks, other limits and words.
PROSE = selection.Rules(
    code_chars=(100, 4000), require_indentation=False,
    bad_instructions=(r"^\s*the\b", r"^\s*un\b", r"\d{4}"),
    bad_code=(r"\btoken\b", r"\bidiot\b", r"worthless", r"\bLicensed under\b.*$"),
    shape_points={"en": 40, "de": 30},
)
PROSE_TARGET = 100
CODE_TARGET = 150
SOURCE_CAP = 7
EVENT_CUT = "2024-01-29 00:00:00"
EOS_TEXT = "<|end|>"
CHOKES_ON = "idiot"


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return tables.documents(spark, folder)


def _doc_samples(spark: SparkSession, folder: str) -> DataFrame:
    return tables.document_samples(_docs(spark, folder))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return tables.dialogue_pairs(tables.table(spark, folder, "conversations"))


def _joined_md5(ids: str) -> Column:
    return F.md5(F.array_join(F.transform(ids, lambda i: i.cast("string")), " "))


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp")).alias(name)


# ---------------------------------------------------------------- ingest


@register
def ingest_topk(spark, folder):
    listing = tables.repo_listing(tables.table(spark, folder, "events"))
    return ingest.top_repos(
        listing, min_stars=60, min_forks=10, pushed_after=datetime(2024, 1, 20), max_results=50
    ).select("repo", "stars", "forks", _micros("pushed_at"))


def _listing_and_state(spark, folder):
    events = tables.table(spark, folder, "events")
    return tables.repo_listing(events), tables.repo_listing(events, until=EVENT_CUT)


@register
def ingest_changed(spark, folder):
    listing, state = _listing_and_state(spark, folder)
    return ingest.changed_repos(listing, state).select("repo", _micros("updated_at"))


@register
def ingest_state(spark, folder):
    listing, state = _listing_and_state(spark, folder)
    changed = ingest.changed_repos(listing, state)
    fetched = changed.filter(F.col("forks") > 10)
    return ingest.updated_state(state, fetched).select("repo", _micros("updated_at"))


@register
def python_listing(spark, folder):
    contents = tables.encoded_contents(_docs(spark, folder))
    return ingest.python_files(contents).groupBy("repo").agg(F.count(F.lit(1)).alias("py_files"))


@register
def decode_base64(spark, folder):
    contents = tables.encoded_contents(_docs(spark, folder))
    return ingest.decoded_files(ingest.python_files(contents)).select("repo", "path", "source")


@register
def path_guard(spark, folder):
    return ingest.guard_paths(tables.page_files(tables.table(spark, folder, "pages"))).select(
        "page_id", "path", "path_ok"
    )


@register
def saved_counts(spark, folder):
    return ingest.saved_counts(tables.page_files(tables.table(spark, folder, "pages")))


@register
def jsonl_numbered(spark, folder):
    path = scratch_path(spark, "jsonl")
    ordered = _doc_samples(spark, folder).orderBy("doc_id")
    sinks.write_json_samples(ordered, path)
    lines = files.json_lines(spark, path)
    return lines.select("source_line", "type", F.md5("code").alias("code_md5"))


@register
def jsonl_reasons(spark, folder):
    path = scratch_path(spark, "odd-lines")
    ordered = tables.odd_lines(_doc_samples(spark, folder)).repartitionByRange("source_line")
    ordered.sortWithinPartitions("source_line", "place").select("value").write.text(path)
    lines = files.json_lines(spark, path)
    return lines.select(
        "source_line", F.when(F.col(files.CORRUPT).isNotNull(), "json_decode_error").alias("reason"),
        F.md5("code").alias("code_md5"),
    )


@register
def ingest_rejects(spark, folder):
    landed = ingest.landed(tables.odd_contents(_docs(spark, folder)))
    return ingest.landing_rejects(landed)


# -------------------------------------------------------------- cleaning


def _with_secrets(docs: DataFrame) -> DataFrame:
    secret = F.expr(SECRET_SQL)
    return docs.withColumn("text", F.concat("text", secret))


# Dummy secrets added to the documents, as SQL that other engines read too.
SECRET_SQL = (
    "CASE doc_id % 4 "
    "WHEN 0 THEN concat(chr(10), 'key ', 'AKIA', '0123456789', 'ABCDEF', ' end') "
    "WHEN 1 THEN concat(chr(10), '-----BEGIN', ' EC PRIVATE KEY-----', chr(10), 'MHc=', chr(10), "
    "'-----END', ' EC PRIVATE KEY-----', ' tail 10.1.2.3') "
    "ELSE '' END"
)


@register
def redact_pii(spark, folder):
    return _with_secrets(_docs(spark, folder)).select("doc_id", redact("text").alias("text"))


@register
def redact_counts(spark, folder):
    redacted = _with_secrets(_docs(spark, folder)).select("lang", redact("text").alias("text"))

    def hits(placeholder: str) -> Column:
        gone = F.length("text") - F.length(F.replace("text", F.lit(placeholder), F.lit("")))
        return F.sum(F.floor(gone / len(placeholder)))
    return redacted.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        hits("<REDACTED_PRIVATE_KEY>").alias("key_blocks"),
        hits("<REDACTED_AWS_KEY>").alias("access_keys"),
        hits("<REDACTED_EMAIL>").alias("mails"), hits("<REDACTED_IP>").alias("addresses"),
    )


def _sources(spark, folder) -> DataFrame:
    files_ = corpus.code_files(_docs(spark, folder))
    return cleaning.as_sources(files_, "file_path", "source")


def _cleaned(spark, folder) -> DataFrame:
    return cleaning.clean(_sources(spark, folder))


@register
def clean_changed(spark, folder):
    """The corpus cleaned, changed, and cleaned again by its manifest: what became of every file,
    which run cleaned it, and its text."""
    docs, out = _docs(spark, folder), scratch_path(spark, "changes")
    with handovers(spark):
        for files_ in (corpus.earlier_files(docs), corpus.later_files(docs)):
            contents = files_.select("file_path", F.encode("source", "UTF-8").alias("content"))
            jobs.clean_changes(spark, contents, out)
    now = versions.current(spark, out)
    compared = spark.read.parquet(f"{now}/changes")
    inputs = spark.read.parquet(f"{now}/inputs").select("file_path", "outcome", "run")
    texts = jobs.cleaned_texts(spark, out).select("file_path", F.md5("source").alias("clean_md5"))
    return compared.join(inputs, "file_path", "left").join(texts, "file_path", "left")


@register
def read_sources(spark, folder):
    return cleaning.read_sources(tables.raw_files(_docs(spark, folder))).select(
        "file_path", "source", "original_size"
    )


@register
def lint_sources(spark, folder):
    return cleaning.lint_sources(_sources(spark, folder)).select(
        "file_path", "lint.syntax_ok", "lint.error_line", "lint.code_lines"
    )


@register
def clean_sources(spark, folder):
    return cleaning.passed(_cleaned(spark, folder)).select("file_path", "source")


@register
def clean_manifest(spark, folder):
    return cleaning.manifest(_cleaned(spark, folder)).select(
        "file_path", "original_size", "cleaned_size", "line_count", "function_count",
        F.concat_ws(",", "imports").alias("imports"),
    )


def _cleaned_odd(spark, folder) -> DataFrame:
    """Cleaning of the code corpus and of files without text."""
    docs = _docs(spark, folder)
    files_ = corpus.code_files(docs).unionByName(corpus.odd_files(docs))
    return cleaning.clean(cleaning.as_sources(files_, "file_path", "source"))


@register
def clean_outcomes(spark, folder):
    return cleaning.outcome_counts(_cleaned_odd(spark, folder))


@register
def clean_rejects(spark, folder):
    return cleaning.rejects(_cleaned_odd(spark, folder)).select("stage", "key", "reason", "detail")


@register
def import_counts(spark, folder):
    return cleaning.import_counts(_cleaned(spark, folder))


# --------------------------------------------------------------- samples


def _extracted(spark, folder) -> DataFrame:
    return samples.extract(cleaning.cleaned_files(_cleaned(spark, folder)))


def _checked(spark, folder) -> DataFrame:
    return samples.check(_extracted(spark, folder))


@register
def full_file_samples(spark, folder):
    return _extracted(spark, folder).filter(F.col("kind") == "file").select(
        "file_path", "instruction", "code", "reason"
    )


@register
def function_samples(spark, folder):
    return _extracted(spark, folder).filter(F.col("kind") == "function").select(
        "file_path", "node_ord", "instruction", "code"
    )


@register
def class_samples(spark, folder):
    return _extracted(spark, folder).filter(F.col("kind") == "class").select(
        "file_path", "node_ord", "instruction", "code"
    )


def _cleaned_texts(spark, folder) -> DataFrame:
    return cleaning.cleaned_files(_cleaned(spark, folder)).select("file_path", "source")


@register
def function_samples_sql(spark, folder):
    """``function_samples`` as SQL text over a table function."""
    return sql.function_samples(
        _cleaned_texts(spark, folder), samples.FUNCTIONS_PER_FILE, samples.MIN_INSTRUCTION_CHARS,
        samples.SEED,
    )


@register
def class_samples_sql(spark, folder):
    return sql.class_samples(_cleaned_texts(spark, folder), samples.CLASSES_PER_FILE, samples.SEED)


@register
def build_samples(spark, folder):
    return samples.distinct_samples(_checked(spark, folder)).select(
        "file_path", "kind", "node_ord", "type", "instruction", "code", "code_hash"
    )


@register
def sample_counts(spark, folder):
    return samples.sample_counts(_checked(spark, folder))


# Function names for part names: every prefix, some without a rest, some without a prefix.
PART_NAME_SQL = (
    "CASE " + " ".join(
        f"WHEN p_partkey % {len(VERB_BY_PREFIX) + 2} = {i} THEN '{p}'"
        for i, p in enumerate(VERB_BY_PREFIX)
    ) + " ELSE '__' END"
)


@register
def natural_instruction(spark, folder):
    prefix = F.expr(PART_NAME_SQL)
    rest = F.when(F.col("p_size") % 5 == 0, "").otherwise(
        F.concat(F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")))
    )
    words = F.split("p_name", " ")
    args = F.slice(words, F.lit(1), F.least(F.col("p_size") % 3, F.size(words)))
    named = tables.table(spark, folder, "part").select(
        "p_partkey", F.concat(prefix, rest).alias("name"), args.alias("args")
    )
    return named.select(
        "p_partkey", "name", function_instruction("name", "args").alias("raw"),
        collapse_spaces(function_instruction("name", "args")).alias("instruction"),
    )


@register
def per_source_cap(spark, folder):
    drawn = _docs(spark, folder).select(
        "doc_id", "source", seeded_rank(42, "source", "doc_id").alias("draw")
    )
    order = [F.col("draw"), F.col("doc_id")]
    return top_per_group(drawn, ["source"], order, SOURCE_CAP).select("doc_id", "source", "rank")


@register
def json_length_filter(spark, folder):
    length = sample_json_length(F.col("type"), F.col("instruction"), F.col("code"))
    return _doc_samples(spark, folder).select("doc_id", length.alias("json_length")).withColumn(
        "kept", F.col("json_length") <= samples.MAX_SAMPLE_CHARS
    )


@register
def exact_dedupe_first(spark, folder):
    hashed = _docs(spark, folder).select("doc_id", F.md5("text").alias("code_hash"))
    return keep_first(hashed, ["code_hash"], ["doc_id"])


# ------------------------------------------------------------- selection


def _judged_docs(spark, folder) -> DataFrame:
    items = _doc_samples(spark, folder)
    return selection.judge_text(items, PROSE, F.col("lang")).select(
        "source_line", "type", "instruction", "code", "shape", "reason", "score"
    )


@register
def first_reason_filter(spark, folder):
    return _judged_docs(spark, folder).select(
        "source_line", F.coalesce("reason", F.lit("kept")).alias("reason")
    )


@register
def skip_reasons(spark, folder):
    return selection.skip_reasons(_judged_docs(spark, folder))


@register
def quality_score(spark, folder):
    scored = _judged_docs(spark, folder).filter(F.col("reason").isNull())
    return scored.select("source_line", "shape", "score")


@register
def candidate_dedupe(spark, folder):
    pool = selection.candidates(_judged_docs(spark, folder))
    return pool.select("source_line", "instruction", F.md5("code").alias("code_md5"))


def _balanced_docs(pool: DataFrame) -> DataFrame:
    return selection.select_balanced(pool, PROSE_TARGET, major="en", minor="de")


@register
def balanced_select(spark, folder):
    pool = spool(selection.candidates(_judged_docs(spark, folder)), "pool")
    return _balanced_docs(pool).select(
        "shuffle_rank", "source_line", "shape", "score", "instruction", "code"
    )


def _flat_report(report: DataFrame) -> DataFrame:
    return report.select(
        "total_seen", "filtered_count", "selected_count", "score_min", "score_max",
        F.round("score_avg", 6).alias("score_avg"),
        F.to_json("shape_counts").alias("shape_counts"),
        F.to_json("skip_reasons").alias("skip_reasons"),
    )


@register
def selection_report(spark, folder):
    judged = spool(selection.without_rejected_text(_judged_docs(spark, folder)), "judged")
    pool = spool(selection.candidates(judged).drop("code", "instruction"), "pool")
    keys = selection.balanced_keys(pool, PROSE_TARGET, major="en", minor="de")
    return _flat_report(selection.selection_report(judged, pool, keys))


def _code_items(spark, folder) -> DataFrame:
    built = samples.distinct_samples(_checked(spark, folder))
    return number_rows(built.select(
        *samples.ORDER, "type", "instruction", "code"
    ), samples.ORDER, "source_line")


@register
def judge_code(spark, folder):
    return selection.judge(_code_items(spark, folder)).select(
        "source_line", F.coalesce("reason", F.lit("kept")).alias("reason"), "shape", "score"
    )


# Snippets for the syntax rules, each with its document as a comment.
ODD_SNIPPETS = {
    0: "# {cmt}\ndef odd_{id}(:\n    return 1\n",
    1: "import os, sys\nimport re\nimport json\nimport ast\n# {cmt}\ndef odd_{id}(a):\n    return a\n",
    2: "# {cmt}\ndef odd_{id}(a):\n    return a\n",
    3: "# {cmt}\nx = {id}\nif x:\n    y = 1\n",
}


@register
def judge_odd_code(spark, folder):
    cases = " ".join(f"WHEN {k} THEN {corpus.sql_text(t)}" for k, t in ODD_SNIPPETS.items())
    rules = selection.Rules(bad_code=(), code_chars=(1, 1 << 30))
    items = _docs(spark, folder).select(
        F.col("doc_id").alias("source_line"), F.lit("code_comment").alias("type"),
        F.lit("an instruction of good length").alias("instruction"),
        F.expr(f"CASE doc_id % 4 {cases} END").alias("code"),
    )
    return selection.judge(items, rules).select(
        "source_line", F.coalesce("reason", F.lit("kept")).alias("reason"), "shape"
    )


@register
def select_code(spark, folder):
    pool = spool(selection.candidates(selection.judge(_code_items(spark, folder))), "pool")
    return selection.select_balanced(pool, CODE_TARGET).select(
        "shuffle_rank", "source_line", "shape", "score", "type", "instruction", "code"
    )


# ---------------------------------------------------------------- tokens


def _some_blank(spark, folder) -> DataFrame:
    return tables.with_blank_samples(_doc_samples(spark, folder))


@register
def code_by_type(spark, folder):
    return tokens.with_code(_some_blank(spark, folder)).select(
        "doc_id", "type", "code", "is_blank"
    )


@register
def blank_rejects(spark, folder):
    return tokens.blank_rejects(_some_blank(spark, folder), "doc_id")


@register
def token_ids(spark, folder):
    tokenised = tokens.tokenise(_doc_samples(spark, folder), ["doc_id"])
    return tokenised.withColumn(
        "input_ids", F.array_join(F.transform("input_ids", lambda i: i.cast("string")), " ")
    )


@register
def token_stats(spark, folder):
    return tokens.token_stats(tokens.sizes(_some_blank(spark, folder)))


def _choosy_tokenizer():
    """Byte ids; fails on texts with a certain word."""
    def encode(text):
        if CHOKES_ON in text:
            raise ValueError("a word I do not know")
        return list(text.encode())
    return encode


def _chosen_tokens(spark, folder) -> DataFrame:
    return tokens.tokenise_with(
        _some_blank(spark, folder), _choosy_tokenizer, byte_tokens.EOS_ID, ["doc_id"]
    )


@register
def tokenise_with(spark, folder):
    return _chosen_tokens(spark, folder).select(
        "doc_id", "type", "n_tokens", "original_tokens", "truncated", "error",
        _joined_md5("input_ids").alias("ids_md5"),
    )


@register
def tokenise_with_stats(spark, folder):
    return tokens.token_stats(_chosen_tokens(spark, folder))


@register
def token_rejects(spark, folder):
    return tokens.token_rejects(_chosen_tokens(spark, folder), "doc_id")


@register
def token_type_counts(spark, folder):
    return tokens.type_counts(tokens.sizes(_doc_samples(spark, folder)))


@register
def length_report(spark, folder):
    return tokens.length_report(tokens.tokenise(_doc_samples(spark, folder)))


@register
def attention_mask(spark, folder):
    tokenised = tokens.tokenise(_doc_samples(spark, folder), ["doc_id"])
    given = (
        F.when(F.col("doc_id") % 3 == 0, F.array_repeat(F.lit(0), F.size("input_ids")))
        .when(F.col("doc_id") % 3 == 1, F.array_repeat(F.lit(0), 3))
    )
    inputs = tokens.model_inputs(tokenised.withColumn("attention_mask", given), ["doc_id"])
    return inputs.select(
        "doc_id", _joined_md5("input_ids").alias("ids_md5"),
        _joined_md5("attention_mask").alias("mask_md5"),
    )


@register
def pad_batches(spark, folder):
    tokenised = tokens.tokenise(_doc_samples(spark, folder), ["doc_id"])
    batches = tokens.padded_batches(tokenised, "doc_id", pad_id=byte_tokens.EOS_ID)
    return batches.select(
        "doc_id", "batch_id", "pad_to", "padding", _joined_md5("input_ids").alias("ids_md5"),
        _joined_md5("attention_mask").alias("mask_md5"),
    )


# --------------------------------------------------------------- formats


@register
def sft_prompt_completion(spark, folder):
    built = formats.prompt_completion(_pairs(spark, folder))
    kept = formats.drop_empty(built, "prompt", "completion")
    return kept.select("conv_id", "turn", "prompt", "completion")


@register
def sft_text(spark, folder):
    return formats.drop_empty(formats.single_text(_pairs(spark, folder)), "text").select(
        "conv_id", "turn", "text"
    )


@register
def sft_text_marked(spark, folder):
    return formats.drop_empty(formats.marked_text(_pairs(spark, folder), EOS_TEXT), "text").select(
        "conv_id", "turn", "text"
    )


@register
def sft_system_prompt(spark, folder):
    return formats.prompt_completion(_pairs(spark, folder), system=True).select(
        "conv_id", "turn", "prompt"
    )


@register
def format_counts(spark, folder):
    built = formats.prompt_completion(_some_blank(spark, folder))
    return formats.format_counts(built, "prompt", "completion")


@register
def format_rejects(spark, folder):
    built = formats.prompt_completion(_some_blank(spark, folder))
    return formats.empty_rejects(built, "doc_id", "prompt", "completion")


@register
def completion_mask(spark, folder):
    masked = formats.completion_masks(_doc_samples(spark, folder), ["doc_id"])
    return formats.mask_counts(masked, ["doc_id"], keep=("input_ids", "labels")).withColumns(
        {"ids_md5": _joined_md5("input_ids"), "labels_md5": _joined_md5("labels")}
    ).drop("input_ids", "labels")


@register
def eval_prompts(spark, folder):
    cases = tables.table(spark, folder, "benchmark").withColumnRenamed("text", "instruction")
    return evaluation.eval_prompts(cases).select("item_id", "prompt")


# ------------------------------------------------- audits and evaluation


@register
def roundtrip_audit(spark, folder):
    return audit.roundtrip(_docs(spark, folder), ["doc_id"], "text")


@register
def roundtrip_summary(spark, folder):
    return audit.roundtrip_summary(audit.roundtrip(_docs(spark, folder), ["doc_id"], "text"))


@register
def format_token_counts(spark, folder):
    marked = F.replace(F.replace("source", F.lit(" "), F.lit("Ġ")), F.lit("\n"), F.lit("Ċ"))
    pieces = F.regexp_extract_all(marked, F.lit("Ċ+Ġ*|Ġ+|[^ĊĠ]+"), F.lit(0))
    counted = corpus.code_files(_docs(spark, folder)).select(
        "file_path", audit.format_token_counts(pieces).alias("c")
    )
    return counted.select("file_path", "c.*")


@register
def trained_part(spark, folder):
    masked = formats.completion_masks(_pairs(spark, folder), ["conv_id", "turn"])
    return audit.trained_part(masked, ["conv_id", "turn"])


@register
def random_rows(spark, folder):
    return audit.random_rows(_docs(spark, folder), "doc_id", 100).select("doc_id", "text")


@register
def first_samples(spark, folder):
    return first_rows(_docs(spark, folder), ["doc_id"], 100).select("doc_id", "text")


def _losses(spark, folder) -> DataFrame:
    """Losses of the documents, and of a text without words for every seventh of them."""
    docs = _docs(spark, folder).select("doc_id", "text")
    empty = docs.filter(F.col("doc_id") % 7 == 0).select(
        (F.col("doc_id") + tables.BLANK_IDS).alias("doc_id"), F.lit(" \n").alias("text")
    )
    return evaluation.unigram_losses(docs.unionByName(empty), "doc_id", "text")


@register
def unigram_losses(spark, folder):
    return _losses(spark, folder).select("doc_id", F.round("loss", 6).alias("loss"), "n_tokens")


def _rounded(perplexity: DataFrame) -> DataFrame:
    return perplexity.withColumn("mean_loss", F.round("mean_loss", 6)).withColumn(
        "perplexity", F.round("perplexity", 3)
    )


@register
def perplexity_weighted(spark, folder):
    return _rounded(evaluation.weighted_perplexity(_losses(spark, folder)))


@register
def perplexity_of_corpus(spark, folder):
    return _rounded(evaluation.unigram_perplexity(_docs(spark, folder), "text"))


@register
def perplexity_batch_mean(spark, folder):
    numbered = number_rows(_losses(spark, folder), ["doc_id"])
    batches = evaluation.batch_losses(numbered, tokens.BATCH_ROWS)
    return _rounded(evaluation.batch_perplexity(batches))


def _held_out_losses(spark, folder) -> DataFrame:
    """Losses of all documents under models of those that are not held out."""
    docs = _docs(spark, folder).select("doc_id", "text")
    fitted = F.col("doc_id") % 5 != 0
    coded = evaluation.code_texts(docs, "doc_id", "text", fitted)
    one = evaluation.unigram_losses(docs, "doc_id", "text", fitted, coded)
    two = evaluation.bigram_losses(docs, "doc_id", "text", fitted, coded)
    coded.drop()
    return one.withColumn("model", F.lit("unigram")).unionByName(
        two.withColumn("model", F.lit("bigram"))
    ).withColumn("held_out", F.col("doc_id") % 5 == 0)


@register
def bigram_losses(spark, folder):
    rows = _held_out_losses(spark, folder)
    return rows.filter("model = 'bigram'").select(
        "doc_id", "held_out", F.round("loss", 6).alias("loss"), "n_tokens")


@register
def perplexity_held_out(spark, folder):
    rows = _held_out_losses(spark, folder)
    n = F.sum("n_tokens")
    mean = F.sum(F.col("loss") * F.col("n_tokens")) / n
    return rows.groupBy("model", "held_out").agg(
        n.alias("n_tokens"), F.round(mean, 6).alias("mean_loss"),
        F.round(F.exp(mean), 3).alias("perplexity"),
    )


# Generated-looking text: byte-pair marks, glued words, deep and ragged spacing.
GENERATED_SQL = (
    "concat('ĠĠclassAĊĠĠĠĠdefrun(x,Ġ ĠyĠ)ĊĊĊĊ', "
    "replace(replace(text, ' ', 'ĠĠ'), chr(10), 'ĊĊĊĠ'), "
    "'Ċ', chr(9), 'returnvalue (Ġ1Ġ)ĠĊimportosĊprintxĊ')"
)


@register
def clean_generated_text(spark, folder):
    made = tables.table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.expr(GENERATED_SQL).alias("text")
    )
    return made.select("conv_id", "turn", "role", clean_generated("text").alias("text"))


ECHO = "### Instruction:\nx\n\n###  Response:\n"


@register
def clean_response(spark, folder):
    compact = _docs(spark, folder).select(
        "doc_id", F.expr(corpus.by_template(corpus.SOURCES)).alias("source")
    )
    echoed = F.concat(F.lit(ECHO), F.expr(COMPACT_SQL))
    return compact.select("doc_id", response(echoed).alias("code"))


@register
def strip_tags(spark, folder):
    echoed = F.concat(F.lit(ECHO), "html")
    return tables.table(spark, folder, "pages").select(
        "page_id", strip_markup(echoed).alias("text")
    )


# Sources squeezed into what a model glues together; every third one on a single line.
COMPACT_SQL = (
    "CASE doc_id % 3 WHEN 0 THEN replace(replace(source, ' ', ''), chr(10), ' ') "
    "ELSE replace(source, ' ', '') END"
)


@register
def repair_code(spark, folder):
    compact = _docs(spark, folder).select(
        "doc_id", F.expr(corpus.by_template(corpus.SOURCES)).alias("source")
    )
    return compact.select("doc_id", repair_compact(F.expr(COMPACT_SQL)).alias("code"))


def _answers(spark, folder) -> DataFrame:
    """Answers that should hold words of the prompt or, every other one, their own first words."""
    asked = F.array_distinct(F.split("instruction", " "))
    own = F.slice(F.split("code", " "), 1, 3)
    return _pairs(spark, folder).withColumn(
        "expected", F.when(F.col("conv_id") % 2 == 0, own).otherwise(asked)
    )


@register
def expected_hits(spark, folder):
    return evaluation.expected_hits(_answers(spark, folder), "code", "expected").select(
        "conv_id", "turn", "hits", "wanted", "passed"
    )


@register
def expected_pass_rate(spark, folder):
    checked = evaluation.expected_hits(_answers(spark, folder), "code", "expected")
    return evaluation.pass_rate(checked, "turn")


# ------------------------------------------------- a merging vocabulary


@register
def vocabulary_labels(spark, folder):
    """Labels of continued documents: many a token spans the end of the prompt."""
    path = tables.public_vocabulary()
    continued = tables.continuations(_docs(spark, folder))
    masked = vocabulary.labels(continued, path, ["doc_id"], "prompt", "completion")
    counts = formats.mask_counts(masked, ["doc_id"], keep=("straddling", "input_ids", "labels"))
    return counts.withColumns(
        {"ids_md5": _joined_md5("input_ids"), "labels_md5": _joined_md5("labels")}
    ).drop("input_ids", "labels")


@register
def vocabulary_masks(spark, folder):
    """Labels of fenced dialogue turns, and what of them is trained."""
    path, key = tables.public_vocabulary(), ["conv_id", "turn"]
    masked = vocabulary.completion_masks(_pairs(spark, folder), path, key)
    return vocabulary.trained_part(masked, path, key)


@register
def vocabulary_roundtrip(spark, folder):
    return vocabulary.roundtrip(_docs(spark, folder), tables.public_vocabulary(), ["doc_id"], "text", 1024)


@register
def vocabulary_windows(spark, folder):
    """Windows of 100 ids, joined again: what each text is cut into adds up to it."""
    path = tables.public_vocabulary()
    cut = vocabulary.windows(_docs(spark, folder), path, ["doc_id"], "text", 100)
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return cut.groupBy("doc_id").agg(
        F.md5(F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("text_md5"),
        (F.max(F.size("ids")) <= 100).alias("within"),
    )


@register
def vocabulary_tokens(spark, folder):
    made = vocabulary.tokenise(
        _doc_samples(spark, folder), tables.public_vocabulary(), "<|endoftext|>", ["doc_id"])
    return made.select(
        "doc_id", "type", "n_tokens", "original_tokens", "truncated",
        _joined_md5("input_ids").alias("ids_md5"),
    )


# ------------------------------------------------------------- streaming


def _arrivals(spark, folder) -> DataFrame:
    """Documents as a stream; ids run against time, so most rows arrive late."""
    schema = _docs(spark, folder).schema
    arrivals = incremental.read_arrivals(spark, f"{folder}/documents.parquet*", schema)
    return arrivals.withColumn(
        "arrived_at", F.timestamp_seconds(F.lit(4_000_000_000) - F.col("doc_id") * 86_400)
    )


@register
def stream_dedupe(spark, folder):
    out = scratch_path(spark, "stream")
    arrivals = _arrivals(spark, folder)
    incremental.run_distinct(arrivals, "text", ["arrived_at", "doc_id"], out, out + "-state")
    return spark.read.schema("code_hash string, text string").parquet(f"{out}/files").drop(
        incremental.BATCH
    )


def _cleaned_stream(spark, folder) -> str:
    arrived = _arrivals(spark, folder).select(
        F.expr(corpus.FILE_PATH).alias("file_path"),
        F.when(F.col("doc_id") % 50 == 3, F.lit(None).cast("string"))
        .otherwise(F.expr(corpus.by_template(corpus.SOURCES))).alias("source"), "arrived_at",
    )
    stamped = cleaning.as_sources(arrived, "file_path", "source", keep=("arrived_at",))
    out = scratch_path(spark, "stream")
    incremental.run_clean(stamped, out, out + "-state")
    return out


@register
def stream_clean(spark, folder):
    files_ = f"{_cleaned_stream(spark, folder)}/files"
    return spark.read.schema("code_hash string, source string").parquet(files_).drop(
        incremental.BATCH
    )


@register
def stream_rejects(spark, folder):
    rejects = f"{_cleaned_stream(spark, folder)}/rejects"
    return spark.read.schema("stage string, key string, reason string").parquet(rejects).drop(
        incremental.BATCH
    )


@register
def all_rejects(spark, folder):
    """Every stage's input, kept rows and rejects; the rejects make up the difference."""
    docs = _docs(spark, folder)
    blank = _some_blank(spark, folder)
    # Each stage runs once; what is counted and listed of it is read from its table.
    landed = spool(ingest.landed(tables.odd_contents(docs)).drop("source"), "landed")
    cleaned = spool(_cleaned_odd(spark, folder).drop("source", "outline"), "cleaned")
    checked = spool(
        samples.check(samples.extract(cleaning.cleaned_files(_cleaned(spark, folder))))
        .drop("code", "instruction"), "checked")
    tokenised = spool(_chosen_tokens(spark, folder).drop("input_ids"), "tokenised")
    built = formats.prompt_completion(blank)
    n = F.count(F.lit(1))

    def row(stage: str, rows: DataFrame, kept: Column, rejects: list[DataFrame]) -> DataFrame:
        counts = [
            rows.agg(n.alias("rows_in"), F.count_if(kept).alias("kept"), F.lit(0).alias("rejected"))
        ] + [
            r.agg(F.lit(0).alias("rows_in"), F.lit(0).alias("kept"), n.alias("rejected"))
            for r in rejects
        ]
        whole = counts[0]
        for more in counts[1:]:
            whole = whole.unionByName(more)
        return whole.agg(*[F.sum(c).alias(c) for c in ("rows_in", "kept", "rejected")]).select(
            F.lit(stage).alias("stage"), "rows_in", "kept", "rejected"
        )

    failed = tokens.token_rejects(tokenised, "doc_id").filter("reason = 'tokenizer_error'")
    stages = [
        row("ingest", landed, F.col("reason").isNull(), [ingest.landing_rejects(landed)]),
        row("clean", cleaned, F.col("outcome") == cleaning.PASSED, [cleaning.rejects(cleaned)]),
        row("samples", checked, F.col("reason").isNull(), [samples.rejects(checked)]),
        row("tokens", tokens.with_code(blank).join(
            tokenised.filter("error is null").select("doc_id", F.lit(1).alias("_kept")),
            "doc_id", "left",
        ), F.col("_kept").isNotNull(), [tokens.blank_rejects(blank, "doc_id"), failed]),
        row("format", built, (strip("prompt") != "") & (strip("completion") != ""),
            [formats.empty_rejects(built, "doc_id", "prompt", "completion")]),
    ]
    whole = stages[0]
    for more in stages[1:]:
        whole = whole.unionByName(more)
    return whole.withColumn("whole", F.col("rows_in") == F.col("kept") + F.col("rejected"))


# --------------------------------------------- sources and sinks, there and back


@register
def source_tree(spark, folder):
    """The cleaned corpus written as a tree of files, with other files among them, and scanned again:
    every path and the hash of its bytes."""
    root, docs = scratch_path(spark, "tree"), _docs(spark, folder)
    code = corpus.code_files(docs)
    deep = code.select(F.concat(F.lit("deep/er/"), "file_path").alias("file_path"), "source")
    other = code.select(F.concat("file_path", F.lit(".txt")).alias("file_path"), "source")
    sinks.write_tree(code.unionByName(deep).unionByName(other), root)
    return files.source_tree(spark, root).select(
        "file_path", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("content_md5"))


@register
def json_load(spark, folder):
    path = scratch_path(spark, "json")
    sinks.write_json_samples(_doc_samples(spark, folder), path)
    return files.json_samples(spark, path).select(
        "type", "instruction", F.md5("code").alias("code_md5")
    )


@register
def manifest_table(spark, folder):
    path = scratch_path(spark, "manifest")
    sinks.write_table(cleaning.manifest(_cleaned(spark, folder)), path)
    return files.manifest(spark, path).select(
        "file_path", "line_count", F.size("imports").alias("n_imports")
    )


@register
def token_table(spark, folder):
    path = scratch_path(spark, "tokens")
    sinks.write_table(tokens.tokenise(_doc_samples(spark, folder), ["source_line"]), path)
    return files.token_table(spark, path).select(
        "source_line", "type", "n_tokens", _joined_md5("input_ids").alias("ids_md5")
    )


@register
def report_file(spark, folder):
    path = scratch_path(spark, "report")
    sinks.write_report(cleaning.outcome_counts(_cleaned(spark, folder)), path)
    return spark.read.json(path)


@register
def cleaned_by_repository(spark, folder):
    path = scratch_path(spark, "cleaned")
    sinks.write_cleaned(cleaning.cleaned_files(_cleaned(spark, folder)), path)
    return spark.read.parquet(path).select("repo", "file_path", F.md5("source").alias("source_md5"))


@register
def sample_rejects(spark, folder):
    return samples.rejects(_checked(spark, folder)).select("stage", "key", "reason", "detail")


@register
def kept_eos(spark, folder):
    tokenised = tokens.tokenise(_doc_samples(spark, folder), ["doc_id"], keep_eos=True)
    return tokenised.select(
        "doc_id", F.element_at("input_ids", -1).alias("last_id"), F.size("input_ids").alias("n_ids")
    )


@register
def sft_text_stripped(spark, folder):
    marked = _pairs(spark, folder).withColumn("code", with_end_marker("code"))
    built = formats.marked_text(marked, EOS_TEXT, strip_marker=True)
    return formats.drop_empty(built, "text").select("conv_id", "turn", "text")
