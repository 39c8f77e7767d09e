"""Every registered query against its SQL, and what the plans must not contain."""

import pytest

import __spark_entry__ as entry
import compare
from quern.plans.oracles import ORACLES
from quern.plans.queries import QUERIES



@pytest.fixture(scope="module")
def con(data):
    return compare.connect(data)


# SQL cannot encode with a vocabulary; tests/test_vocabulary.py compares with the library.
WITHOUT_SQL = {"vocabulary_labels", "vocabulary_masks", "vocabulary_roundtrip", "vocabulary_tokens"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, data, name):
    got = compare.spark_rows(QUERIES[name](spark, data))
    assert got[1]
    assert got == compare.sql_rows(con, ORACLES[name])


def test_every_query_has_sql():
    assert set(ORACLES) | WITHOUT_SQL == set(QUERIES) and not WITHOUT_SQL & set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = [
    "ingest_topk", "redact_pii", "first_reason_filter", "exact_dedupe_first", "token_stats",
    "completion_mask", "unigram_losses", "repair_code", "expected_hits", "sft_text",
]


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_stay_in_the_jvm(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "Python" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scan_reads_only_needed_columns(spark, data):
    text = plan(QUERIES["exact_dedupe_first"](spark, data))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_filters_reach_the_scan(spark, data):
    text = plan(QUERIES["sft_text"](spark, data))
    assert "EqualTo(role,user)" in text and "EqualTo(role,assistant)" in text


def test_top_k_is_limited_before_the_shuffle(spark, data):
    text = plan(QUERIES["per_source_cap"](spark, data))
    assert text.count("WindowGroupLimit") >= 2


def test_cleaning_parses_in_one_python_stage(spark, data):
    text = plan(QUERIES["clean_sources"](spark, data))
    assert text.count("ArrowEvalPython") == 1


def test_stages_of_all_rejects_run_once(spark, data, monkeypatch):
    """What is counted and listed of a stage is read from its table."""
    from quern.plans import queries
    made = []
    monkeypatch.setattr(queries, "spool", lambda df, label: made.append(label) or df.limit(0))
    queries.all_rejects(spark, data)
    assert made == ["landed", "cleaned", "checked", "tokenised"]
