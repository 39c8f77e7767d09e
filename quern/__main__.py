"""Command line: ``python -m quern <job> ...``, or ``spark-submit --py-files quern.zip
quern/__main__.py <job> ...`` on a cluster."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quern.plans import jobs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quern")
    sub = top.add_subparsers(dest="job", required=True)

    def job(name: str, *paths: str) -> argparse.ArgumentParser:
        one = sub.add_parser(name)
        for path in paths:
            one.add_argument(f"--{path}", required=True)
        return one
    one = job("ingest", "listing", "contents", "state", "out")
    one.add_argument("--max-results", type=int, default=jobs.ingest.MAX_REPOS)
    job("clean", "raw", "out")
    job("clean-changed", "raw", "out")
    job("samples", "cleaned", "out")
    one = job("select", "jsonl", "out")
    one.add_argument("--target", type=int, default=1000)
    one.add_argument("--seed", type=int, default=42)
    one = job("tokens", "jsonl", "out")
    one.add_argument("--limit", type=int, default=jobs.tokens.MAX_TOKENS)
    one.add_argument("--keep-eos", action="store_true")
    one.add_argument("--vocabulary")
    one.add_argument("--eos", default=jobs.EOS)
    one = job("format", "jsonl", "out")
    one.add_argument("--style", choices=sorted(jobs.STYLES), default="text")
    job("publish", "cleaned", "out")
    one = job("batches", "table", "out")
    one.add_argument("--rows", type=int, default=jobs.tokens.BATCH_ROWS)
    one.add_argument("--pad-id", type=int, default=0)
    one = job("masks", "jsonl", "out")
    one.add_argument("--vocabulary")
    one.add_argument("--rule", choices=jobs.vocabulary_rules(), default="mask")
    job("audit", "jsonl", "out").add_argument("--vocabulary")
    job("perplexity", "losses", "out")
    job("evaluate", "cases", "answers", "out")
    job("incremental-clean", "arrivals", "out", "checkpoint")
    return top


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    run = getattr(jobs, args.pop("job").replace("-", "_") + "_job")
    spark = SparkSession.builder.appName("quern").getOrCreate()
    report = run(spark, **args)
    if report is not None:
        report.show(truncate=False)


if __name__ == "__main__":
    main()
