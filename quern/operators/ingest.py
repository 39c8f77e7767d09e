"""Choosing repositories, skipping unchanged ones and landing their files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.text import path_stays_inside, utf8_text

# The default search.
MIN_STARS = 100
MIN_FORKS = 10
PUSHED_AFTER = datetime(2025, 1, 1)
MAX_REPOS = 50
# A key row takes well under 200 bytes.
BROADCAST_REPOS = 100_000


def top_repos(
    listing: DataFrame, min_stars: int = MIN_STARS, min_forks: int = MIN_FORKS,
    pushed_after: datetime = PUSHED_AFTER, language: str | None = "python",
    max_results: int = MAX_REPOS,
) -> DataFrame:
    """Repositories above the limits, most stars first; ties by name.  None if the cap is <= 0."""
    wanted = (
        (F.col("stars") > min_stars) & (F.col("forks") > min_forks)
        & (F.col("pushed_at") > F.lit(pushed_after))
    )
    if language is not None:
        wanted &= F.lower("language") == language
    ranked = listing.filter(wanted).orderBy(F.desc("stars"), "repo")
    return ranked.limit(max(max_results, 0))


def changed_repos(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Repositories whose stored time stamp is missing or differs (also if it is newer)."""
    return listing.join(state.select("repo", "updated_at"), ["repo", "updated_at"], "left_anti")


def updated_state(state: DataFrame, fetched: DataFrame) -> DataFrame:
    """State after a run: fetched repositories replace their old time stamps."""
    new = fetched.select("repo", F.col("updated_at").alias("_new"))
    return state.join(new, "repo", "full_outer").select(
        "repo", F.coalesce("_new", "updated_at").alias("updated_at")
    )


def python_files(contents: DataFrame) -> DataFrame:
    return contents.filter((F.col("type") == "file") & F.endswith("path", F.lit(".py")))


def _from_base64(name: str) -> Column:
    """Bytes of base64 text, which may be broken into lines; NULL if it is malformed."""
    return F.try_to_binary(F.translate(name, "\r\n\t ", ""), F.lit("base64"))


def decoded_files(contents: DataFrame) -> DataFrame:
    """Base64 contents as text; rows in another encoding are left out.  ``source`` is NULL where
    the contents are no valid base64."""
    text = utf8_text(_from_base64("content"))
    kept = contents.filter(F.col("encoding") == "base64")
    return kept.withColumn("source", text).drop("content", "encoding")


def landed(fetched: DataFrame) -> DataFrame:
    """Python files of fetched repositories, decoded once: ``source`` and, for those that can't be
    kept, ``reason``."""
    files = guard_paths(decoded_files(python_files(fetched)))
    reason = F.when(F.col("source").isNull(), "undecodable_content").when(
        ~F.col("path_ok"), "refused_path"
    )
    return files.withColumn("reason", reason)


def landing_rejects(files: DataFrame) -> DataFrame:
    return files.filter(F.col("reason").isNotNull()).select(
        F.lit("ingest").alias("stage"), F.concat_ws("/", "repo", "path").alias("key"), "reason",
        F.lit(None).cast("string").alias("detail"),
    )


def complete_state(fetched: DataFrame, files: DataFrame) -> DataFrame:
    """Fetched repositories whose files all decoded, also those without any Python file: their
    state may be stored."""
    failed = files.filter(F.col("reason") == "undecodable_content").select("repo").distinct()
    return fetched.select("repo", "updated_at").distinct().join(failed, "repo", "left_anti")


def guard_paths(files: DataFrame) -> DataFrame:
    """Adds ``path_ok``: the path stays inside its repository's folder."""
    return files.withColumn("path_ok", path_stays_inside("path"))


def saved_counts(files: DataFrame) -> DataFrame:
    """Files kept and refused per repository."""
    def count(condition: Column) -> Column:
        return F.count_if(condition)
    return guard_paths(files).groupBy("repo").agg(
        count(F.col("path_ok")).alias("saved"), count(~F.col("path_ok")).alias("refused")
    )
