"""Inputs for the registered queries: the given tables, and stage tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def document_samples(docs: DataFrame) -> DataFrame:
    """Documents in the role of samples: the first line is the instruction, the text the code."""
    slot = F.col("doc_id") % 5
    return docs.select(
        "doc_id", "lang", "source", (F.col("doc_id") + 1).alias("source_line"),
        F.when(slot == 0, "completion").when(slot == 1, "bug_fix").otherwise("code_comment")
        .alias("type"),
        F.substring_index("text", "\n", 1).alias("instruction"),
        F.col("text").alias("code"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# original\n"), "text"))
        .alias("original_code"),
        F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n# fixed"))).alias("fixed_code"),
    )


BLANK_IDS = 1_000_000_000_000


def with_blank_samples(samples: DataFrame) -> DataFrame:
    """The samples, and for every seventh a further one that holds white space only."""
    blank = samples.filter(F.col("doc_id") % 7 == 0).withColumns({
        "doc_id": F.col("doc_id") + BLANK_IDS, "code": F.lit(" \n"),
        "original_code": F.lit(None).cast("string"), "fixed_code": F.lit(""),
    })
    return samples.unionByName(blank)


def dialogue_pairs(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn right after it.  The join key (conversation, turn)
    is unique, so one huge conversation does not end up in one task."""
    asked = conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("instruction")
    )
    answered = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("code")
    )
    return asked.join(answered, ["conv_id", "turn"]).withColumn("type", F.lit("code_comment"))


def repo_listing(events: DataFrame, until: str | None = None) -> DataFrame:
    """Users of the event table in the role of repositories."""
    seen = events if until is None else events.filter(F.col("ts") < F.lit(until).cast("timestamp"))
    return seen.groupBy(F.concat(F.lit("user/"), "user_id").alias("repo")).agg(
        F.max("ts").alias("updated_at"), F.max("ts").alias("pushed_at"),
        F.count(F.lit(1)).alias("stars"),
        F.count_if(F.col("event_type") == "click").alias("forks"),
    ).withColumn("language", F.lit("Python"))


def page_files(pages: DataFrame) -> DataFrame:
    """Pages in the role of repository files; some paths try to leave their folder."""
    path = F.regexp_replace("url", r"^https?://[^/]+/", "")
    return pages.select(
        "page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("repo"),
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("../"), path))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit("a/../"), path))
        .when(F.col("page_id") % 5 == 2, F.concat(F.lit("a/../../a/"), path))
        .when(F.col("page_id") % 5 == 3, F.concat(F.lit("/"), path))
        .otherwise(F.concat(F.lit("./"), path)).alias("path"),
    )


def encoded_contents(docs: DataFrame) -> DataFrame:
    """Documents as a repository listing with base64 contents."""
    suffix = F.when(F.col("doc_id") % 4 == 0, ".md").otherwise(".py")
    return docs.select(
        F.col("source").alias("repo"),
        F.concat("lang", F.lit("/"), "doc_id", suffix).alias("path"),
        F.when(F.col("doc_id") % 9 == 0, "dir").otherwise("file").alias("type"),
        F.when(F.col("doc_id") % 11 == 0, "none").otherwise("base64").alias("encoding"),
        F.base64(F.encode("text", "UTF-8")).alias("content"),
    )


def odd_contents(docs: DataFrame) -> DataFrame:
    """``encoded_contents`` and, for every fifth document, a file with a path that climbs out and
    one whose contents are no base64."""
    climbing = F.concat(F.lit("../"), "doc_id", F.lit(".py"))
    broken = F.concat(F.lit("broken/"), "doc_id", F.lit(".py"))
    some = docs.filter(F.col("doc_id") % 5 == 0)

    def odd(path, content):
        return some.select(
            F.col("source").alias("repo"), path.alias("path"), F.lit("file").alias("type"),
            F.lit("base64").alias("encoding"), content.alias("content"),
        )
    good = F.base64(F.encode("text", "UTF-8"))
    return (
        encoded_contents(docs).unionByName(odd(climbing, good))
        .unionByName(odd(broken, F.lit("###")))
    )


def odd_lines(samples: DataFrame) -> DataFrame:
    """Every sample as a JSON line, in order, each followed by a line of another kind."""
    packed = F.to_json(F.struct("type", "instruction", "code"))
    kind = F.col("source_line") % 10
    single = F.lit("{'type': 'code_comment', 'instruction': 'single', 'code': 'quotes'}")
    other = (
        F.when(kind == 0, F.concat(packed, F.lit(" tail")))
        .when(kind == 1, F.concat(packed, packed))
        .when(kind == 2, single)
        .when(kind == 3, F.concat(F.lit("\t"), packed))
        .when(kind == 4, F.lit("\u3000"))
        .when(kind == 5, F.lit("3"))
        .when(kind == 6, F.lit('{"type": "\\x"}'))
        .when(kind == 7, F.concat(packed, F.lit(","), packed))
        .when(kind == 8, F.lit('["a", {"type": "b"}]'))
        .otherwise(F.lit("  "))
    )
    return samples.select(
        "source_line", F.posexplode(F.array(packed, other)).alias("place", "value")
    )


def raw_files(docs: DataFrame) -> DataFrame:
    """Documents as bytes of source files: UTF-8, Latin-1 with a declaration, UTF-8 with a byte
    order mark, and UTF-8 with other line ends."""
    slot = F.col("doc_id") % 4
    declared = F.concat(F.lit("# coding: latin-1\n"), "text")
    utf8 = F.encode("text", "UTF-8")
    return docs.select(
        F.concat("source", F.lit("/"), "doc_id").alias("file_path"),
        F.when(slot == 0, utf8).when(slot == 1, F.encode(declared, "ISO-8859-1"))
        .when(slot == 2, F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .otherwise(F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8"))
        .alias("content"),
    )


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file, which every worker has."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


CONTINUED_SHARE = 0.4


def continuations(docs: DataFrame) -> DataFrame:
    """Documents as a prompt and its continuation.  The border lies anywhere, also within words."""
    border = F.floor(F.length("text") * CONTINUED_SHARE).cast("int")
    return docs.select(
        "doc_id", F.substr("text", F.lit(1), border).alias("prompt"),
        F.substr("text", border + 1).alias("completion"),
    )
