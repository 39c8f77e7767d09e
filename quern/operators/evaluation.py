"""Losses, perplexity and checks of model answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.functions import pairs
from quern.functions.prompts import prompt
from quern.functions.text import SPACE_CLASS, col
from quern.session import delete_table, dropping_shuffles, handovers, scratch_path, spool

# Nothing is broadcast by frequency any more; tests that set the share find that it changes nothing.
HEAVY = 10_000


def words(texts: DataFrame, key: Column | str, text: str) -> DataFrame:
    parts = F.split(col(text), f"(?U)[{SPACE_CLASS}]+")
    return texts.select(key, F.explode(parts).alias("token")).filter(F.col("token") != "")


def _cost(seen: Column, mass: Column) -> Column:
    """Negative log-likelihood of a word under add-one smoothing."""
    return -F.log((seen + 1) / mass)


def _vocabulary(used: DataFrame, corpus: DataFrame | None, text: str) -> DataFrame:
    """(token, seen, used): occurrences in the corpus and in the texts.  The counts of the texts
    serve for both if no corpus is given."""
    if corpus is None:
        return used.select("token", F.col("used").alias("seen"), "used")
    tokens = words(corpus, F.lit(0).alias("_"), text).select(
        "token", F.lit(1).alias("seen"), F.lit(0).alias("used")
    )
    both = tokens.unionByName(used.select("token", F.lit(0).alias("seen"), "used"))
    return both.groupBy("token").agg(F.sum("seen").alias("seen"), F.sum("used").alias("used"))


def _mass() -> Column:
    return F.sum("seen") + F.count_if(F.col("seen") > 0)


@dataclass
class CodedTexts:
    """Texts as numbers of their words, in chunks, and the counts of these words, on the shared folder."""

    texts: DataFrame
    words: DataFrame
    key: str
    schema: T.StructType
    word_buckets: int
    pair_buckets: int
    n: int
    known: int
    paths: tuple[str, str]

    def drop(self) -> None:
        for path in self.paths:
            delete_table(self.texts.sparkSession, path)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _buckets(size: int, each: int) -> int:
    return max(1, -(-size // each))


def code_texts(
    texts: DataFrame, key: str, text: str, corpus: DataFrame | Column | None = None
) -> CodedTexts:
    """Texts and corpus, split into words once for all models.  The corpus is another table, those of
    the texts that a condition picks, or all texts.  For whoever calls it to drop."""
    spark, content = texts.sparkSession, col(text).cast("binary").alias("text")
    fitted = F.lit(corpus is None) if not isinstance(corpus, Column) else F.coalesce(corpus, F.lit(False))
    rows = texts.select(F.col(key).alias("key"), content, F.lit(True).alias("scored"), fitted.alias("fitted"))
    if isinstance(corpus, DataFrame):
        rows = rows.unionByName(corpus.select(
            F.lit(None).cast(rows.schema["key"].dataType).alias("key"), content,
            F.lit(False).alias("scored"), F.lit(True).alias("fitted")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_buckets = _buckets(size, pairs.WORD_BYTES)
    kind = rows.schema["key"].dataType
    schema = T.StructType.fromDDL(pairs.CODED).add("keys", T.ArrayType(kind))
    arrow, numbers = to_arrow_schema(schema), _arrow(pairs.NUMBERED)
    paths = scratch_path(spark, "texts"), scratch_path(spark, "words")
    with dropping_shuffles(spark):
        coded = _stored(rows.mapInArrow(lambda b: pairs.coded(b, word_buckets, arrow), schema), paths[0])
        words = _stored(coded.filter("bucket is not null").select("chunk", "bucket", "words").groupBy(
            "bucket").applyInArrow(lambda t: pairs.numbered(t, numbers), pairs.NUMBERED), paths[1])
    counts = words.agg(F.sum("n"), F.sum("known")).first()
    made = T.StructType().add(key, kind).add("cost", "double").add("n", "long").add("unknown", "long")
    return CodedTexts(
        coded.filter("bucket is null").select("chunk", "codes", "keys"), words.filter("bucket is not null"),
        key, made, word_buckets, _buckets(size, pairs.PAIR_BYTES), counts[0] or 0, counts[1] or 0, paths)


def _arrow(schema: str):
    return to_arrow_schema(T.StructType.fromDDL(schema))


def _per_text(shares: DataFrame, key: str) -> DataFrame:
    return shares.groupBy(key).agg(
        F.when(F.sum("unknown") == 0, F.try_divide(F.sum("cost"), F.sum("n"))).alias("loss"),
        F.sum("n").alias("n_tokens"),
    )


def unigram_losses(
    texts: DataFrame, key: str, text: str, corpus: DataFrame | Column | None = None,
    coded: CodedTexts | None = None,
) -> DataFrame:
    """Mean negative log-likelihood per text under the word counts of ``corpus`` (the texts
    themselves, if it is not given): (key, loss, n_tokens).  A text without words, and every text if
    the corpus has no word, has loss NULL.

    A chunk of texts sends each of its words once to be counted, however often it comes, and gets the
    count back; see ``functions.pairs``.  ``coded`` are the same texts from ``code_texts``, for several
    models of them.
    """
    spark, own = texts.sparkSession, coded or code_texts(texts, key, text, corpus)
    shares, mass, arrow = scratch_path(spark, "shares"), own.n + own.known, to_arrow_schema(own.schema)
    with dropping_shuffles(spark):
        made = _stored(own.texts.groupBy("chunk").cogroup(
            own.words.select("chunk", "bucket", "seen").groupBy("chunk")).applyInArrow(
            lambda docs, told: pairs.word_costs(docs, told, mass, arrow), own.schema), shares)
    if coded is None:
        own.drop()
    return _per_text(made, key)


def unigram_perplexity(texts: DataFrame, text: str, corpus: DataFrame | None = None) -> DataFrame:
    """The weighted perplexity of all texts, from the vocabulary alone: no text is joined."""
    used = words(texts, F.lit(0).alias("_"), text).groupBy("token").agg(
        F.count(F.lit(1)).alias("used")
    )
    counts = spool(_vocabulary(used, corpus, text), "vocabulary")
    mass = counts.agg(_mass().alias("mass")).scalar()
    n = F.sum("used")
    mean = F.try_divide(F.sum(_cost(F.col("seen"), mass) * F.col("used")), n)
    return counts.agg(n.alias("n_tokens"), mean.alias("mean_loss")).withColumn(
        "perplexity", F.exp("mean_loss")
    )


def weighted_perplexity(losses: DataFrame) -> DataFrame:
    """exp of the token-weighted mean loss; NULL without tokens."""
    n = F.sum("n_tokens")
    mean = F.when(n > 0, F.sum(F.col("loss") * F.col("n_tokens")) / F.when(n != 0, n))
    return losses.agg(
        n.alias("n_tokens"), mean.alias("mean_loss"), F.exp(mean).alias("perplexity")
    )


def batch_perplexity(losses: DataFrame) -> DataFrame:
    """exp of the plain mean of batch losses; NULL without batches."""
    mean = F.avg("loss")
    return losses.agg(
        F.count("loss").alias("batches"), mean.alias("mean_loss"), F.exp(mean).alias("perplexity")
    )


def batch_losses(numbered: DataFrame, rows: int) -> DataFrame:
    """Token-weighted loss of each batch of consecutive rows (``row_no`` from 1)."""
    batch = F.floor((F.col("row_no") - 1) / rows)
    return numbered.groupBy(batch.alias("batch_id")).agg(
        F.try_divide(F.sum(F.col("loss") * F.col("n_tokens")), F.sum("n_tokens")).alias("loss"),
        F.sum("n_tokens").alias("n_tokens"),
    )


def eval_prompts(cases: DataFrame, system: bool = False) -> DataFrame:
    return cases.withColumn("prompt", prompt("instruction", system=system))


def expected_hits(answers: DataFrame, answer: str, expected: str) -> DataFrame:
    """How many of the expected strings occur in the answer, and whether all do."""
    hits = F.size(F.filter(expected, lambda wanted: F.contains(F.col(answer), wanted)))
    return answers.withColumn("hits", hits).withColumn("wanted", F.size(expected)).withColumn(
        "passed", F.col("hits") == F.col("wanted")
    )


def pass_rate(checked: DataFrame, *by: str) -> DataFrame:
    return checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"),
        F.sum("hits").alias("hits"), F.sum("wanted").alias("wanted"),
    )


# ---------------------------------------------------------------- bigrams

# Used if the corpus has no bigram that occurs once, or none that occurs twice.
DISCOUNT = 0.75


def pair_counts(coded: CodedTexts) -> DataFrame:
    """How often the corpus has the pairs of each chunk; for the words, how many kinds of pairs they
    begin and end; and how many kinds come at all, once and twice."""
    words, buckets = coded.word_buckets, coded.pair_buckets
    sent, counted = "chunk long, bucket int, pairs binary", _arrow(pairs.COUNTED)
    arrow = _arrow(sent)
    return coded.texts.groupBy("chunk").cogroup(
        coded.words.select("chunk", "bucket", "place").groupBy("chunk")).applyInArrow(
        lambda docs, told: pairs.sent_pairs(docs, told, words, buckets, arrow), sent).groupBy(
        "bucket").applyInArrow(lambda t: pairs.counted_pairs(t, words, counted), pairs.COUNTED)


def bigram_model(counted: DataFrame) -> tuple[int, float]:
    """Distinct pairs and the discount."""
    kinds, once, twice = (n or 0 for n in counted.agg(F.sum("kinds"), F.sum("once"), F.sum("twice")).first())
    return kinds, once / (once + 2 * twice) if once and twice else DISCOUNT


def bigram_costs(coded: CodedTexts, counted: DataFrame) -> DataFrame:
    """(key, cost, n, unknown) of the texts: the negative log-likelihood of their words after the ones
    before."""
    words, buckets, known = coded.word_buckets, coded.pair_buckets, coded.known
    kinds, discount = bigram_model(counted)
    stats, arrow = _arrow(pairs.STATS), to_arrow_schema(coded.schema)
    told = coded.words.select("chunk", "bucket", "place").groupBy("bucket").cogroup(
        counted.filter("word_bucket is not null").select("word_bucket", "stats").groupBy("word_bucket")
    ).applyInArrow(lambda own, parts: pairs.told_stats(own, parts, stats), pairs.STATS)
    answers = coded.words.select("chunk", "bucket", "place", "total").unionByName(
        counted.filter("bucket is not null").select("chunk", "bucket", "seen"), allowMissingColumns=True
    ).unionByName(told, allowMissingColumns=True)
    return coded.texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda docs, given: pairs.pair_costs(docs, given, words, buckets, kinds, known, discount, arrow),
        coded.schema)


def bigram_losses(
    texts: DataFrame, key: str, text: str, corpus: DataFrame | Column | None = None,
    coded: CodedTexts | None = None,
) -> DataFrame:
    """Mean negative log-likelihood per text under interpolated Kneser-Ney bigrams of ``corpus`` (the
    texts themselves, if it is not given): (key, loss, n_tokens).  A text without words, and every
    text if the corpus has no word, has loss NULL.

    Most pairs of a corpus are rare, so the pairs of all texts, shuffled as words, would take many
    times the room of the texts.  They travel as numbers, each once per chunk of texts; see
    ``functions.pairs``.  ``coded`` as for ``unigram_losses``.
    """
    spark, own = texts.sparkSession, coded or code_texts(texts, key, text, corpus)
    shares = scratch_path(spark, "shares")
    with dropping_shuffles(spark), handovers(spark):
        counted = _stored(pair_counts(own), scratch_path(spark, "pairs"))
        made = _stored(bigram_costs(own, counted), shares)
    if coded is None:
        own.drop()
    return _per_text(made, key)
