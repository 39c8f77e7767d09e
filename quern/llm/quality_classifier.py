"""Document quality as ordinal regression on graded ratings.

A rating is a grade 0, 1, .. K-1.  The cumulative-link model gives every document one score, a sum of
weights of hashed text features that all grades share, and ordered thresholds between the grades:
``P(grade <= k) = logistic(threshold[k] - score)``.  From these follow the expected grade and the
tail probability ``P(grade >= keep)``, by which documents are selected.

Features are each distinct word of the whole text, without case and outer marks, its first three and
four letters, the runs of two and three characters within long words and in scripts that put no blanks
between words, and a few shares (capitals, repeated neighbours, words with symbols, table bars) in
steps, each hashed to one of ``BUCKETS`` weights.  Beginnings of words stand in for all forms of a
word, whole words tell those apart that begin alike, and runs reach all of a text without blanks.
They count by presence, divided by the fourth root of their number, so long texts neither drown a
telling word nor pile up chance; shares count fully.

Ratings here: the grades of ``labels`` are 0 (toxic), 1 (poor quality), 2 (good).  Toxic is the lowest,
so that any number of toxic words can pull a text down.

The model is fitted in the driver on a bounded sample: about ``sample_rows`` rated documents, chosen
by a hash of the id.  Only their feature hashes are collected, and only features of at least
``LEAST_DOCUMENTS`` of them get a weight.  Every document is scored whole.

Cases: texts that are NULL or hold no word get expected grade 0, probability 0 and are not kept;
ratings with NULLs or of unknown documents are not used, and of several for one document the smallest
grade counts; of several rows of one rated id one text is used for fitting; without ratings every text with words is kept; repeated rows give repeated rows; other
columns are ignored, or kept if whole documents are asked for.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quern.llm.common import Memo

BUCKETS = 1 << 18
GRADES = 3
LEAST = 0.6
SAMPLE_ROWS = 12_000
ROUNDS = 200
RATE = 0.1
PENALTY = 1e-4
STEPS = 10
PREFIXES = (3, 4)
LONG = 16
GRAMS = (2, 3)
SHARES = 6
LEAST_DOCUMENTS = 10
OUTER = ".,;:!?\"'()[]{}<>*#$%&|~^_=+-/\\`"


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


# Thai to Burmese, Khmer, kana, Chinese characters and their extensions.
_UNSPACED = re.compile(
    "[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]"
)

_prefix_bucket = Memo(lambda prefix: _bucket("p:" + prefix), 100_000)


def _word_buckets(word: str) -> tuple[int, ...]:
    plain = word.strip(OUTER).lower()
    return (_bucket("w:" + plain), *(_prefix_bucket[plain[:size]] for size in PREFIXES))


_of_word = Memo(_word_buckets, 250_000)
_gram_bucket = Memo(lambda gram: _bucket("g:" + gram), 100_000)


def _gram_buckets(word: str) -> Iterator[int]:
    """Runs of characters of a long word, or of one in a script without blanks; else none."""
    plain = word.strip(OUTER).lower()
    if len(plain) > LONG or _UNSPACED.search(plain):
        for size in GRAMS:
            yield from (_gram_bucket[gram] for gram in {
                plain[i:i + size] for i in range(len(plain) - size + 1)
            })


@lru_cache(maxsize=4096)
def _share(name: str, step: int) -> int:
    return _bucket(f"s:{name}:{step}")


def features(text: str | None) -> list[int]:
    """The buckets of a text's features; none if it has no word."""
    words = (text or "").split()
    if not words:
        return []
    total = len(words)
    # Distinct words first: capitals and marks are properties of a spelling.
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    capitals = symbols = bars = 0
    for word, count in counts.items():
        if word.isupper():
            capitals += count
        if not word[-1].isalnum() and word[-1] not in ".,;:?":
            symbols += count
            if word == "|":
                bars += count
    repeats = sum(map(str.__eq__, words, words[1:]))
    shares = {
        "capitals": capitals, "symbols": symbols, "bars": bars, "repeats": repeats,
        "distinct": len(counts),
    }
    steps = [
        _share(name, math.ceil(STEPS * value / total)) for name, value in shares.items()
    ]
    steps.append(_share("words", min(12, total.bit_length())))
    found = set(chain.from_iterable(map(_of_word.__getitem__, counts)))
    for word in counts:
        if len(word) > LONG or not word.isascii():
            found.update(_gram_buckets(word))
    return [*found, *steps]


def values_of(sizes: np.ndarray) -> np.ndarray:
    """What each feature counts, document by document; the shares come last and count fully."""
    values = np.repeat(sizes**-0.25, sizes)
    ends = np.cumsum(sizes)
    for back in range(1, SHARES + 1):
        values[ends - back] = 1.0
    return values


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, found: list[list[int]]) -> np.ndarray:
        """P(grade >= k) for k = 1, .. K-1, a row per document."""
        sizes = np.array([len(f) for f in found])
        flat = np.array([i for f in found for i in f], np.int64)
        heads = np.r_[0, np.cumsum(sizes)[:-1]]
        score = np.add.reduceat(self.weights[flat] * values_of(sizes), heads)
        return _logistic(score[:, None] - self.thresholds)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(
    flat: np.ndarray, sizes: np.ndarray, grade: np.ndarray, n_grades: int = GRADES,
    rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY,
    least_documents: int = LEAST_DOCUMENTS,
) -> Model:
    """Maximum likelihood by Adam.  ``flat`` holds the features of all documents in a row."""
    value = values_of(sizes)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    held = np.bincount(flat, minlength=BUCKETS)
    common = (held > 0) & (held >= least_documents)  # rarer features keep weight 0
    used, renamed = np.flatnonzero(common), np.cumsum(common) - 1
    kept = common[flat]
    place, rows, value = renamed[flat[kept]], rows[kept], value[kept]
    # Thresholds are a first one and the logarithms of the gaps, so they stay ordered.
    at_most = [np.clip((grade <= k).mean(), 1e-3, 1 - 1e-3) for k in range(n_grades - 1)]
    start = np.maximum.accumulate(np.log(at_most) - np.log1p(np.negative(at_most)))
    gaps = np.log(np.maximum(np.diff(start), 0.1))
    params = np.r_[np.zeros(len(used)), start[0], gaps]
    first, second = np.zeros_like(params), np.zeros_like(params)
    n = len(sizes)
    for step in range(1, rounds + 1):
        weights, cuts = params[:len(used)], params[len(used):]
        thresholds = np.cumsum(np.r_[cuts[0], np.exp(cuts[1:])])
        score = np.bincount(rows, weights[place] * value, n)
        below = np.column_stack([np.zeros(n), _logistic(thresholds - score[:, None]), np.ones(n)])
        slope = below * (1 - below)
        row = np.arange(n)
        upper, lower = slope[row, grade + 1], slope[row, grade]
        mass = np.maximum(below[row, grade + 1] - below[row, grade], 1e-12)
        by_score = (upper - lower) / mass / n
        by_weight = np.bincount(place, by_score[rows] * value, len(used)) + penalty * weights
        by_threshold = np.array([
            ((grade == k + 1) * lower - (grade == k) * upper).dot(1 / mass) / n
            for k in range(n_grades - 1)
        ])
        tails = np.cumsum(by_threshold[::-1])[::-1]
        by_cut = np.r_[tails[0], tails[1:] * np.exp(cuts[1:])]
        gradient = np.r_[by_weight, by_cut]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        params = params - rate * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.99**step)) + 1e-8
        )
    weights = np.zeros(BUCKETS)
    weights[used] = params[:len(used)]
    cuts = params[len(used):]
    return Model(weights, np.cumsum(np.r_[cuts[0], np.exp(cuts[1:])]))


# ---------------------------------------------------------------- on tables


def label_grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade) from quality and toxic marks, one row per document."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    known = F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col(id_col).isNotNull()
    return labels.filter(known).groupBy(id_col).agg(F.min(grade).alias("grade"))


def fit_on(
    docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
    text_col: str = "text",
) -> Model | None:
    """The model of (id, grade) ratings; None without rated documents."""
    total = ratings.count()
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("rated")), F.lit(1 << 30))
    sample = ratings.filter(place < int((1 << 30) * min(1.0, sample_rows / max(total, 1))))

    def run(batches):
        for batch in batches:
            found = [features(text) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["found", "grade"]
            )

    # One text per id, however many rows share it.
    rated = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).groupBy(id_col).agg(
        F.max(text_col).alias(text_col), F.first("grade").cast("int").alias("grade")
    ).select(text_col, "grade")
    rows = rated.mapInArrow(run, "found array<int>, grade int").filter(F.size("found") > 0).toArrow()
    if not rows.num_rows:
        return None
    lists = rows.column("found").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return fit(lists.flatten().to_numpy().astype(np.int64), sizes, rows.column("grade").to_numpy())


def quality(
    docs: DataFrame, model: Model | None, keep_grade: int = GRADES - 1, least: float = LEAST,
    id_col: str = "doc_id", text_col: str = "text", whole: bool = False,
) -> DataFrame:
    """Per document ``expected_grade``, ``p_keep`` = P(grade >= keep_grade) and ``keep``.

    ``whole`` returns the kept documents with their own columns instead.
    """
    chosen = docs if whole else docs.select(id_col, text_col)
    at = chosen.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                found = [features(text) for text in part.column(at).to_pylist()]
                expected, tail = np.zeros(len(found)), np.zeros(len(found))
                some = [i for i, f in enumerate(found) if f]
                if some and shared.value is None:
                    expected[some], tail[some] = GRADES - 1, 1.0
                elif some:
                    above = shared.value.grades([found[i] for i in some])
                    expected[some], tail[some] = above.sum(axis=1), above[:, keep_grade - 1]
                if whole:
                    yield part.filter(pa.array(tail >= least))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= least)],
                        names=schema.names,
                    )

    schema = docs.schema if whole else T.StructType([chosen.schema[id_col]]).add(
        "expected_grade", "double").add("p_keep", "double").add("keep", "boolean")
    return chosen.mapInArrow(run, schema)
