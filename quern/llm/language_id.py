"""Language identification by unigrams over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  The probability of
a text under a language is the sum over all its segmentations into pieces, computed by the forward
algorithm; no best segmentation is chosen.  Segments of the text are independent (no piece spans
two of them), so the log probability of a text is a sum over its segments, whose values are kept
in a bounded memo.

Learning counts pieces in a bounded sample of labelled documents: about ``sample_per_language`` of
each language, chosen by a hash of the id; a language with fewer gives all it has.  The
counts are those of the library's segmentation, smoothed by
adding ``smoothing``.  Scoring reads every document whole.

Cases: a text that is NULL or has no letter gets ``und`` and score 0; without any labelled
document every text does; documents with NULL language are never learned from; equal scores go to
the language that sorts first; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import LONG_KEY, tokenizer_path
from quern.llm.pieces import MARK, PieceFinder, segments_of, vocabulary

UNDETERMINED = "und"
MEMO = 400_000


# ---------------------------------------------------------------- learning


def sample_labelled(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int
) -> DataFrame:
    """About ``per_language`` documents of each language, the same ones in every run."""
    sizes = docs.groupBy(F.col(lang_col).alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30))
    chosen = docs.select(F.col(id_col), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # One row per language: far less than the learned table, which the driver holds anyway.
    return chosen.join(F.broadcast(sizes), F.col("lang") == F.col("name")).filter(
        place < F.lit(float(per_language << 30)) / F.col("rows")
    ).select("text", "lang")


def piece_counts(sample: DataFrame, text_col: str, lang_col: str, path: str) -> DataFrame:
    """(lang, piece, n): map-side counts first, so little is shuffled."""
    def run(batches):
        counts: dict[str, Counter] = defaultdict(Counter)
        model = vocabulary(path).model
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for text, lang in zip(texts, langs, strict=True):
                counts[lang].update(model.encode(text, num_threads=1))
        for lang, found in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found.keys(), pa.int32()),
                 pa.array(found.values(), pa.int64())], names=["lang", "piece", "n"],
            )

    counted = sample.select(text_col, lang_col).mapInArrow(run, "lang string, piece int, n long")
    return counted.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def learn(
    docs: DataFrame, path: str, sample_per_language: int = 2000, smoothing: float = 0.1,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and a (piece, language) table of log probabilities.

    It is bounded by the number of languages times the size of the vocabulary.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = sample_labelled(labelled, id_col, text_col, lang_col, sample_per_language)
    counted = piece_counts(sample, "text", "lang", path).toPandas()
    languages = sorted(set(counted["lang"]))
    counts = np.full((vocabulary(path).size, len(languages)), smoothing)
    column = {lang: i for i, lang in enumerate(languages)}
    np.add.at(counts, (counted["piece"], counted["lang"].map(column)), counted["n"])
    return languages, np.log(counts / counts.sum(axis=0)) if languages else counts


# ---------------------------------------------------------------- scoring

# A language whose share of the forward value has vanished in double precision.
LEAST = -700.0


class PieceProbabilities:
    def __init__(self, path: str, logs: np.ndarray):
        self.words, self.logs = vocabulary(path), logs
        self.finder = PieceFinder(self.words)
        # One more row for "no piece", whose probability is zero.
        self.probs = np.vstack([np.exp(logs), np.zeros(logs.shape[1])])
        self.none = len(logs)

    def score(self, strings: list[str]) -> np.ndarray:
        """Log of each string's probability, summed over its segmentations, per language.  The
        strings have one length, and all advance together, one end position at a time."""
        codes, found = self.finder.find(strings)
        count, size = codes.shape
        table, n_langs = self.probs, self.logs.shape[1]
        strange = found[1] == self.none
        if strange.any():  # characters without a piece are spelled in bytes
            chars, place = np.unique(codes[strange], return_inverse=True)
            spelled = [self.logs[self.words.unknown_ids(chr(c))].sum(axis=0) for c in chars]
            table = np.vstack([table, np.exp(spelled)])
            found[1][strange] = len(self.probs) + place
        used = {length: (ids != self.none).any(axis=0) for length, ids in found.items()}
        forward = np.zeros((size + 1, count, n_langs))
        forward[0] = 1.0
        scale = np.zeros((count, 1))
        for end in range(1, size + 1):
            here = forward[end]
            for length, ids in found.items():
                start = end - length
                if start >= 0 and used[length][start]:
                    here += forward[start] * table[ids[:, start]]
            top = here.max(axis=1, keepdims=True)
            forward[max(0, end - self.words.longest):end + 1] /= top  # no underflow
            scale += np.log(top)
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(forward[size]), LEAST) + scale


class Scorer:
    def __init__(self, path: str, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs
        if languages:
            self.table, self.atoms = PieceProbabilities(path, logs), vocabulary(path).atoms
        self.forget()

    def forget(self) -> None:
        self.row_of: dict[str, int] = {}
        self.filled, self.rows = 0, np.zeros((1024, len(self.languages)))
        self.atom_of: dict[str, np.ndarray] = {}

    def learn_segments(self, segments: list[str]) -> None:
        """Puts the scores of new segments into the memo.  A segment is cut into atoms, whose
        scores are summed."""
        cut = [self.atoms(segment) for segment in segments]
        by_length: dict[int, list[str]] = defaultdict(list)
        for atom in {atom for atoms in cut for atom in atoms if atom not in self.atom_of}:
            by_length[len(atom)].append(atom)
        for size, strings in by_length.items():
            step = max(1, 400_000 // size)
            for start in range(0, len(strings), step):
                part = strings[start:start + step]
                self.atom_of.update(zip(part, self.table.score(part), strict=True))
        sizes = np.array([len(atoms) for atoms in cut])
        values = np.array([self.atom_of[atom] for atoms in cut for atom in atoms])
        made = np.add.reduceat(values, np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
        first, self.filled = self.filled, self.filled + len(segments)
        while len(self.rows) < first + len(segments):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[first:first + len(segments)] = made
        self.row_of.update(zip(segments, range(first, first + len(segments)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        parts = [self.parts(text) for text in texts] if self.languages else []
        chosen = [i for i, found in enumerate(parts) if found]
        if not chosen:
            return langs, scores
        missing = {s for i in chosen for s in parts[i] if s not in self.row_of}
        if missing:
            self.learn_segments(list(missing))
        rows = [row for i in chosen for row in map(self.row_of.__getitem__, parts[i])]
        heads = np.r_[0, np.cumsum([len(parts[i]) for i in chosen])[:-1]]
        totals = np.add.reduceat(self.rows[rows], heads, axis=0)
        best = totals.argmax(axis=1)
        top = totals[np.arange(len(best)), best][:, None]
        shares = 1.0 / np.exp(totals - top).sum(axis=1)
        for i, language, share in zip(chosen, best.tolist(), shares.tolist(), strict=True):
            langs[i], scores[i] = self.languages[language], share
        for segment in missing:
            if len(segment) > LONG_KEY:  # long strings are not kept
                del self.row_of[segment]
                for atom in self.atoms(segment):
                    self.atom_of.pop(atom, None)
        if self.filled > MEMO:
            self.forget()
        return langs, scores

    @staticmethod
    def parts(text: str | None) -> list[str]:
        """Segments of a text with a letter.  Lines are cut too: no piece holds a line end."""
        if text is None or not any(map(str.isalpha, text)):
            return []
        return [s for line in text.split("\n") for s in segments_of(line) if s != MARK]


@lru_cache(maxsize=1)
def _scorer(path: str, token: str, model) -> Scorer:
    return Scorer(path, *model.value)


class _Shared:
    """A broadcast model that a worker loads once."""

    def __init__(self, value):
        self.value = value

    def __hash__(self):
        return 0

    def __eq__(self, other):
        return True


def predict_language(
    docs: DataFrame, languages: list[str], logs: np.ndarray, path: str,
    id_col: str = "doc_id", text_col: str = "text", extra: tuple[Column, ...] = (),
) -> DataFrame:
    """Per document: its id, the ``extra`` columns, ``lang_pred`` and ``score``.

    ``score`` is the posterior of the language under equal priors.
    """
    from uuid import uuid4

    model = docs.sparkSession.sparkContext.broadcast((languages, logs))
    token = uuid4().hex

    def run(batches):
        scorer = _scorer(path, token, _Shared(model.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                langs, scores = scorer.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[*part.schema.names[:-1], "lang_pred", "score"],
                )

    chosen = docs.select(F.col(id_col), *extra, F.col(text_col).alias("_text"))
    kept = chosen.drop("_text").schema
    return chosen.mapInArrow(run, kept.add("lang_pred", "string").add("score", "double"))


def held_out(id_col: str) -> Column:
    """A NULL id is not held out, and nothing is learned from its row (see ``language_predictions``)."""
    hashed = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    return F.coalesce(hashed, F.lit(False)).alias("held_out")


def language_predictions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    vocabulary_file: str = "piece_bpe_32k.model", sample_per_language: int = 2000,
) -> DataFrame:
    """Learn from the documents that are not held out, predict every document."""
    path = tokenizer_path(vocabulary_file)
    languages, logs = learn(
        docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)), path, sample_per_language,
        id_col=id_col, text_col=text_col, lang_col=lang_col,
    )
    return predict_language(docs, languages, logs, path, id_col, text_col, (held_out(id_col),))
