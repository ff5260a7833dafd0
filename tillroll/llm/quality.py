"""Quality scores learned from preference pairs (Bradley-Terry).

A document's strength is a weighted sum of a few properties of its text; of two documents
the stronger one is preferred with the logistic probability of their difference. The
weights are fitted on pairs of a good and a bad labelled document by logistic loss on the
difference of their properties. The threshold is the quantile of the labelled documents'
strengths that leaves the labelled share of bad documents below it; scores are moved so
that this strength becomes ``CUT``.

``SAMPLE`` bounds the labelled rows of each class that the weights are fitted on (those
with the smallest hash of their id). Centre, spread and threshold are those of all labelled
rows, by exact sums and an exact quantile; the properties of the documents that may be
labelled are written once as numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.words import SPACE, group_sums, pieces, words
from tillroll.operators.statistics import quantiles
from tillroll.staging import stage

CUT = 0.3
SAMPLE = 10_000
PAIRS = 8  # of bad documents for each good one, and the other way round
RIDGE = 1e-2

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, dtype=bool)  # usual punctuation
_MARK[[ord(c) for c in ".,;:'\"-?()"]] = True
_SYMBOL = ~(_LETTER | _DIGIT | _MARK | SPACE)

FEATURES = (
    "upper_share",
    "digit_share",
    "mark_share",
    "symbol_share",
    "word_length",
    "short_words",
    "long_words",
    "no_letter_words",
    "upper_words",
    "symbol_words",
    "same_as_last",
    "same_as_one_before",
    "distinct_words",
    "words_in_a_line",
    "log_words",
)


def text_features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; a text without words has zeros."""
    found = words(column)
    raw, first = found.raw, found.first
    n = np.maximum(found.counts, 1).astype(float)
    starts, ends = found.starts, found.ends

    def inside(mask: np.ndarray) -> np.ndarray:
        """How many bytes of each word are in the mask."""
        upto = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(mask[raw], out=upto[1:])
        return upto[ends] - upto[starts]

    length = ends - starts
    upper, letter, symbol = inside(_UPPER), inside(_LETTER), inside(_SYMBOL)
    total = np.maximum(group_sums(length, first), 1).astype(float)
    ids = found.hashes()
    text_of = found.text_of()

    def same(lag: int) -> np.ndarray:
        out = np.zeros(len(ids), dtype=bool)
        out[lag:] = (ids[lag:] == ids[:-lag]) & (text_of[lag:] == text_of[:-lag])
        return group_sums(out, first)

    order = np.lexsort((ids, text_of))
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (text_of[order][1:] != text_of[order][:-1])
    lines = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(raw == 10, out=lines[1:])
    word_line = lines[starts]
    new_line = np.ones(len(ids), dtype=bool)
    new_line[1:] = (word_line[1:] != word_line[:-1]) | (text_of[1:] != text_of[:-1])
    rows = [
        group_sums(upper, first) / np.maximum(group_sums(letter, first), 1),
        group_sums(inside(_DIGIT), first) / total,
        group_sums(inside(_MARK), first) / total,
        group_sums(symbol, first) / total,
        group_sums(length, first) / n / 10,
        group_sums(length <= 3, first) / n,
        group_sums(length >= 16, first) / n,
        group_sums(letter == 0, first) / n,
        group_sums((upper == letter) & (letter >= 2), first) / n,
        group_sums(symbol > 0, first) / n,
        same(1) / n,
        same(2) / n,
        group_sums(new, first) / n,
        np.log1p(found.counts / np.maximum(group_sums(new_line, first), 1)) / 5,
        np.log1p(found.counts) / 10,
    ]
    return np.stack(rows, axis=1)


def _fit_weights(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Weights by Newton steps on the logistic loss of feature differences."""
    rng = np.random.default_rng(8)
    n = max(len(good), len(bad))
    pairs = []
    for _ in range(PAIRS):
        a = np.resize(rng.permutation(len(good)), n)
        b = np.resize(rng.permutation(len(bad)), n)
        pairs.append(good[a] - bad[b])
    d = np.concatenate(pairs)
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        slope = RIDGE * w - d.T @ p / len(d)
        bend = RIDGE * np.eye(len(w)) + (d * (p * (1 - p))[:, None]).T @ d / len(d)
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


class QualityModel:
    """Centre and spread of the features, weights, and the strength at which ``CUT`` lies."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray, threshold: float):
        self.centre, self.spread, self.weights, self.threshold = centre, spread, weights, threshold

    def strengths(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.centre) / self.spread, -8, 8) @ self.weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        moved = self.strengths(features) - self.threshold + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(moved, -500, 500)))


def _remainder(id_col: str, divisor: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    sample: int = SAMPLE,
) -> QualityModel:
    """Learn from the labelled documents whose crc32(id as text) leaves a remainder by ``folds``.

    Null labels and ids are left out; an id with more than one label counts as the majority
    says, and not at all if it is even. Without labels of both kinds every strength is
    equal and every document scores 0.5.
    """
    votes = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .where(_remainder("id", folds) != 0)
        .groupBy("id")
        .agg(F.avg("label").alias("share"))
        .where("share != 0.5")
        .select("id", (F.col("share") > 0.5).alias("good"))
    )
    none = QualityModel(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), -0.5)
    none.threshold = math.log(CUT / (1 - CUT))  # a score of one half
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(
        F.col("id").isNotNull() & (_remainder("id", folds) != 0)
    )

    def scan(batches):
        for part in pieces(batches):
            rows = text_features(part.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), flat.cast(pa.list_(pa.float64()))], names=["id", "features"]
            )

    # Texts stay where they are read; only their properties meet the labels.
    seen = texts.mapInArrow(scan, "id long, features array<double>").join(votes, "id")
    # One row of an id, should documents repeat it.
    table = stage(seen.groupBy("id").agg(F.first("good").alias("good"), F.min("features").alias("features")), "labelled")
    # Decimal sums do not depend on the order of the rows.
    values = [F.col("features")[k] for k in range(len(FEATURES))]
    sums = [F.sum(v.cast("decimal(28,12)")) for x in values for v in (x, x * x)]
    n, good, *moments = table.agg(F.count(F.lit(1)), F.count(F.when(F.col("good"), 1)), *sums).first()
    if not 0 < good < n:
        return none
    first, second = (np.array([float(m) / n for m in moments[k::2]]) for k in range(2))
    centre, spread = first, np.sqrt(np.maximum(second - first**2, 0)) + 1e-6
    order = [F.xxhash64("id"), F.col("id")]
    chosen = table.where("good").orderBy(*order).limit(sample).union(
        table.where(~F.col("good")).orderBy(*order).limit(sample)
    )
    found = chosen.orderBy("id").toPandas()
    x = np.array(found["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    y = found["good"].to_numpy(dtype=bool)
    model = QualityModel(centre, spread, np.zeros(x.shape[1]), 0.0)
    scaled = np.clip((x - centre) / spread, -8, 8)
    model.weights = _fit_weights(scaled[y], scaled[~y])

    def strong(batches):
        for batch in batches:
            features = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(model.strengths(features))], names=["strength"])

    strengths = stage(table.select("features").mapInArrow(strong, "strength double"), "strengths")
    # Half-way between the last of as many strengths as there are bad documents and the next one.
    at = (n - good - 0.5) / (n - 1)
    model.threshold = float(quantiles(strengths, {"strength": [at]})["strength", at])
    return model


def quality_scores(
    docs: DataFrame,
    model: QualityModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
) -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1: good).

    Null texts count as empty and are scored; a null id is never held out. Repeated rows give
    repeated results; no other column is read.
    """

    def scan(batches):
        for part in pieces(batches):
            scores = model.scores(text_features(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores)], names=["id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(scan, "id long, score double")
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce(_remainder("id", folds) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``CUT``."""
    at = docs.columns.index(text_col)

    def scan(batches):
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in pieces([named], f"c{at}"):
                good = model.scores(text_features(part.column(at))) >= CUT
                yield part.filter(pa.array(good))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(scan, plain.schema).toDF(*docs.columns)
