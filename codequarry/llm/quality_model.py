"""A regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a covariance, shrunk towards its diagonal and towards the pooled
covariance. A score is the squashed difference of the two log densities, each a Mahalanobis
distance through a Cholesky factor that is worked out once. Moments come from sums over all
labelled rows; only those sums reach the driver.

Null texts are empty, and have a score like any text; whole texts count, however long. Every row has
its own score, also if its id is null or repeated; a label belongs to all rows of its id. Without
rows of both labels every score is the share of label 1, or 0.5 without labels. An empty table gives
no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.shared import stage, text_rows
from codequarry.llm.textstats import DIGIT, STOP, TextStats

FEATURES = ("word_length", "capitals", "symbols", "loud", "stops", "digits", "stutters")
#: Words that every text is taken to have besides its own, so that short texts give weak evidence.
PRIOR_WORDS = 5
#: Parts of the covariance taken from the pooled covariance and from the diagonal; variance floor.
POOLED, DIAGONAL, FLOOR = 0.1, 0.2, 1e-3


def features(text: str | None) -> list[float]:
    """Statistics of one text; shares by square root, lengths by logarithm."""
    s = TextStats(text)
    words = s.n_words + PRIOR_WORDS
    letters = s.n_upper + s.n_lower + 5 * PRIOR_WORDS
    share = [s.n_upper / letters, s.n_symbols / words, s.n_loud / words, s.share(STOP) / words,
             s.share(DIGIT) / (len(s.data) + 5 * PRIOR_WORDS), s.n_stutters / words]
    return [float(np.log((s.word_chars + 5 * PRIOR_WORDS) / words)), *(float(x ** 0.5) for x in share)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["id", "body", "x"])


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged (id, body, x); body is xxhash64 of the text."""
    texts = text_rows(docs, id_col, text_col).withColumn("body", F.xxhash64("text"))
    return stage(texts.mapInArrow(_features, "id long, body long, x array<double>"))


class Discriminant:
    """Log density difference of two Gaussians."""

    def __init__(self, count: np.ndarray, mean: np.ndarray, cov: np.ndarray):
        self.share = float(count[1] / count.sum()) if count.sum() else 0.5
        self.mean, self.roots, self.shift = mean, [], 0.0
        if not (count > 0).all():
            return
        pooled = (count[0] * cov[0] + count[1] * cov[1]) / count.sum()
        for c in (0, 1):
            mixed = (1 - POOLED) * cov[c] + POOLED * pooled
            mixed = (1 - DIAGONAL) * mixed + DIAGONAL * np.diag(np.diag(mixed))
            lower = np.linalg.cholesky(mixed + FLOOR * np.eye(len(mixed)))
            self.roots.append(np.linalg.inv(lower))
            self.shift += (1 if c else -1) * (np.log(count[c]) - np.log(np.diag(lower)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, at least 0.5 where label 1 is as likely; log odds are taken per feature."""
        if not self.roots:
            return np.full(len(x), self.share)
        away = [(((x - m) @ r.T) ** 2).sum(axis=1) for m, r in zip(self.mean, self.roots)]
        odds = (self.shift + (away[0] - away[1]) / 2) / len(FEATURES)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def train(labelled: DataFrame) -> Discriminant:
    """Fits rows (x, label), label 0 or 1, by sums per label and task."""
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = (labelled.where("label in (0, 1)").groupBy("label").agg(
        F.count("*").alias("n"), *(F.sum(F.col("x")[i]) for i in range(p)),
        *(F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs)).collect())
    count, mean, cov = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
    for row in rows:
        c, n = row[0], row[1]
        count[c], mean[c] = n, np.array(row[2:2 + p]) / n
        for (i, j), s in zip(pairs, row[2 + p:]):
            cov[c, i, j] = cov[c, j, i] = s / n - mean[c, i] * mean[c, j]
    return Discriminant(count, mean, cov)


def _scores(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(model.score(x), pa.float64())], ["id", "body", "score"])
    return run


def training_fold(doc_id: Column) -> Column:
    """The rows labels may be learnt from; the other third is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 != 1


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, body, held_out, score, predicted) per row; body is xxhash64 of the text, which with the id
    tells rows apart. Labels of the held-out third are never read."""
    found = document_features(docs, id_col, text_col)
    marks = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
             .where(training_fold(F.col("id"))))
    model = train(found.join(marks, "id"))
    return (found.mapInArrow(_scores(model), "id long, body long, score double")
            .select("id", "body", (~training_fold(F.col("id"))).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")))
