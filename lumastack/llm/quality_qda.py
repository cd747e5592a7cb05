"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each text gives a short vector of statistics (counts as logarithms, shares as arc sines of their roots). Each class has a
normal density whose covariance is shrunk twice: towards the pooled covariance of both classes, and towards a multiple of
the identity. A score is the logistic of the difference of the log densities plus the log prior odds; densities use the
Mahalanobis distance by a Cholesky factor that is computed once. All labelled training rows count: their sums and sums of
products are aggregated by Spark, and only these few numbers reach the driver.

Cases: a null or empty text has the vector of zeros and a score as any other; a text of any length has one vector, made in a
slice of its own; equal vectors have equal scores, and a score of exactly the threshold is 1; without training rows of both classes every
score is the share of class 1 (0.5 without any); labels with a null doc_id or a label other than 0 or 1 are not used; a
doc_id that is repeated gives a row each, and each counts with each of its labels; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .textops import mix64, span_hashes, text_slices, word_spans

NAMES = ["words", "word_length", "symbols", "capitals", "digits", "marked_words", "bare_words", "echoes", "repeats", "spaces", "line_words"]
POOL, RIDGE, FLOOR = 0.1, 0.05, 1e-4
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*!|<>{}[]=+~^_@\\/")] = True
_ALNUM = _UPPER | _LOWER | _DIGIT
_ALNUM[128:] = True


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Vectors of the texts given end to end."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(offsets, data)
    size, words = np.diff(offsets).astype(float), np.bincount(rows, minlength=n).astype(float)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    of_words = lambda flags: np.bincount(rows, weights=flags, minlength=n)
    upper, lower = count(_UPPER[data]), count(_LOWER[data])
    h = span_hashes(data, starts, ends)
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    pair = np.zeros(len(h), np.uint64)
    pair[1:] = mix64(h[1:] + mix64(h[:-1] + np.uint64(1)))
    inner = np.zeros(len(h), bool)
    inner[1:] = rows[1:] == rows[:-1]
    key, of = pair[inner], rows[inner]
    order = np.lexsort((key, of))
    again = np.zeros(len(key), bool)
    again[1:] = (key[order][1:] == key[order][:-1]) & (of[order][1:] == of[order][:-1])
    repeats = np.bincount(of[order], weights=again, minlength=n) if len(key) else np.zeros(n)
    marked = _SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    alnum = np.concatenate(([0], np.cumsum(_ALNUM[data])))
    bare = alnum[ends] == alnum[starts]
    lines = count(data == 10) + 1
    return np.column_stack(
        [
            np.log1p(words), np.log1p(of_words(ends - starts) / np.maximum(words, 1)), _share(count(_SYMBOL[data]), size), _share(upper, upper + lower),
            _share(count(_DIGIT[data]), size), _share(of_words(marked), words), _share(of_words(bare), words), _share(of_words(echo), words),
            _share(repeats, np.maximum(words - 1, 0)), _share(size - of_words(ends - starts), size), np.log1p(words / lines),
        ]
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, offsets, data in text_slices(batch.column("text")):
            x = statistics(offsets, data)
            rest = [batch.column(i).slice(row, len(x)) for i, c in enumerate(batch.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c) for c in x.T)], [*(c for c in batch.schema.names if c != "text"), *NAMES])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics...) of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{c} double" for c in NAMES))


@dataclass
class Model:
    prior: float
    means: np.ndarray | None = None  # class x dimension
    factors: np.ndarray | None = None  # inverses of the Cholesky factors
    logdets: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        odds = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(labelled: DataFrame, *, pool: float = POOL, ridge: float = RIDGE) -> Model:
    """The model of rows (label 0 or 1, statistics...)."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(NAMES)), *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i, j in pairs))
    found = {r["label"]: r for r in sums.collect()}
    n = np.array([found[k]["n"] if k in found else 0 for k in (0, 1)], float)
    if n.min() < 2:
        return Model(float(n[1] / n.sum()) if n.sum() else 0.5)
    means, scatter = np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        means[k] = [found[k][f"s{i}"] / n[k] for i in range(d)]
        for i, j in pairs:
            scatter[k, i, j] = scatter[k, j, i] = found[k][f"p{i}_{j}"] - n[k] * means[k, i] * means[k, j]
    pooled = scatter.sum(axis=0) / n.sum()
    factors, logdets = [], []
    for k in (0, 1):
        cov = (1 - pool) * scatter[k] / n[k] + pool * pooled
        cov = (1 - ridge) * cov + (ridge * np.trace(cov) / d + FLOOR) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * np.log(np.diag(lower)).sum())
    return Model(float(n[1] / n.sum()), means, np.array(factors), np.array(logdets))


def _scored(model: Model) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in NAMES]) if batch.num_rows else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(model.score(x), 9))], ["doc_id", "score"])

    return task


def _accepted(model: Model, threshold: float) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, data in text_slices(batch.column("text")):
                good = np.round(model.score(statistics(offsets, data)), 9) >= threshold
                yield batch.slice(row, len(good)).filter(pa.array(good))

    return task


def accepted(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, as they are."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_accepted(model, threshold), schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that no fit may use: crc32 of the id as text is divisible by 5 (null ids too)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on all of ``labels`` (doc_id, quality) that are not held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    return fit(stats.join(usable, "doc_id"))


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; ``predicted`` is 1 from ``threshold`` on."""
    stats = stored(measured(docs))
    scores = stats.mapInArrow(_scored(train(stats, labels)), "doc_id long, score double")
    return scores.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
