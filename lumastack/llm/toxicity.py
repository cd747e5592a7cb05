"""Toxic spans and scores by a linear-chain conditional random field.

Only documents are labelled, so tokens are labelled from them: in a bounded sample of labelled texts (``TRAIN_ROWS``, by the
hash of their ids, one of each group with the same least shingle, so that copies do not vote) the words and affixes are found
that toxic texts hold at least ``RATIO`` times as often as others. Tokens of toxic texts that carry one are labelled toxic;
all tokens of other texts are not. A chain of two tags is trained on windows around them (``WINDOWS`` of ``WINDOW`` tokens),
with the word, its affixes and the word before as hashed features, so it also tags forms that the sample did not hold.

A text is tagged as a whole: forward and backward vectors of all its tokens come from products of 2 x 2 matrices, block by
block in NumPy. The marginals give the spans (runs of tokens that are toxic with 0.5 or more, in code points, end exclusive)
and, by their greatest, their sum and their density, the score: a logistic fitted to the labels of the sample.

Cases: a null or empty text, or one without letters and digits, has no token, and the score of one without toxic tokens;
without labelled texts of both kinds every score is the share of label 1 (0.5 without any), and without a word or affix that
tells them apart no token is toxic; labels with a null doc_id or other than 0 and 1 are not used, of several for one id the
greatest counts; a repeated row gives a row each; equal texts have equal scores, as languages, sources and ids are no input;
an empty table gives an empty result; memory is bounded by slices of texts, a single long text is a slice of its own; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import removed, shared_dir, stored
from .lexical import ENDS
from .textops import LOWER, mix64, shingles, span_hashes, text_slices, word_spans

TRAIN_ROWS, WINDOWS, WINDOW, STEPS, RATIO = 20_000, 6000, 21, 200, 20.0
BUCKETS = 1 << 18
PREFIXES, SUFFIXES = (3, 4, 5, 6, 8), (3, 4, 5)
#: Kinds of features that may label a token: the word itself, and affixes of at least four bytes.
TELLING = [0, *(1 + i for i, n in enumerate(PREFIXES) if n > 3), *(1 + len(PREFIXES) + i for i, n in enumerate(SUFFIXES) if n > 3)]
WIDTH = 2 + len(PREFIXES) + len(SUFFIXES)
SPANS = "array<struct<start:long,end:long>>"


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    first: np.ndarray  # whether a token is the first of its text
    keys: np.ndarray  # token x kind: 64-bit feature hashes, 0 where a word has no such affix


def tokens_of(offsets: np.ndarray, data: np.ndarray) -> Tokens:
    data = LOWER[data]
    starts, ends, rows = word_spans(offsets, data, ENDS)
    n = len(starts)
    first = np.ones(n, bool)
    first[1:] = rows[1:] != rows[:-1]
    keys = np.zeros((WIDTH, n), np.uint64)
    word = span_hashes(data, starts, ends)
    keys[0] = mix64(word + np.uint64(1))
    for i, size in enumerate(PREFIXES):
        long = np.flatnonzero(ends - starts >= size)
        keys[1 + i, long] = mix64(span_hashes(data, starts[long], starts[long] + size) + np.uint64(2))
    for i, size in enumerate(SUFFIXES):
        long = np.flatnonzero(ends - starts >= size)
        keys[1 + len(PREFIXES) + i, long] = mix64(span_hashes(data, ends[long] - size, ends[long]) + np.uint64(3))
    before = np.zeros(n, np.uint64)
    before[1:] = np.where(first[1:], 0, word[:-1])
    keys[-1] = mix64(before + np.uint64(4))
    return Tokens(starts, ends, rows, first, keys)


@dataclass
class Model:
    prior: float
    weights: np.ndarray | None = None  # one for each bucket
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # log weights from tag to tag
    begin: np.ndarray = field(default_factory=lambda: np.zeros(2))
    logistic: np.ndarray | None = None
    scale: np.ndarray | None = None

    def odds(self, keys: np.ndarray) -> np.ndarray:
        """Log weights of the toxic tag for each token."""
        total = np.zeros(keys.shape[1])
        for k in keys:
            total += np.where(k == 0, 0.0, self.weights[(k >> np.uint64(46)).astype(np.int64)])
        return np.clip(total, -30, 30)

    def marginals(self, tokens: Tokens) -> np.ndarray:
        if self.weights is None or not len(tokens.starts):
            return np.zeros(len(tokens.starts))
        return chain_marginals(self.odds(tokens.keys), tokens.first, self.steps, self.begin)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.logistic is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(_design(x, self.scale) @ self.logistic, -500, 500)))


def chain_marginals(odds: np.ndarray, first: np.ndarray, steps: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """P(tag 1) of each token of chains that stand end to end; ``first`` marks where one begins."""
    n = len(odds)
    height = max(1, int(np.ceil(np.sqrt(n))))
    lanes = -(-n // height)
    e = np.exp(odds)
    t, b = np.exp(steps), np.exp(begin)
    m = np.empty((4, lanes * height))
    m[:, n:] = np.array([[1.0], [0.0], [0.0], [1.0]])
    for i in range(2):
        m[2 * i, :n] = np.where(first, b[0], t[i, 0])
        m[2 * i + 1, :n] = np.where(first, b[1], t[i, 1]) * e
    m = np.ascontiguousarray(m.reshape(4, lanes, height).transpose(2, 0, 1))  # step, entry, lane
    p = np.zeros((4, lanes))
    p[0] = p[3] = 1
    for a in m:
        p = np.stack((p[0] * a[0] + p[1] * a[2], p[0] * a[1] + p[1] * a[3], p[2] * a[0] + p[3] * a[2], p[2] * a[1] + p[3] * a[3]))
        p /= p.sum(axis=0)
    whole = p.T.tolist()
    ahead, behind = np.empty((2, lanes)), np.empty((2, lanes))
    v = (0.5, 0.5)  # the first token begins a chain, whose matrix has equal rows
    for j, (p00, p01, p10, p11) in enumerate(whole):
        ahead[:, j] = v
        v = (v[0] * p00 + v[1] * p10, v[0] * p01 + v[1] * p11)
        v = (v[0] / (v[0] + v[1]), v[1] / (v[0] + v[1]))
    v = (0.5, 0.5)
    for j in range(lanes - 1, -1, -1):
        behind[:, j] = v
        p00, p01, p10, p11 = whole[j]
        v = (p00 * v[0] + p01 * v[1], p10 * v[0] + p11 * v[1])
        v = (v[0] / (v[0] + v[1]), v[1] / (v[0] + v[1]))
    out = np.empty((height, lanes))
    for i, a in enumerate(m):
        ahead = np.stack((ahead[0] * a[0] + ahead[1] * a[2], ahead[0] * a[1] + ahead[1] * a[3]))
        ahead /= ahead.sum(axis=0)
        out[i] = ahead[1]
    for i in range(height - 1, -1, -1):
        one, zero = out[i] * behind[1], (1 - out[i]) * behind[0]
        out[i] = one / (one + zero)
        a = m[i]
        behind = np.stack((a[0] * behind[0] + a[1] * behind[1], a[2] * behind[0] + a[3] * behind[1]))
        behind /= behind.sum(axis=0)
    return out.T.reshape(-1)[:n]


def train_chain(keys: np.ndarray, tags: np.ndarray, real: np.ndarray, *, steps: int = STEPS, ridge: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, transitions and beginnings from windows: keys (window, token, kind), tags and ``real`` flags (window, token)."""
    used, at = np.unique((keys >> np.uint64(46)).astype(np.int64), return_inverse=True)
    at = at.reshape(keys.shape)
    live = (keys != 0) & real[..., None]
    s, n = tags.shape
    w, trans, begin = np.zeros(len(used)), np.zeros((2, 2)), np.zeros(2)
    size = real.sum()
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, trans, begin)]
    both = real[:, 1:] & real[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    seen_first = np.bincount(tags[:, 0], minlength=2).astype(float)
    for step in range(1, steps + 1):
        u = np.clip(np.where(live, w[at], 0).sum(axis=2), -30, 30)
        e = np.stack((np.ones_like(u), np.exp(u)), axis=2)
        t = np.exp(trans)
        ahead, behind = np.empty((s, n, 2)), np.ones((s, n, 2))
        ahead[:, 0] = np.exp(begin) * e[:, 0]
        ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, n):
            ahead[:, i] = np.where(real[:, i, None], (ahead[:, i - 1] @ t) * e[:, i], ahead[:, i - 1])
            ahead[:, i] /= ahead[:, i].sum(axis=1, keepdims=True)
        for i in range(n - 2, -1, -1):
            behind[:, i] = np.where(real[:, i + 1, None], (e[:, i + 1] * behind[:, i + 1]) @ t.T, 1)
            behind[:, i] /= behind[:, i].sum(axis=1, keepdims=True)
        p = ahead * behind
        p /= p.sum(axis=2, keepdims=True)
        pair = ahead[:, :-1, :, None] * t * (e[:, 1:] * behind[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        miss = np.where(real, p[..., 1] - tags, 0)
        slopes = [
            np.bincount(at[live], weights=np.broadcast_to(miss[..., None], at.shape)[live], minlength=len(used)) / size + ridge * w,
            (pair[both].sum(axis=0) - seen) / size + ridge * trans,
            (p[:, 0].sum(axis=0) - seen_first) / size + ridge * begin,
        ]
        for x, g, (mean, square) in zip((w, trans, begin), slopes, moments, strict=True):  # Adam
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            x -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return weights, trans, begin


def _sums(p: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Greatest, sum and number of the marginals of each text."""
    top = np.zeros(n)
    np.maximum.at(top, rows, p)
    return np.column_stack((top, np.bincount(rows, weights=p, minlength=n), np.bincount(rows, minlength=n)))


def _design(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    top = np.clip(x[:, 0], 1e-6, 1 - 1e-6)
    cols = np.column_stack((np.log(top / (1 - top)), np.log1p(x[:, 1]), np.log1p(100 * x[:, 1] / np.maximum(x[:, 2], 1))))
    return np.column_stack((np.ones(len(x)), (cols - scale[0]) / scale[1]))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights by Newton's method, with a small ridge, and the means and deviations of the columns."""
    raw = _design(x, np.array([np.zeros(3), np.ones(3)]))[:, 1:]
    scale = np.array([raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-6)])
    z, w = _design(x, scale), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1, 1, 1]), z.T @ (p - y) + np.array([0, 1, 1, 1]) * w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w, scale


def _least_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, offsets, data in text_slices(batch.column("text")):
            n = len(offsets) - 1
            starts, ends, rows = word_spans(offsets, data)
            h, of = shingles(span_hashes(data, starts, ends), rows, n, 3)
            least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, of, h)
            own = batch.slice(row, n)
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), *own.columns], ["key", *batch.schema.names])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic, clean): texts of each label that hold a feature."""
    for batch in batches:
        for row, offsets, data in text_slices(batch.column("text")):
            n = len(offsets) - 1
            t = tokens_of(offsets, data)
            label = batch.column("label").slice(row, n).to_numpy()
            keys, rows = t.keys[TELLING].reshape(-1), np.tile(t.rows, len(TELLING))
            keys, rows = keys[keys != 0], rows[keys != 0]
            order = np.lexsort((rows, keys))
            keys, rows = keys[order], rows[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
            own, back = np.unique(keys[fresh], return_inverse=True)
            toxic = np.bincount(back, weights=label[rows[fresh]], minlength=len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(toxic), pa.array(np.bincount(back, minlength=len(own)) - toxic)], ["key", "toxic", "clean"])


def _windows(telling: np.ndarray, share: float) -> Callable:
    """(rank, tags, keys) of windows: around each toxic token, and around tokens that a hash picks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, data in text_slices(batch.column("text")):
                t = tokens_of(offsets, data)
                if not len(t.starts):
                    continue
                toxic = batch.column("label").slice(row, len(offsets) - 1).to_numpy()[t.rows] == 1
                marked = np.isin(t.keys[TELLING], telling).any(axis=0)
                tags = marked & toxic
                draw = mix64(t.keys[0] ^ mix64(t.keys[-1] + np.arange(len(tags), dtype=np.uint64)))
                lucky = (draw >> np.uint64(11)).astype(float) / 2.0**53 < share
                first = np.flatnonzero(t.first)
                text = np.cumsum(t.first) - 1
                begin, end = first[text], np.append(first[1:], len(tags))[text]
                out = []
                for at in np.flatnonzero(marked | lucky).tolist():
                    a = max(int(begin[at]), at - WINDOW // 2)
                    b = min(int(end[at]), a + WINDOW)
                    out.append((int(tags[at]) * 2 + int(marked[at]), int(draw[at].view(np.int64)), tags[a:b].astype(np.int8).tobytes(), np.ascontiguousarray(t.keys[:, a:b].T).tobytes()))
                if out:
                    kind, rank, of, keys = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(rank, pa.int64()), pa.array(of, pa.binary()), pa.array(keys, pa.binary())], ["kind", "rank", "tags", "keys"])

    return task


def _measured(model: Model) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, data in text_slices(batch.column("text")):
                t = tokens_of(offsets, data)
                x = _sums(model.marginals(t), t.rows, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(row, len(x)), *(pa.array(c) for c in x.T)], ["label", "top", "total", "n"])

    return task


def held_out(doc_id: str = "doc_id"):
    """Rows that no fit may use: crc32 of the id as text leaves 2 when divided by 4 (null ids too)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, windows: int = WINDOWS) -> Model:
    """The model of labelled texts (``labels``: doc_id, toxic) that are not held out; at most ``rows`` of them, chosen by hash."""
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    keyed = texts.mapInArrow(_least_shingle, "key long, doc_id long, text string, label long")
    path = shared_dir(spark)
    sample = stored(keyed.groupBy("key").agg(F.min_by(F.struct("text", "label"), F.struct("doc_id", "text")).alias("v")).select("v.text", "v.label"), path)
    try:
        clean, toxic = (sample.where(F.col("label") == v).count() for v in (0, 1))
        if not clean or not toxic:
            share = usable.agg(F.avg("label")).first()[0]
            return Model(0.5 if share is None else float(share))
        votes = sample.mapInArrow(_votes, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        apart = (F.col("toxic") + 0.5) / (toxic + 1) >= RATIO * (F.col("clean") + 0.5) / (clean + 1)
        telling = np.array([r["key"] for r in votes.where(apart & (F.col("toxic") >= max(2, -(-toxic // 100)))).collect()], np.int64).view(np.uint64)
        model = Model(toxic / (clean + toxic))
        if len(telling):
            share = sample.select(F.sum(F.length("text"))).first()[0]
            cut = sample.mapInArrow(_windows(telling, min(1.0, 12 * windows / max(share, 1))), "kind int, rank long, tags binary, keys binary")
            picked = [r for kind, n in (("kind = 3", windows // 2), ("kind = 1", windows // 4), ("kind = 0", windows // 2)) for r in cut.where(kind).orderBy("rank", "keys").limit(n).collect()]
            keys, tags, real = np.zeros((len(picked), WINDOW, WIDTH), np.uint64), np.zeros((len(picked), WINDOW), np.int64), np.zeros((len(picked), WINDOW), bool)
            for i, r in enumerate(picked):
                n = len(r["tags"])
                tags[i, :n], real[i, :n], keys[i, :n] = np.frombuffer(r["tags"], np.int8), True, np.frombuffer(r["keys"], np.uint64).reshape(n, WIDTH)
            model.weights, model.steps, model.begin = train_chain(keys, tags, real)
        sums = sample.mapInArrow(_measured(model), "label long, top double, total double, n double").toPandas()
        sums = sums.sort_values(list(sums.columns)).to_numpy(float)
        model.logistic, model.scale = _logistic(sums[:, 1:], sums[:, 0])
        return model
    finally:
        removed(spark, path)


def _tagged(model: Model) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, data in text_slices(batch.column("text")):
                n = len(offsets) - 1
                t = tokens_of(offsets, data)
                p = model.marginals(t)
                score = np.round(model.score(_sums(p, t.rows, n)), 9)
                on = np.flatnonzero(p >= 0.5)
                fresh = np.ones(len(on), bool)
                fresh[1:] = (on[1:] != on[:-1] + 1) | t.first[on[1:]]
                a = on[fresh]
                b = on[np.append(fresh[1:], True)] if len(on) else on
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
                base = points[offsets[t.rows[a]]]
                spans = pa.StructArray.from_arrays([pa.array(points[t.starts[a]] - base), pa.array(points[t.ends[b]] - base)], ["start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(t.rows[a], np.arange(n + 1)), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), pa.array(score), lists], ["doc_id", "score", "spans"])

    return task


def tagged(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_tagged(model), f"doc_id long, score double, spans {SPANS}")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every document; ``predicted`` is 1 from ``threshold`` on."""
    out = tagged(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"), "spans")
