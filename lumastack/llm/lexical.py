"""Ranked lexical search over a length-stratified index.

The index is a table of segments. A task that reads documents cuts them into segments of about ``SEGMENT_BYTES`` of text,
orders each segment's documents by their length in terms, and keeps for every term its postings (document, tf) in that
order. Documents of one normaliser m stand side by side, as m grows with the length, so the strata are cut when N and L are
known, and no posting is ever shuffled. A search computes one impact for each tf of a stratum, bounds every stratum by the
sum of its terms' greatest impacts, visits strata by falling bounds and stops below the k-th best score so far.

Terms are 64-bit hashes. Queries are broadcast in passes of about ``MAX_TERMS`` terms, however many items there are. Only
document frequencies of the queries' terms and two totals reach the driver; each task passes on its k best of an item.

Cases: a null or empty text has no term, and is never found; an item without terms gives no row; rows of one item_id (null
too) are one item with the terms of all; a repeated document gives a row each; equal scores go by ascending doc_id, ids
that are null last; empty tables give an empty result; very long texts are a segment of their own, lengths and scores are
64-bit, m is computed in Python's integers; columns other than ids and texts are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import removed, shared_dir, stored
from .textops import LOWER, span_hashes, text_slices, word_spans

SEGMENT_BYTES = 24_000_000
MAX_TERMS = 2_000_000
VISIT = 1024
#: Bytes that end a term: ASCII other than letters and digits.
ENDS = np.ones(256, bool)
ENDS[128:] = False
ENDS[48:58] = ENDS[65:91] = ENDS[97:123] = False
SEGMENT = "ids array<long>, sizes binary, terms binary, starts binary, docs binary, tfs binary, n_docs long, n_terms long"
_TYPES = pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("sizes", "terms", "starts", "docs", "tfs")), ("n_docs", pa.int64()), ("n_terms", pa.int64())])


def term_counts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term hash, tf) of all distinct terms of each row, and the number of terms of each row."""
    data = LOWER[data]
    starts, ends, rows = word_spans(offsets, data, ENDS)
    sizes = np.bincount(rows, minlength=len(offsets) - 1)
    h = span_hashes(data, starts, ends)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(fresh)
    return rows[at], h[at], np.diff(np.append(at, len(h))), sizes


def _segment(ids: list[pa.Array], parts: list[tuple]) -> pa.RecordBatch:
    sizes, first = np.concatenate([p[3] for p in parts]), np.cumsum([0, *(len(p[3]) for p in parts)])
    rows = np.concatenate([p[0] + a for p, a in zip(parts, first, strict=False)])
    terms, tfs = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    order = np.argsort(sizes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    docs = place[rows]
    by = np.lexsort((docs, terms))
    terms, docs, tfs = terms[by], docs[by], tfs[by]
    fresh = np.ones(len(terms), bool)
    fresh[1:] = terms[1:] != terms[:-1]
    at = np.flatnonzero(fresh)
    own = pa.concat_arrays(ids).take(pa.array(order))
    blobs = (sizes[order].astype("<i8"), terms[at], np.append(at, len(terms)).astype("<i8"), docs.astype("<u4"), tfs.astype("<u4"))
    values = [pa.ListArray.from_arrays([0, len(own)], own), *(pa.array([b.tobytes()], pa.binary()) for b in blobs), pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])]
    return pa.RecordBatch.from_arrays(values, schema=_TYPES)


def _indexed(segment_bytes: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            for row, offsets, data in text_slices(batch.column("text")):
                ids.append(batch.column("doc_id").slice(row, len(offsets) - 1))
                parts.append(term_counts(offsets, data))
                held += len(data) + 64 * len(offsets)
                if held >= segment_bytes:
                    yield _segment(ids, parts)
                    ids, parts, held = [], [], 0
        if parts:
            yield _segment(ids, parts)

    return task


def build_index(docs: DataFrame, *, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The segments of documents (doc_id, text); store the table before searching it."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_indexed(segment_bytes), SEGMENT)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, offsets, data in text_slices(batch.column("text")):
            rows, terms, _, _ = term_counts(offsets, data)
            ids = batch.column("item_id").slice(row, len(offsets) - 1).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(terms.view(np.int64))], ["item_id", "term"])


def _found(wanted: np.ndarray) -> Callable:
    """Document frequencies of the terms ``wanted`` (ascending) in each segment."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, starts = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("terms", np.uint64), ("starts", np.int64)))
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                    df += np.where(terms[at] == wanted, starts[at + 1] - starts[at], 0)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(df[hit])], ["at", "df"])

    return task


def normaliser(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of lengths in terms; in Python's integers, as the product may pass 64 bits."""
    each, back = np.unique(sizes, return_inverse=True)
    return np.array([50 + (50 * int(v) * n) // total for v in each], np.int64)[back]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges, end to end."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


class _Best:
    """The k best (score, doc_id) of an item so far, nulls last among equal scores."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.concatenate((self.score, score)), np.concatenate((self.doc, doc)), np.concatenate((self.null, null))
        if len(score) > 4 * self.k:
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, doc, null = score[keep], doc[keep], null[keep]
        best = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[best], doc[best], null[best]


def _visit(segment: dict, wanted: np.ndarray, weights: np.ndarray, items: list[np.ndarray], best: list[_Best], n: int, total: int) -> int:
    """Search one segment for all items; gives the number of postings scored."""
    terms, starts, sizes = segment["terms"], segment["starts"], segment["sizes"]
    if not len(terms):
        return 0
    m = normaliser(sizes, n, total)
    edge = np.ones(len(m), bool)
    edge[1:] = m[1:] != m[:-1]
    stratum = np.cumsum(edge) - 1
    of = m[edge]
    width = np.bincount(stratum)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == wanted)
    lengths = starts[at[hit] + 1] - starts[at[hit]]
    places = _ranges(starts[at[hit]], lengths)
    term, doc, tf = np.repeat(hit, lengths), segment["docs"][places].astype(np.int64), segment["tfs"][places].astype(np.int64)
    levels, level = np.unique(tf, return_inverse=True)
    impacts = (1_000_000_000 * levels) // (1000 * levels + 20 * of[:, None])  # one for each tf of a stratum
    impact = impacts[stratum[doc], level]
    cut = np.ones(len(term), bool)
    cut[1:] = (term[1:] != term[:-1]) | (stratum[doc[1:]] != stratum[doc[:-1]])
    group = np.flatnonzero(cut)
    if not len(group):
        return 0
    g_len, g_stratum, g_bound = np.diff(np.append(group, len(term))), stratum[doc[group]], np.maximum.reduceat(impact, group) * weights[term[group]]
    g_of = np.searchsorted(term[group], np.arange(len(wanted) + 1))  # groups of each term
    scored = 0
    for i, own in enumerate(items):
        mine = _ranges(g_of[own], g_of[own + 1] - g_of[own])
        bound = np.zeros(len(of), np.int64)
        np.add.at(bound, g_stratum[mine], g_bound[mine])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        a, reach = 0, max(VISIT, 8 * best[i].k)
        while a < len(order) and bound[order[a]] >= best[i].least():
            b = a + max(1, int(np.searchsorted(np.cumsum(width[order[a:]]), reach)))
            chosen = np.zeros(len(of), bool)
            chosen[order[a:b]] = bound[order[a:b]] >= best[i].least()
            live = mine[chosen[g_stratum[mine]]]
            p = _ranges(group[live], g_len[live])
            scores = np.zeros(len(m), np.int64)
            np.add.at(scores, doc[p], impact[p] * weights[term[p]])
            good = np.flatnonzero((scores > 0) & (scores >= best[i].least()))
            best[i].add(scores[good], segment["ids"][good], segment["null"][good])
            scored += len(p)
            a, reach = b, 2 * reach
    return scored


def _searched(wanted: np.ndarray, weights: np.ndarray, names: list[int | None], items: list[np.ndarray], n: int, total: int, k: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                kinds = {"sizes": np.int64, "terms": np.uint64, "starts": np.int64, "docs": np.uint32, "tfs": np.uint32}
                segment = {c: np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in kinds.items()}
                ids = batch.column("ids")[i].values
                segment |= {"ids": ids.fill_null(0).to_numpy(zero_copy_only=False), "null": ids.is_null().to_numpy(zero_copy_only=False)}
                _visit(segment, wanted, weights, items, best, n, total)
        for name, b in zip(names, best, strict=True):
            if len(b.score):
                docs = pa.array(b.doc, mask=b.null)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(docs), pa.int64()), docs, pa.array(b.score)], ["item_id", "doc_id", "score"])

    return task


def search(index: DataFrame, items: DataFrame, *, k: int = 50, max_terms: int = MAX_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of a stored index for each of ``items`` (item_id, text)."""
    spark = index.sparkSession
    n, total = (int(v or 0) for v in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    words = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, term long").distinct()
    path = shared_dir(spark)
    words = stored(words, path)
    passes = max(1, -(-words.count() // max_terms))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for p in range(passes if total else 0):
        rows = words.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toArrow()
        names, keys = rows.column("item_id").combine_chunks().dictionary_encode("encode"), rows.column("term").to_numpy().view(np.uint64)
        if not len(keys):
            continue
        wanted, at = np.unique(keys, return_inverse=True)
        df = np.zeros(len(wanted), np.int64)
        for r in index.select("terms", "starts").mapInArrow(_found(wanted), "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toLocalIterator():
            df[r["at"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(v) + 1))) for v in df], np.int64)
        of = names.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        own = np.split(at[order], np.cumsum(np.bincount(of, minlength=len(names.dictionary)))[:-1])
        part = index.drop("n_docs", "n_terms").mapInArrow(_searched(wanted, weights, names.dictionary.to_pylist(), own, n, total, k), "item_id long, doc_id long, score long")
        found = found.unionByName(part)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = stored(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    removed(spark, path)
    return ranked


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 50) -> DataFrame:
    """``search`` over an index of ``docs`` that is built, stored, and deleted again."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    out = search(stored(build_index(docs), path), items, k=k)
    removed(spark, path)
    return out
