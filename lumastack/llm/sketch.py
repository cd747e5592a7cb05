"""Document fingerprints by threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so sketches of parts merge by union, and the
share of one sketch found in another estimates containment without bias, however unequal the documents are. Shingles are
windows of ``width`` bytes of the UTF-8 text; a shorter text is one shingle. A text none of whose hashes lie below the
threshold keeps its least hash, so that no non-empty text has an empty sketch; an empty text's sketch is empty.

The likeness of two sketches is the share of the smaller that the larger holds; 1 for two empty ones, 0 for one.

Cases: a null text is empty; equal texts have equal fingerprints; repeated rows and ties in the id follow each other in
the order of their texts' hashes; null ids sort first; the only row of a table is its own successor; an empty table gives an empty
result; texts of any length are read in slices; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ORDER, first_keys, keyed, range_of
from .textops import span_hashes

WIDTH, FRACTION = 12, 1 / 16
SLICE = 1 << 20
_KEPT = np.uint64(0xFFFFFFFF)  # which of a kept hash's bits identify it; the threshold looks at the others first


def sketch(text: bytes, width: int = WIDTH, fraction: float = FRACTION) -> np.ndarray:
    """The sorted distinct hashes that the sketch of ``text`` keeps."""
    data = np.frombuffer(text, np.uint8)
    n = len(data) - width + 1
    if not len(data):
        return np.zeros(0, np.uint64)
    if n <= 1:
        return span_hashes(data, np.array([0]), np.array([len(data)])) & _KEPT
    bound, kept, least = np.uint64(int(fraction * 2**64) - 1), [], None
    for at in range(0, n, SLICE):
        part = data[at : at + SLICE + width - 1]
        starts = np.arange(len(part) - width + 1)
        h = span_hashes(part, starts, starts + width)
        low = h[h <= bound]
        kept.append(low)
        if not len(low):
            least = h.min() if least is None else min(least, h.min())
    out = np.concatenate(kept)
    return np.unique((out if len(out) else np.array([least], np.uint64)) & _KEPT)


def merged(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of texts together, shingles across their seams aside."""
    return np.unique(np.concatenate(sketches)) if sketches else np.zeros(0, np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's shingles that b holds, estimated."""
    if not len(a):
        return 1.0 if not len(b) else 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller in the larger."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def written(s: np.ndarray) -> str:
    """A sketch as text: 8 hexadecimal digits a hash, ascending."""
    return s.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(width: int, fraction: float) -> Callable:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, whose successor is the next row of the same part
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for part, doc_id, tail, value in zip(*(batch.column(c) for c in ("part", "doc_id", "tail", "text")), strict=True):
                part, doc_id, tail, text = part.as_py(), doc_id.as_py(), tail.as_py(), value.as_py() or ""
                own = sketch(text.encode(), width, fraction)
                if held is not None and held[0] == part:
                    _, of, before, s = held
                    new = edited(before, text)
                    changed = sketch(new.encode(), width, fraction)
                    rows.append((of, len(before), hashlib.sha256(new.encode()).hexdigest(), written(s), written(changed), likeness(s, changed), likeness(s, own)))
                    size += len(before)
                held = None if tail else (part, doc_id, text, own)
                if size > 4_000_000:
                    yield _batch(rows, names)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, names)

    return task


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def fingerprints(docs: DataFrame, *, width: int = WIDTH, fraction: float = FRACTION) -> DataFrame:
    """Sketch every text and its edited text, and compare each with the next document's, in ascending id order.

    Keys (id and text hash) are cut into ranges; of each range the first key reaches the driver and the tasks. Texts are dealt
    once, by range, and sorted within; a range's first row goes to the range before it as well, as the successor of its last
    row, and the first row of all goes to the last range.
    """
    spark = docs.sparkSession
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs)
    heads = first_keys(rows, n)
    if not heads:
        return rows.select("doc_id").mapInArrow(lambda b: iter(()), schema)
    placed = rows.withColumn("at", range_of(heads)(*ORDER)).select("at.part", "at.first", "doc_id", *ORDER, "text")
    begun = placed.where("first").groupBy("part").agg(F.min(F.struct("doc_id", *ORDER, "text")).alias("h"))
    tails = begun.select(F.pmod(F.col("part") - 1, F.lit(len(heads))).alias("part"), F.lit(True).alias("tail"), "h.*")
    both = placed.select("part", F.lit(False).alias("tail"), "doc_id", *ORDER, "text").unionByName(tails)
    dealt = both.repartitionById(len(heads), "part").sortWithinPartitions("part", "tail", *ORDER)
    return dealt.select("part", "tail", "doc_id", "text").mapInArrow(_compared(width, fraction), schema)
