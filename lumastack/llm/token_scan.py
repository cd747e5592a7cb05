"""Token counts by scanning flat, unindexed token files for their end-of-document id.

A flat file holds ids of fixed width, end to end; a document's ids are followed by the end id. The files together are one
stream, in the order of their part numbers, and a document may begin in one block or file and end in a later one. Each
block is searched at once by a vectorised comparison and reports its number of ids and the places of its end ids. A
prefix scan over the blocks (totals of files first, then blocks inside each file) gives every block the ids and documents
before it and the last end id before it, which stitches the documents that cross blocks.

Cases: null and empty texts are documents of no ids; an empty file or table has no documents; ids after the last end id
are one document more, not ``closed``; repeated rows and ties in the id are documents of their own, in the order of their
ids' hashes; null ids come first; a very long text is one document of as
many ids, over as many blocks as it takes; other columns are ignored. Files are read whole by one task each, so writers bound them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import exclusive_starts, removed, shared_dir, stored
from .textops import span_hashes, text_slices, word_spans

BLOCK_IDS, FILE_BYTES = 1 << 19, 32 << 20


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids 1 to 65535 of each word, by hash, as bytes."""
    for batch in batches:
        for row, offsets, data in text_slices(batch.column("text")):
            starts, ends, rows = word_spans(offsets, data)
            ids = (span_hashes(data, starts, ends) % np.uint64(65_535) + np.uint64(1)).astype("<u2").tobytes()
            cuts = (2 * np.searchsorted(rows, np.arange(len(offsets)))).tolist()
            values = pa.array([ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(values)), values], ["doc_id", "value"])


def write_flat(docs: DataFrame, out: str, *, files: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write the words of ``docs`` (doc_id, text) as flat files of 2-byte ids in ascending doc_id order; the end id is 0.

    Spark's committing text writer writes them, its line end being the end id. Ids are dealt out, not texts, in ranges of
    doc_id and hash, so that an id with many rows is split as well. Without ``files``, there are as many as keep each below
    about ``file_bytes``: a text's ids take at most the bytes of the text and 3 more.
    """
    if files is None:
        size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 3).alias("n")).first()["n"] or 0
        files = max(1, -(-size // file_bytes))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_worded, "doc_id long, value binary")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = ids.withColumn("tie", F.xxhash64("value")).repartitionByRange(files, *order).sortWithinPartitions(*order)
    dealt.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\u0000\u0000").text(out)


def _searched(dtype: str, end_id: int, block: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                ids = np.frombuffer(content.as_buffer(), dtype)
                for b, at in enumerate(range(0, len(ids), block)):
                    part = ids[at : at + block]
                    ends = np.flatnonzero(part == end_id)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file], pa.int64()), pa.array([b], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                        ["file", "block", "n_ids", "ends"],
                    )

    return task


def scan(spark: SparkSession, path: str, *, dtype: str = "<u2", end_id: int = 0, block: int = BLOCK_IDS) -> DataFrame:
    """(ordinal, start, n_tokens, closed) of every document in the files at ``path``; counts leave the end id out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file"), "content").where(F.length("content") > 0)
    kept = shared_dir(spark)
    blocks = stored(files.mapInArrow(_searched(dtype, end_id, block), "file long, block long, n_ids long, ends array<long>"), kept)
    blocks = blocks.withColumn("n_ends", F.size("ends").cast("long"))
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = blocks.withColumn("at", F.coalesce(F.sum("n_ids").over(inside), zero)).withColumn("no", F.coalesce(F.sum("n_ends").over(inside), zero))
    placed = placed.withColumn("last", F.max(F.when(F.col("n_ends") > 0, F.col("at") + F.element_at("ends", -1))).over(inside))
    # of files: a few numbers each, scanned in order
    total = blocks.groupBy("file").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_ends").alias("n_ends"), F.max(F.when(F.col("n_ends") > 0, F.struct("block", F.element_at("ends", -1).alias("end")))).alias("x"))
    total = total.withColumn("last_in", F.col("x.block") * block + F.col("x.end")).drop("x")
    total = file_scan(total)
    rows = placed.join(total.select("file", "file_at", "file_no", "file_last"), "file")
    base = F.col("file_at") + F.col("at")
    carry = F.coalesce(F.col("file_at") + F.col("last"), F.col("file_last"), F.lit(-1).cast("long"))
    pairs = F.transform("ends", lambda e, i: F.struct((base + e).alias("end"), F.coalesce(base + F.get("ends", i - 1), carry).alias("before")))
    rows = rows.select((F.col("file_no") + F.col("no")).alias("no"), pairs.alias("pairs")).select("no", F.posexplode("pairs").alias("i", "p"))
    docs = rows.select((F.col("no") + F.col("i")).alias("ordinal"), (F.col("p.before") + 1).alias("start"), (F.col("p.end") - F.col("p.before") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = total.agg(F.sum("n_ids").alias("ids"), F.sum("n_ends").alias("ends"), F.max(F.coalesce(F.col("file_at") + F.col("last_in"), F.lit(-1))).alias("last"))
    rest = whole.where("ids > last + 1").select(F.col("ends").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("ids") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return docs.union(rest)


def file_scan(total: DataFrame, width: int = 512) -> DataFrame:
    """Ids, documents and the last end id before each file, in two levels of ``width`` files."""
    zero = F.lit(0).cast("long")
    total = total.withColumn("group", F.expr(f"file div {width}"))
    inner = Window.partitionBy("group").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("g_at", F.coalesce(F.sum("n_ids").over(inner), zero)).withColumn("g_no", F.coalesce(F.sum("n_ends").over(inner), zero))
    total = total.withColumn("g_last", F.max(F.col("g_at") + F.col("last_in")).over(inner))
    groups = total.groupBy("group").agg(F.sum("n_ids").alias("ids"), F.sum("n_ends").alias("ends"), F.max(F.col("g_at") + F.col("last_in")).alias("last"))
    outer = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("b_at", F.coalesce(F.sum("ids").over(outer), zero)).withColumn("b_no", F.coalesce(F.sum("ends").over(outer), zero))
    groups = groups.withColumn("b_last", F.max(F.col("b_at") + F.col("last")).over(outer)).select("group", "b_at", "b_no", "b_last")
    rows = total.join(groups, "group")
    return rows.select("file", "n_ids", "n_ends", "last_in", (F.col("b_at") + F.col("g_at")).alias("file_at"), (F.col("b_no") + F.col("g_no")).alias("file_no"), F.coalesce(F.col("b_at") + F.col("g_last"), F.col("b_last")).alias("file_last"))


def counted(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as flat files, scan them, and name the documents found by their place in ascending doc_id order."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    write_flat(docs, path)
    found = stored(scan(spark, path))
    removed(spark, path)
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.lit(1).cast("long").alias("one"))
    names = exclusive_starts(keys, ["doc_id", "tie"], "one", "ordinal")
    return found.join(names.select("ordinal", "doc_id"), "ordinal").select("doc_id", "ordinal", "start", "n_tokens")
