"""Mixing sources to target weights in fixed-length blocks.

The words of a source's documents, in ascending order of their ids, are packed end to end into blocks of ``block`` words,
the last one shorter. A source with a target of T words of its S is read through floor(T / S) whole passes and a part of
one more, so it fills ceil(T mod S / block) further slots, the last cut to the word. Output shards have a fixed number of
slots; each draws its sources' counts from one multinomial, seeded by the shard's number. What the draws give a source
beyond its slots goes, slot by slot, to the sources they leave short, so every source ends at its target. Slot j of a
source lies in pass j div B and takes the block that this pass's pseudorandom permutation (a Feistel network walked until
it stays in range; the short last block keeps its place) maps j mod B to; blocks are joined by index.

Only the table of sources, of at most ``MAX_SOURCES`` rows (checked), reaches the driver and the tasks.

Cases: a null or empty text has size 0 and is never taken; a null source is a source of its own and comes last; a source
without words has the target 0; repeated rows and ties in the id are documents of their own; a very long text is cut into
blocks like any other, and only its number of words is held; an empty table gives an empty result; columns other than those
named are carried along only by ``mixed_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import exclusive_starts, shared_dir, stored
from .textops import mix64

BLOCK, SHARD_SLOTS, MAX_SOURCES = 128, 8192, 100_000
GAP = r"[\x20\x09-\x0D]+"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass
class Sources:
    """The sources in order: names, words, targets, and their slots."""

    names: list
    sizes: np.ndarray
    targets: np.ndarray
    block: int

    @property
    def wanted(self) -> np.ndarray:
        return np.floor(self.targets + 0.5).astype(np.int64)

    @property
    def blocks(self) -> np.ndarray:
        return -(-self.sizes // self.block)

    @property
    def slots(self) -> np.ndarray:
        size = np.maximum(self.sizes, 1)
        return np.where(self.sizes > 0, self.wanted // size * self.blocks + -(-(self.wanted % size) // self.block), 0)

    @property
    def cuts(self) -> np.ndarray:
        """How many words the last slot takes."""
        left = self.wanted % np.maximum(self.sizes, 1)
        return np.where(left > 0, (left - 1) % self.block + 1, self.block)


def capped_targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of ``total`` by weight, at most ``most`` times each size; what is above goes to the others by weight."""
    caps, target = most * sizes.astype(float), np.zeros(len(sizes))
    free = sizes > 0
    left = float(total)
    while free.any():
        share = left * weights / weights[free].sum()
        above = free & (share > caps)
        if not above.any():
            target[free] = share[free]
            break
        target[above] = caps[above]
        left -= caps[above].sum()
        free &= ~above
    return target


def sources_of(rows: DataFrame, *, block: int, most: float, cycle: tuple[int, ...]) -> Sources:
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = np.array([r["size"] for r in found], np.int64)
    weights = np.array([cycle[i % len(cycle)] for i in range(len(found))], float)
    return Sources([r["source"] for r in found], sizes, capped_targets(sizes, weights, float(sizes.sum()), most), block)


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The images of ``index`` under a pseudorandom permutation of range(n)."""
    if n < 2:
        return index
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03 + 1) % 2**64)
            left, right = right, left ^ (mix64(mix64(right + np.uint64(1)) ^ key) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _drawn(p: np.ndarray, total: int, shard_slots: int, seed: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                n = min(shard_slots, total - k * shard_slots)
                counts = np.random.default_rng([seed, k]).multinomial(n, p)
                s = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k)), pa.array(s.astype(np.int32)), pa.array(counts[s])], ["shard", "source_no", "n"])

    return task


def _placed(sources: Sources, seed: int) -> Callable:
    blocks, slots, cuts, sizes, block = sources.blocks, sources.slots, sources.cuts, sources.sizes, sources.block

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, source, first, n = (batch.column(c).to_numpy() for c in ("shard", "source_no", "first", "n"))
            for k, s, a, m in zip(shard.tolist(), source.tolist(), first.tolist(), n.tolist(), strict=True):
                j = np.arange(a, a + m)
                full, at, turn = int(sizes[s] // block), j % blocks[s], j // blocks[s]
                to = at.copy()
                for t in np.unique(turn).tolist():
                    inside = (turn == t) & (at < full)
                    to[inside] = permuted(at[inside], full, (seed * 1_000_003 + s) * 101 + t)
                limit = np.where(j == slots[s] - 1, cuts[s], block)
                columns = [np.full(m, k), np.full(m, s, np.int32), turn, to, limit.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["shard", "source_no", "pass", "block", "limit"])

    return task


def drawn_slots(spark, sources: Sources, *, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """All slots of the mix: (shard, source_no, pass, block, limit), ``limit`` words of the block being taken."""
    schema = "shard long, source_no int, pass long, block long, limit long"
    total = int(sources.slots.sum())
    shards = -(-total // shard_slots)
    p = sources.slots / max(total, 1)
    drawn = stored(spark.range(shards).mapInArrow(_drawn(p, total, shard_slots, seed), "shard long, source_no int, n long"), shared_dir(spark))
    begun = exclusive_starts(drawn, ["source_no", "shard"], "n", "begin")
    got = np.zeros(len(sources.names), np.int64)
    for r in drawn.groupBy("source_no").agg(F.sum("n").alias("n")).collect():
        got[r["source_no"]] = r["n"]
    offset = np.concatenate(([0], np.cumsum(got)[:-1]))
    # only the table of sources becomes rows here
    facts = spark.createDataFrame([(i, int(offset[i]), int(sources.slots[i])) for i in range(len(got))], "source_no int, offset long, slots long")
    dealt = begun.join(facts, "source_no").withColumn("first", F.col("begin") - F.col("offset"))
    dealt = stored(dealt.withColumn("keep", F.greatest(F.lit(0), F.least("n", F.col("slots") - F.col("first")))).select("shard", "source_no", "first", "n", "keep"), shared_dir(spark))
    # places that draws beyond a source's slots leave free, and slots that the draws did not reach, matched one to one
    free = exclusive_starts(dealt.where("keep < n").groupBy("shard").agg(F.sum(F.col("n") - F.col("keep")).alias("free")), ["shard"], "free", "at")
    places = free.select("shard", F.explode(F.sequence("at", F.col("at") + F.col("free") - 1)).alias("place"))
    short = np.maximum(sources.slots - got, 0)
    at = np.concatenate(([0], np.cumsum(short)[:-1]))
    lacking = [(i, int(got[i]), int(at[i]), int(short[i])) for i in np.flatnonzero(short).tolist()]
    lacking = spark.createDataFrame(lacking, "source_no int, got long, at long, short long")
    lacking = lacking.select("source_no", "got", "at", F.explode(F.sequence("at", F.col("at") + F.col("short") - 1)).alias("place"))
    topped = places.join(lacking, "place").select("shard", "source_no", (F.col("got") + F.col("place") - F.col("at")).alias("first"), F.lit(1).cast("long").alias("n"))
    spans = dealt.where("keep > 0").select("shard", "source_no", "first", F.col("keep").alias("n")).unionByName(topped)
    return spans.repartition("shard", "source_no").mapInArrow(_placed(sources, seed), schema)


def packed(rows: DataFrame, sources: Sources) -> DataFrame:
    """Each document's parts by block: (row, source_no, block, lo, hi), words lo to hi of the block, and ``from`` in the document."""
    spark, block = rows.sparkSession, sources.block
    starts = exclusive_starts(rows.select("row", "doc_id", "source", "size"), ["source", "doc_id", "size"], "size", "start")
    order = sorted(range(len(sources.names)), key=lambda i: (sources.names[i] is not None, (sources.names[i] or "").encode()))
    first, at = {}, 0
    for i in order:  # nulls come first where Spark sorts
        first[i], at = at, at + int(sources.sizes[i])
    facts = spark.createDataFrame([(i, sources.names[i], first[i]) for i in order], "source_no int, name string, offset long")
    placed = starts.join(facts, starts["source"].eqNullSafe(facts["name"])).where("size > 0").withColumn("start", F.col("start") - F.col("offset"))
    end = F.col("start") + F.col("size")
    cut = placed.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    lo = F.greatest("start", F.col("block") * block)
    hi = F.least(end, (F.col("block") + 1) * block)
    return cut.select("row", "source_no", "block", (lo - F.col("block") * block).alias("lo"), (hi - F.col("block") * block).alias("hi"), (lo - F.col("start")).alias("from"))


@dataclass
class Mix:
    """``rows``: the stored documents (row, doc_id, source, size, ...); ``slots`` and ``parts`` as above."""

    rows: DataFrame
    sources: Sources
    slots: DataFrame
    parts: DataFrame


def mix(docs: DataFrame, *, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, most: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3), seed: int = 1, keep_text: bool = False) -> Mix:
    """Plan the mix of ``docs`` (doc_id, text, source): as many words in all as there are, by the weights ``cycle``."""
    spark = docs.sparkSession
    size = F.coalesce(F.size(F.array_remove(F.split("text", GAP), "")), F.lit(0)).cast("long")
    kept = [c for c in docs.columns if c not in ("row", "size", "text")] + ["text"] * keep_text
    rows = docs.withColumn("size", F.when(F.col("text").isNull(), 0).otherwise(size).cast("long")).withColumn("row", F.monotonically_increasing_id()).select("row", "size", *kept)
    rows = stored(rows, shared_dir(spark))
    sources = sources_of(rows, block=block, most=most, cycle=cycle)
    slots = drawn_slots(spark, sources, shard_slots=shard_slots, seed=seed)
    return Mix(rows, sources, slots, packed(rows, sources))


def taken_words(m: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    spark = m.rows.sparkSession
    uses = m.slots.groupBy("source_no", "block", "limit").agg(F.count(F.lit(1)).alias("uses"))
    words = F.col("uses") * F.greatest(F.lit(0), F.least("hi", "limit") - F.col("lo"))
    taken = m.parts.join(uses.hint("merge"), ["source_no", "block"]).groupBy("row").agg(F.sum(words).alias("taken"))
    s = m.sources
    facts = spark.createDataFrame([(s.names[i], int(s.sizes[i]), float(s.targets[i])) for i in range(len(s.names))], "name string, source_size long, target double")
    out = m.rows.select("row", "doc_id", "source", "size").join(taken.hint("merge"), "row", "left")
    out = out.join(facts, out["source"].eqNullSafe(facts["name"]))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, size, spans in zip(batch.column("text").to_pylist(), batch.column("size").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            spans = sorted((x["from"], x["to"]) for x in spans)
            if sum(b - a for a, b in spans) == size:
                out.append(text)
                continue
            starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
            out.append("".join(text[starts[a] : starts[b]] for a, b in spans))
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, "text", pa.array(out, pa.string()))


def mixed_documents(m: Mix) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words of it, with the text that it takes.

    ``m`` was planned with ``keep_text``. A row has the shard of its first block, ``pass`` and the document's columns.
    """
    uses = m.parts.join(m.slots.hint("merge"), ["source_no", "block"]).where("lo < limit")
    span = F.struct(F.col("from"), (F.col("from") + F.least("hi", "limit") - F.col("lo")).alias("to"))
    pieces = uses.groupBy("row", "pass").agg(F.min("shard").alias("shard"), F.collect_list(span).alias("spans"))
    rows = m.rows.drop("shard", "pass", "spans").join(pieces.hint("merge"), "row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_cut_texts, schema).drop("row", "size", "spans")
