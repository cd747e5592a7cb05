"""MinHash near-duplicate detection with SuperMinHash signatures, banding, verification and union-find grouping.

Each distinct shingle of a document walks one pseudorandom permutation of the signature's positions and offers rank plus
a fraction at each; a position keeps its least offer. Ranks of one element are correlated (it never hits a position
twice), which lowers the variance of plain MinHash, and the walk of a document stops at the rank that can no longer
lower any position. Signatures are banded; documents that share a band value are candidates.

Groups are found without emitting pairs within a bucket: (1) equal shingle sets collapse to one representative;
(2) each bucket's least id is a hub, and only (hub, member) pairs are verified on full sets; (3) in buckets that still span
several groups, the documents outside the bucket's largest group are compared with all others, in blocks, in the tasks,
and only a spanning forest of the links found leaves a task. No bucket or partner is capped: with n documents, m of them
outside the largest group, n m / b + m n / b rows are dealt in blocks of b, which is n where few stand outside. Joins on
hubs and buckets are salted, so that a group of a third of all rows is not one task's.

Pairs whose signatures agree in less than ``PLAUSIBLE`` of their places are not verified; of pairs at 0.8, whose places agree
with that chance each, fewer than one in 100,000 is lost so (fewer than 48 of 80 places).

Cases: a null, empty or blank text has no shingles, is linked with nothing and is its own group; a text shorter than the
shingle has one shingle, its whole sequence; repeated rows of one doc_id give one result row for each; a null doc_id is
returned as its own group with a null component. Of equal sets, and of a group, the least doc_id stands for all. A very long
text is read in slices, and its whole set is compared. Columns other than the id and text columns are ignored, and an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import removed, shared_dir, stored
from .textops import LOWER, distinct_sorted, mix64, shingles, span_hashes, text_slices, word_spans

ROWS, BANDS = 4, 20
PLAUSIBLE = 0.6
BLOCK, BLOCK_SHINGLES, SALTS = 300, 150_000, 64
_STEP = 0x9E3779B97F4A7C15


def _salt(i: int) -> np.uint64:
    return np.uint64(_STEP * i % 2**64)


def superminhash(hashes: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Signatures (float64, rows x m) of sets given end to end; empty sets stay at infinity."""
    n = len(offsets) - 1
    signature = np.full((n, m), np.inf)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    first, places = None, None
    for rank in range(m):
        if rank:
            open_rows = signature.max(axis=1) > rank
            alive = open_rows[owner]
            if not alive.all():
                hashes, owner = hashes[alive], owner[alive]
                first = first[alive] if places is None else first
                places = places[alive] if places is not None else None
            if not len(hashes):
                break
        draw = mix64(hashes + _salt(2 * rank + 1))
        swap = rank + (mix64(hashes + _salt(2 * rank + 2)) % np.uint64(m - rank)).astype(np.int64)
        if rank == 0:
            first = at = swap
        else:
            lines = np.arange(len(hashes))
            if places is None:
                places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(hashes), 1))
                places[:, 0] = first
                places[lines, first] = 0
            at = places[lines, swap]
            places[lines, swap] = places[:, rank]
            places[:, rank] = at
        np.minimum.at(signature.reshape(-1), owner * m + at, rank + (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)
    return signature


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct shingle hashes, offsets) of runs of rows; A-Z are lower-cased."""
    for row, offsets, data in text_slices(column):
        data = LOWER[data]
        starts, ends, rows = word_spans(offsets, data)
        hashes, of = shingles(span_hashes(data, starts, ends), rows, len(offsets) - 1, k)
        yield row, *distinct_sorted(hashes, of, len(offsets) - 1)


def _signed(k: int, rows: int, bands: int) -> Callable:
    m = rows * bands

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets, offsets in shingle_sets(batch.column("text"), k):
                n = len(offsets) - 1
                bits = mix64(superminhash(sets, offsets, m).view(np.uint64))
                band = np.zeros((n, bands), np.uint64)
                for i in range(rows):
                    band = mix64(band + bits[:, i::rows] + np.uint64(i + 1))
                band = mix64(band + np.arange(bands, dtype=np.uint64)[None])
                sizes = np.diff(offsets)
                keys = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, n), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                        pa.array([x.tobytes() for x in (bits >> np.uint64(56)).astype(np.uint8)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands), pa.int32()), pa.array(band.view(np.int64).reshape(-1))),
                    ],
                    ["doc_id", "n_shingles", "set_key", "marks", "bands"],
                )

    return task


def _full_sets(k: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets, offsets in shingle_sets(batch.column("text"), k):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), pa.array([sets[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["id", "set"])

    return task


def _agreeing(floor: float) -> Callable:
    """Pairs whose signatures' last bytes agree often enough for the similarity to be in reach."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("ma", "mb"))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= floor))

    return task


def _linked(num: int, den: int) -> Callable:
    """Pairs (a, b) of which the full sets are similar enough, exactly."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                same = len(u) + len(v) - len(np.union1d(u, v))
                keep.append(den * same >= num * (len(u) + len(v) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return task


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by it."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
        edge = np.zeros(batch.num_rows, bool)
        for c in cols:
            edge[1:] |= c[1:] != c[:-1]
        if last is not None and tuple(c[0] for c in cols) != last:
            edge[0] = True
        at = 0
        for cut in np.flatnonzero(edge):
            if cut > at:
                kept.append(batch.slice(at, cut - at))
            if kept:
                yield pa.Table.from_batches(kept)
            kept, at = [], int(cut)
        kept.append(batch.slice(at))
        last = tuple(c[-1] for c in cols)
    if kept:
        yield pa.Table.from_batches(kept)


def _sides(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of a block: the places of the documents outside the bucket's largest group, and of those to compare them with."""
    outer = run.column("outer").to_numpy(zero_copy_only=False)
    return np.flatnonzero(outer), np.arange(len(outer)) if run.column("j")[0].as_py() == 0 else np.flatnonzero(~outer)


def _plausible(floor: float) -> Callable:
    """Of a block: the documents that have a partner of another group in reach."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, ["bucket", "i", "j"]):
            n = run.num_rows
            xs, ys = _sides(run)
            if n < 2 or not len(xs):
                continue
            comp = run.column("comp").to_numpy()
            marks = np.frombuffer(b"".join(run.column("marks").to_pylist()), np.uint8).reshape(n, -1)
            found = np.zeros(n, bool)
            for x in xs.tolist():
                near = ((marks[ys] == marks[x]).mean(axis=1) >= floor) & (comp[ys] != comp[x])
                found[x] |= near.any()
                found[ys[near]] = True
            if found.any():
                yield from run.select(["bucket", "id"]).filter(pa.array(found)).to_batches()

    return task


class _Union:
    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _block_links(num: int, den: int) -> Callable:
    """Of a block: a spanning forest of the links between groups, from whole sets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, ["bucket", "i", "j"]):
            n = run.num_rows
            xs, ys = _sides(run)
            if n < 2 or not len(xs):
                continue
            ids, comps = run.column("id").to_pylist(), run.column("comp").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in run.column("set").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            first = np.concatenate(([0], np.flatnonzero(flat[1:] != flat[:-1]) + 1))
            length = np.diff(np.append(first, len(flat)))
            groups, a, b = _Union(), [], []
            other = np.zeros(n, bool)
            other[ys] = True
            for x in xs.tolist():
                at = first[np.searchsorted(flat[first], sets[x])]
                reach = length[np.searchsorted(first, at)]
                hits = owner[np.repeat(at - np.concatenate(([0], np.cumsum(reach)[:-1])), reach) + np.arange(reach.sum())]
                same = np.bincount(hits, minlength=n)
                for y in np.flatnonzero(other & (den * same >= num * (sizes[x] + sizes - same))).tolist():
                    if groups.join(comps[x], comps[y]):
                        a.append(min(ids[x], ids[y]))
                        b.append(max(ids[x], ids[y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return task


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: each node with its least partner."""
    groups = _Union()
    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            groups.join(x, y)
    nodes = [x for x in groups.up if groups.find(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([groups.find(x) for x in part], pa.int64()), pa.array(part, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (id, comp): the least id reachable from each linked id.

    Partitions shrink their links to forests by union-find, then rounds of large-star and small-star steps run until
    nothing changes; each round is stored in the shared folder. Only one count a round reaches the driver.
    """
    spark = edges.sparkSession
    path = shared_dir(spark)
    links = stored(edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long"), path)
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = salted_join(both.toDF("n", "v").where("v > n"), least, "n", "v").select(F.col("m").alias("a"), F.col("v").alias("b"))
        small = large.union(least.where("m < n").select("m", "n")).distinct()
        down = small.groupBy("b").agg(F.min("a").alias("m"))
        star = small.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        step = shared_dir(spark)
        new = stored(star, step)
        moved = new.exceptAll(links).union(links.exceptAll(new)).limit(1).count()
        removed(spark, path)
        links, path = new, step
        if not moved:
            return links.groupBy("b").agg(F.min("a").alias("comp")).select(F.col("b").alias("id"), "comp").union(links.select("a", "a").distinct())


def salted_join(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each ``key``; rows of one key are spread by a hash of ``by``.

    A fact goes only to the salts that rows of its key have, so it is copied no more often than it has rows.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    spread = rows.select(key, "_salt").distinct().join(facts, key)
    return rows.join(spread, [key, "_salt"]).drop("_salt")


def _with_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Deal the rows (bucket, id, comp, weight, ...) of buckets with several groups to blocks (i, j).

    Block (i, j) has the i-th part of the documents outside the bucket's largest group (``outer``) and the j-th part of all.
    A bucket of one part has each document once.
    """
    groups = rows.groupBy("bucket", "comp").agg(F.sum("weight").alias("w"))
    sizes = groups.groupBy("bucket").agg(F.sum("w").alias("all"), F.max(F.struct("w", "comp")).alias("top"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    parts = lambda w: F.ceil(w / block).cast("int")
    sizes = sizes.select("bucket", F.col("top.comp").alias("top"), parts(F.col("all")).alias("na"), parts(F.col("all") - F.col("top.w")).alias("nm"))
    dealt = salted_join(rows, sizes, "bucket", "id").withColumn("out", F.col("comp") != F.col("top"))
    place = lambda i, j, outer: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(outer).alias("outer"))
    own_i, own_j = F.pmod(F.xxhash64("id", F.lit(1)), F.col("nm")), F.pmod(F.xxhash64("id", F.lit(2)), F.col("na"))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("out").alias("outer")))
    inner = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda i: place(i, own_j, False))
    outer = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda j: place(own_i, j, True))
    places = F.when(F.col("na") == 1, one).when(F.col("out"), F.concat(inner, outer)).otherwise(inner)
    return dealt.withColumn("at", F.explode(places)).select("*", "at.*").drop("at", "out", "top", "na", "nm")


def near_duplicates(docs: DataFrame, *, k: int = 5, num: int = 4, den: int = 5, rows: int = ROWS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; documents are linked at Jaccard >= num/den on k-word shingles.

    With r = ``rows`` and b = ``bands``, a pair at similarity s is found with probability 1 - (1 - s^r)^b: 0.99997 at 0.8.
    """
    spark = docs.sparkSession
    paths = [shared_dir(spark) for _ in range(6)]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(docs.mapInArrow(_signed(k, rows, bands), "doc_id long, n_shingles long, set_key binary, marks binary, bands array<long>"))
    able = signed.where("doc_id is not null and n_shingles > 0")
    classes = stored(able.groupBy("set_key").agg(F.min("doc_id").alias("id")), paths[0])
    reps = able.alias("d").join(classes.alias("c"), (F.col("d.set_key") == F.col("c.set_key")) & (F.col("d.doc_id") == F.col("c.id")))
    reps = reps.groupBy("id").agg(F.first("n_shingles").alias("n_shingles"), F.first("marks").alias("marks"), F.first("bands").alias("bands"))
    reps = stored(reps, paths[1])
    dealt = reps.select("id", F.explode("bands").alias("bucket"))
    hubs = dealt.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "hub")
    members = stored(salted_join(dealt, hubs, "bucket", "id"), paths[2])
    full = docs.where("text is not null")

    def verified(pairs: DataFrame, at: str) -> DataFrame:
        marks = reps.select("id", "marks")
        near = salted_join(pairs, marks.toDF("a", "ma"), "a", "b").join(marks.toDF("b", "mb"), "b").select("a", "b", "ma", "mb")
        near = stored(near.mapInArrow(_agreeing(PLAUSIBLE), "a long, b long"))
        ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = stored(full.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_full_sets(k), "id long, set binary").dropDuplicates(["id"]), at)
        joined = salted_join(near, sets.toDF("a", "sa"), "a", "b").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
        return joined.mapInArrow(_linked(num, den), "a long, b long")

    stars = stored(verified(members.where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), paths[3]))
    removed(spark, paths[3])
    groups = stored(components(stars))
    comp = F.coalesce("comp", "id").alias("comp")
    left = members.select("bucket", "id").join(groups, "id", "left").select("bucket", "id", comp, F.lit(1.0).alias("weight"))
    marked = _with_blocks(left, block).join(reps.select("id", "marks"), "id")
    keys = ["bucket", "i", "j"]
    near = marked.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "outer", "id", "comp", "marks").mapInArrow(_plausible(PLAUSIBLE), "bucket long, id long").distinct()
    near = stored(near, paths[4])
    rest = full.join(near.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(_full_sets(k), "id long, set binary").dropDuplicates(["id"])
    rest = stored(rest, paths[5])
    # a block has about ``block`` documents at most, and fewer where they are long
    weight = (1 + F.col("n_shingles") * block / BLOCK_SHINGLES).alias("weight")
    found = near.join(groups, "id", "left").select("bucket", "id", comp).join(reps.select("id", weight), "id")
    blocks = _with_blocks(found, block).join(rest, "id").repartition(*keys).sortWithinPartitions(*keys).select(*keys, "outer", "id", "comp", "set")
    more = stored(blocks.mapInArrow(_block_links(num, den), "a long, b long"))
    final = stored(components(stars.union(more)))
    removed(spark, *paths[1:])
    of_class = classes.join(final, "id", "left").select("set_key", F.coalesce("comp", "id").alias("comp"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(of_class, "set_key", "left")
    # components of classes are least ids of representatives, which are the least ids of their classes
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, *, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their group; of equal rows one stays, and all rows with a null id stay."""
    kept = near_duplicates(docs, k=k, num=num, den=den).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))
