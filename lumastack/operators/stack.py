"""Samples (long) and pixels (wide): the transposition of a photo stack, and joins by position."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from .blocks import SIZE, Axis, Block, _blobs, _values, blockwise

CHANNELS = ("r", "g", "b")
#: Samples of a block in which pixels are put together.
GROUP = 1 << 18
#: Samples that a task packs at a time.
HELD = 1 << 19
#: Stands for a null place or light inside tasks.
NOWHERE = -(1 << 63)


def attach_lights(samples: DataFrame, lights: DataFrame) -> DataFrame:
    """Samples with the direction of their light; light tables are at most a thousand rows a dataset."""
    return samples.join(F.broadcast(lights.select("dataset", "light_id", "lx", "ly", "lz")), ["dataset", "light_id"])


def _squeezed(blobs: pa.Array) -> pa.Array:
    """Each blob by zstd, which finds what repeats anywhere in it; the shuffle's own codec looks at 32 KB at a time."""
    zstd = pa.Codec("zstd", 3)
    return pa.array([b if b is None else zstd.compress(b, asbytes=True) for b in blobs.to_pylist()], pa.binary())


def _whole(blobs: pa.Array) -> list[bytes | None]:
    return [b if b is None else pa.CompressedInputStream(pa.BufferReader(b), "zstd").read() for b in blobs.to_pylist()]


def _packed(side: int) -> Callable:
    """Samples of a task, packed: a row for each block of ``side`` pixels a side that they meet."""

    def pack(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        x, y, light = (table.column(c).fill_null(NOWHERE).to_numpy() for c in ("x", "y", "light_id"))
        coded = table.column("dataset").combine_chunks().dictionary_encode("encode")
        bx, by = x // side, y // side
        block = coded.indices.to_numpy().astype(np.int64)
        for v in (bx, by):
            found, at = np.unique(v, return_inverse=True)
            block = block * len(found) + at
        place = (y - by * side) * side + (x - bx * side)
        order = np.lexsort((light, place, block))
        block, place, light = block[order], place[order].astype(np.int32), light[order]
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        head = order[cut]
        if light.min() >= -(1 << 31) and light.max() < 1 << 31:
            light = light.astype(np.int32)
        out = [table.column("dataset").combine_chunks().take(pa.array(head)), pa.array(bx[head]), pa.array(by[head]), pa.array(np.diff(np.append(cut, len(order))).astype(np.int32))]
        blobs = [_blobs(place, cut), _blobs(light, cut)]
        missing = np.zeros(len(order), np.int32)  # a bit for each channel that is null
        for i, c in enumerate(CHANNELS):
            v = table.column(c)
            if v.null_count:
                missing |= v.is_null().to_numpy().astype(np.int32)[order] << i
            blobs.append(_blobs(v.fill_null(0.0).to_numpy()[order], cut))
        blobs.append(_blobs(missing, cut) if missing.any() else pa.nulls(len(cut), pa.binary()))
        out += map(_squeezed, blobs)
        return pa.RecordBatch.from_arrays(out, ["dataset", "_bx", "_by", "_n", "_place", "_light", *CHANNELS, "_missing"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield pack(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held))

    return task


def to_pixels(samples: DataFrame, n: int, *, incomplete: str = "drop") -> DataFrame:
    """One row a pixel with its n values a channel, in light order.

    A pixel that misses lights is dropped, or with ``incomplete="null"`` has nulls in their places. Of repeated samples of a
    light the largest (r, g, b) counts, in either case. Tasks pack samples by blocks of about ``GROUP`` samples before they are
    dealt out, and pixels are put together inside a block; so the shuffle has the bytes of the values, squeezed, and nothing a
    sample.
    """
    side = max(1, math.isqrt(GROUP // max(n, 1)))
    types = {f.name: f.dataType for f in samples.schema}
    kind = types["dataset"].simpleString()
    rows = samples.select("dataset", *(F.col(c).cast("long").alias(c) for c in ("x", "y", "light_id")), *(F.col(c).cast("double").alias(c) for c in CHANNELS))
    packed = rows.mapInArrow(_packed(side), f"dataset {kind}, _bx long, _by long, _n int, _place binary, _light binary, {', '.join(f'{c} binary' for c in CHANNELS)}, _missing binary")

    def one(dataset: pa.Array, bx: np.int64, by: np.int64, parts: pa.StructArray) -> pa.RecordBatch:
        lengths = parts.field("_n").to_pylist()
        place, light = (_values(_whole(parts.field(c)), lengths, "i") for c in ("_place", "_light"))
        values = [_values(_whole(parts.field(c)), lengths, "f") for c in CHANNELS]
        missing = None
        if parts.field("_missing").null_count < len(parts):
            missing = np.concatenate([np.zeros(k, np.int64) if b is None else _values([b], [k], "i") for b, k in zip(_whole(parts.field("_missing")), lengths, strict=True)])
        order = np.lexsort((light, place))
        same = (np.diff(place[order]) == 0) & (np.diff(light[order]) == 0)
        if same.any():  # of repeated samples the last counts: nulls come first
            known = [] if missing is None else [missing >> i & 1 == 0 for i in range(3)]
            keys = [k for i in (2, 1, 0) for k in ((values[i], known[i]) if known else (values[i],))]
            order = np.lexsort((*keys, light, place))
            order = order[np.append((np.diff(place[order]) != 0) | (np.diff(light[order]) != 0), True)]
        place, light = place[order], light[order]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        count = np.diff(np.append(first, len(place)))
        if incomplete == "drop":
            first = first[count == n]
            take = order[(first[:, None] + np.arange(n)).ravel()]
            there = None
        else:
            pixel = np.repeat(np.arange(len(first)), count)
            fits = (light >= 0) & (light < n)
            take, there = np.zeros(len(first) * n, np.int64), np.zeros(len(first) * n, bool)
            at = pixel[fits] * n + light[fits]
            take[at], there[at] = order[fits], True
        columns = []
        for i, v in enumerate(values):
            gone = None if there is None else ~there
            if missing is not None:
                absent = missing[take] >> i & 1 == 1
                gone = absent if gone is None else gone | absent
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * n, pa.int32()), pa.array(v[take], pa.float64(), mask=gone)))
        with np.errstate(over="ignore"):
            x, y = bx * side + place[first] % side, by * side + place[first] // side
        names = dataset.take(pa.array(np.zeros(len(first), np.int64)))
        return pa.RecordBatch.from_arrays([names, *(pa.array(v, pa.int64(), mask=v == NOWHERE) for v in (x, y)), *columns], ["dataset", "x", "y", *CHANNELS])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bx, by = (batch.column(c).to_numpy() for c in ("_bx", "_by"))
            for i in range(batch.num_rows):
                yield one(batch.column("dataset").slice(i, 1), bx[i], by[i], batch.column("parts")[i].values)

    # dealt out as they are: a task would only hold its parts back to collect them
    dealt = packed.repartition("dataset", "_bx", "_by").groupBy("dataset", "_bx", "_by")
    blocks = dealt.agg(F.collect_list(F.struct("_n", "_place", "_light", *CHANNELS, "_missing")).alias("parts"))
    pixels = blocks.mapInArrow(task, f"dataset {kind}, x long, y long, {', '.join(f'{c} array<double>' for c in CHANNELS)}")
    return pixels.select("dataset", *(F.col(c).cast(types[c]).alias(c) for c in ("x", "y")), *CHANNELS)


def to_samples(pixels: DataFrame) -> DataFrame:
    """The inverse of ``to_pixels``; null places give no row."""
    rows = pixels.select("dataset", "x", "y", F.posexplode(F.arrays_zip(*CHANNELS)).alias("light_id", "v"))
    return rows.where("v.r is not null").select("dataset", "light_id", "x", "y", *(F.col(f"v.{c}").alias(c) for c in CHANNELS))


def neighbours(df: DataFrame, offsets: list[tuple[int, int]], width: int, height: int, values: list[str], *, size: int = SIZE) -> DataFrame:
    """Each pixel with its neighbours at ``offsets``, clamped at the borders: (dataset, x, y, dx, dy, values).

    Blocks with halos are dealt out; neighbours are found inside them, so only one packed copy of a grid is shuffled.
    """
    reach = max((max(abs(dx), abs(dy)) for dx, dy in offsets), default=0)
    types = {f.name: f.dataType for f in df.schema}
    kept = {v: types[v].simpleString() if isinstance(types[v], IntegerType | LongType) else "double" for v in values}

    def kernel(block: Block) -> dict[str, object] | None:
        y, x = np.mgrid[block.y0 : block.y0 + block.h, block.x0 : block.x0 + block.w]
        here = block.known[y - block.at[1], x - block.at[0]]
        parts = []
        for dx, dy in offsets:
            gx, gy = np.clip(x + dx, 0, width - 1) - block.at[0], np.clip(y + dy, 0, height - 1) - block.at[1]
            hit = here & block.known[gy, gx]
            n = int(hit.sum())
            parts.append([x[hit].astype(np.int32), y[hit].astype(np.int32), np.full(n, dx, np.int32), np.full(n, dy, np.int32), *(block.values[v][gy[hit], gx[hit]] for v in values)])
        return dict(zip(("x", "y", "dx", "dy", *values), map(np.concatenate, zip(*parts, strict=True)), strict=True)) if parts else None

    schema = "x int, y int, dx int, dy int, " + ", ".join(f"`{v}` {t}" for v, t in kept.items())
    return blockwise(df, values, Axis.near(width, size, reach), Axis.near(height, size, reach), kernel, schema)


def grid_nodes(pixels: DataFrame, width: int, height: int, nx: int = 15, ny: int = 15) -> DataFrame:
    """Each pixel with its four surrounding nodes of an nx x ny grid: (dataset, x, y, node, weight)."""
    u, v = (nx - 1) * F.col("x") / width, (ny - 1) * F.col("y") / height
    i, j = F.least(F.floor(u), F.lit(nx - 2)).cast("int"), F.least(F.floor(v), F.lit(ny - 2)).cast("int")
    a, b = u - i, v - j
    corner = lambda di, dj, w: F.struct(((j + dj) * nx + i + di).cast("int").alias("node"), w.alias("weight"))
    four = F.array(corner(0, 0, (1 - a) * (1 - b)), corner(1, 0, a * (1 - b)), corner(0, 1, (1 - a) * b), corner(1, 1, a * b))
    return pixels.select("dataset", "x", "y", F.explode(four).alias("c")).select("dataset", "x", "y", "c.node", "c.weight")


def assign_tiles(df: DataFrame, width: int, height: int, side: int, overlap: int) -> DataFrame:
    """Each pixel with every tile that holds it; tile c spans [c * side - overlap, (c + 1) * side + overlap)."""

    def span(v: str, n: int):
        last = (n + side - 1) // side - 1
        lo = F.greatest(F.lit(0), F.floor((F.col(v) - overlap) / side)).cast("int")
        hi = F.least(F.lit(last), F.floor((F.col(v) + overlap) / side)).cast("int")
        return F.explode(F.sequence(lo, hi))

    return df.withColumn("col", span("x", width)).withColumn("row", span("y", height))
