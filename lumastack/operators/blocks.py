"""Blocked rasters: pixels packed into arrays of a block with its halo, and work inside a block.

``blockwise`` deals the pixels of a grid to blocks of outputs. A task first packs what goes to one block into a row (runs of
places, flat values), and a pixel is sent twice only where it lies in another block's halo; so about one packed copy of a
grid crosses the network, whatever the reach of the work. A block is a group, of ``size`` pixels a side and its halo, so no
group grows with an image. Its kernel sees flat arrays and gives a row a pixel, or whatever rows it likes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructType

SIZE = 256
#: Rows that a task packs at a time.
PACKED = 400_000


@dataclass(frozen=True)
class Axis:
    """Outputs 0 to ``length`` - 1 in blocks of ``size``; block b reads the sources ``low[b]`` to ``high[b]``, of ``source`` in all."""

    length: int
    size: int
    source: int
    low: np.ndarray
    high: np.ndarray
    used: np.ndarray | None = None  # flags of the sources that any output reads; all if None

    @staticmethod
    def reading(length: int, size: int, source: int, reads: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], used: np.ndarray | None = None) -> Axis:
        """``reads`` gives the first and last source of outputs (first, last); both must not fall along the axis."""
        first = np.arange(0, max(length, 1), size)
        low, high = reads(first, np.minimum(first + size, length) - 1)
        return Axis(length, size, source, np.clip(np.floor(low), 0, source - 1).astype(np.int64), np.clip(np.ceil(high), 0, source - 1).astype(np.int64), used)

    @staticmethod
    def near(length: int, size: int, reach: int) -> Axis:
        """Outputs and sources are the same grid; each output reads ``reach`` to both sides."""
        return Axis.reading(length, size, length, lambda a, b: (a - reach, b + reach))


@dataclass
class Block:
    """A block of outputs (col, row; x0, y0, w, h) with its sources: ``at`` (left, top), ``values`` (name -> array) and ``known``."""

    keys: dict[str, object]
    col: int
    row: int
    x0: int
    y0: int
    w: int
    h: int
    at: tuple[int, int]
    values: dict[str, np.ndarray]
    known: np.ndarray

    def pixels(self, columns: dict[str, np.ndarray], where: np.ndarray | None = None) -> dict[str, object]:
        """A row for each output (or for those of ``where``): its place and ``columns``."""
        y, x = np.mgrid[self.y0 : self.y0 + self.h, self.x0 : self.x0 + self.w]
        pick = (lambda v: v.ravel()) if where is None else (lambda v: v[where])
        return {"x": pick(x).astype(np.int32), "y": pick(y).astype(np.int32), **{k: pick(v) for k, v in columns.items()}}


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def _touched(axis: Axis, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block that reads each source, and how many do."""
    first = np.searchsorted(axis.high, v, "left")
    many = np.maximum(np.searchsorted(axis.low, v, "right") - first, 0)
    inside = (v >= 0) & (v < axis.source)
    if axis.used is not None:
        inside[inside] = axis.used[v[inside]]
    return first, np.where(inside, many, 0)


def _blobs(flat: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The values of each block as bytes: one a value where all lie in 0 to 255, else four or eight."""
    if flat.dtype.kind == "i" and (not len(flat) or (flat.min() >= 0 and flat.max() < 256)):
        flat = flat.astype(np.uint8)
    ends = np.append(cut, len(flat)) * flat.itemsize
    if ends[-1] >= 2**31:
        return pa.array([flat[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(flat)), strict=True)], pa.binary())
    return pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _values(blobs: list[bytes], lengths: list[int], kind: str) -> np.ndarray:
    types = {1: np.uint8, 4: np.int32, 8: np.int64 if kind == "i" else np.float64}
    return np.concatenate([np.frombuffer(b, types[len(b) // n]).astype(types[8]) for b, n in zip(blobs, lengths, strict=True)])


def _packing(keys: list[str], values: list[str], xs: Axis, ys: Axis) -> Callable:
    def pack(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        x, y = (table.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        code = np.zeros(len(x), np.int64)
        for k in keys:
            coded = table.column(k).combine_chunks().dictionary_encode("encode")
            code = np.unique(code * (len(coded.dictionary) + 1) + coded.indices.to_numpy(), return_inverse=True)[1]
        col, nx = _touched(xs, x)
        row, ny = _touched(ys, y)
        if (nx == 1).all() and (ny == 1).all():
            of = np.arange(len(x))
        else:
            of, step = np.repeat(np.arange(len(x)), nx * ny), _ranges(np.zeros(len(x), np.int64), nx * ny)
            col, row = col[of] + step % np.maximum(nx[of], 1), row[of] + step // np.maximum(nx[of], 1)
        place = (y[of] - ys.low[row]) * (xs.high - xs.low + 1)[col] + x[of] - xs.low[col]
        group = (code[of] * len(ys.low) + row) * len(xs.low) + col
        if len(of) and ((group[1:] < group[:-1]) | ((group[1:] == group[:-1]) & (place[1:] < place[:-1]))).any():
            order = np.lexsort((place, group))
            of, col, row, place, group = of[order], col[order], row[order], place[order], group[order]
        fresh = np.ones(len(of), bool)
        fresh[1:] = group[1:] != group[:-1]
        cut = np.flatnonzero(fresh)
        run = np.flatnonzero(fresh | np.append(True, place[1:] != place[:-1] + 1)[: len(of)])
        runs = np.column_stack((place[run], np.diff(np.append(run, len(of))))).astype(np.int32).ravel()
        listed = lambda flat, at: pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)).astype(np.int32)), flat)
        head = pa.array(of[cut])
        out = [table.column(k).combine_chunks().take(head) for k in keys]
        out += [pa.array(col[cut].astype(np.int32)), pa.array(row[cut].astype(np.int32)), listed(pa.array(runs), 2 * np.searchsorted(run, cut))]
        out += [pa.array(np.diff(np.append(cut, len(of))).astype(np.int32))]
        out += [_blobs(table.column(v).to_numpy()[of], cut) for v in values]
        return pa.RecordBatch.from_arrays(out, [*keys, "_col", "_row", "_runs", "_n", *values])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield pack(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held))

    return task


def blockwise(df: DataFrame, values: list[str], xs: Axis, ys: Axis, kernel: Callable[[Block], dict[str, object] | None], schema: str, *, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Run ``kernel`` on every block that has a source pixel of ``df`` (keys, x, y, values; numeric): (keys, ``schema``).

    Null integers are 0, other nulls not a number. A pixel that occurs twice counts once, any of the two. The kernel's columns have equal
    lengths and the order and types of ``schema``.
    """
    keys, spark_types = list(keys), {f.name: f.dataType for f in df.schema}
    kept, kinds = list(values), {v: "i" if isinstance(spark_types[v], IntegerType | LongType) else "f" for v in values}
    cast = [df[v].cast("double") if kinds[v] == "f" else F.coalesce(df[v], F.lit(0).cast(spark_types[v])) for v in kept]
    rows = df.select(*keys, df["x"].cast("int").alias("x"), df["y"].cast("int").alias("y"), *(c.alias(v) for c, v in zip(cast, kept, strict=True)))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = [f"`{k}` {types[k]}" for k in keys]
    packed = rows.mapInArrow(_packing(keys, kept, xs, ys), ", ".join([*fields, "_col int, _row int, _runs array<int>, _n int", *(f"`{v}` binary" for v in kept)]))
    out = StructType.fromDDL(", ".join([*fields, schema]))
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])

    def one(key: tuple, table: pa.Table) -> pa.Table:
        col, row = int(key[-2].as_py()), int(key[-1].as_py())
        w, h = (int(a.high[i] - a.low[i] + 1) for a, i in ((xs, col), (ys, row)))
        flat = lambda c: table.column(c).combine_chunks().flatten()
        runs = flat("_runs").to_numpy().reshape(-1, 2).astype(np.int64)
        at = _ranges(runs[:, 0], runs[:, 1])
        known = np.zeros(w * h, bool)
        known[at] = True
        arrays, lengths = {}, table.column("_n").to_pylist()
        for v in kept:
            got = _values(table.column(v).to_pylist(), lengths, kinds[v])
            arrays[v] = np.zeros(w * h, got.dtype)
            arrays[v][at] = got
            arrays[v] = arrays[v].reshape(h, w)
        x0, y0 = col * xs.size, row * ys.size
        named = {k: v.as_py() for k, v in zip(keys, key, strict=False)}
        block = Block(named, col, row, x0, y0, min(xs.size, xs.length - x0), min(ys.size, ys.length - y0), (int(xs.low[col]), int(ys.low[row])), arrays, known.reshape(h, w))
        got = kernel(block)
        if got is None:
            return arrow.empty_table()
        n = len(next(iter(got.values())))
        columns = [pa.repeat(k.cast(arrow.field(i).type), n) for i, k in enumerate(key[:-2])]
        columns += [v if isinstance(v, pa.Array) else pa.array(v, arrow.field(c).type) for c, v in got.items()]
        return pa.Table.from_arrays(columns, schema=arrow)

    return packed.groupBy(*keys, "_col", "_row").applyInArrow(one, out)


def stencil(df: DataFrame, values: list[str], width: int, height: int, reach: int, kernel: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], out: str, *, size: int = SIZE, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """A row for each pixel of ``df``: ``kernel`` (values, known) -> columns.

    It sees arrays with a frame of ``reach`` pixels on all sides, which repeats the grid's border outside of it, and gives
    arrays without the frame.
    """

    def one(block: Block) -> dict[str, object] | None:
        x = np.clip(np.arange(block.x0 - reach, block.x0 + block.w + reach), 0, width - 1) - block.at[0]
        y = np.clip(np.arange(block.y0 - reach, block.y0 + block.h + reach), 0, height - 1) - block.at[1]
        framed = np.ix_(y, x)
        known = block.known[framed]
        here = known[reach : reach + block.h, reach : reach + block.w]
        return block.pixels(kernel({k: v[framed] for k, v in block.values.items()}, known), here) if here.any() else None

    return blockwise(df, values, Axis.near(width, size, reach), Axis.near(height, size, reach), one, f"x int, y int, {out}", keys=keys)


def shifted(a: np.ndarray, reach: int, dx: int, dy: int) -> np.ndarray:
    """A framed array without its frame, each place holding its neighbour at (dx, dy)."""
    h, w = a.shape[0] - 2 * reach, a.shape[1] - 2 * reach
    return a[reach + dy : reach + dy + h, reach + dx : reach + dx + w]


def bilinear(block: Block, sx: np.ndarray, sy: np.ndarray, width: int, height: int, values: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Values at real source positions from their four clamped corners, and which have one; unknown corners add nothing."""
    fx, fy = np.floor(sx), np.floor(sy)
    ax, ay = sx - fx, sy - fy
    out, any_known = {v: np.zeros(sx.shape) for v in values}, np.zeros(sx.shape, bool)
    for dx, dy, w in ((0, 0, (1 - ax) * (1 - ay)), (1, 0, ax * (1 - ay)), (0, 1, (1 - ax) * ay), (1, 1, ax * ay)):
        gx = np.clip(fx + dx, 0, width - 1).astype(np.int64) - block.at[0]
        gy = np.clip(fy + dy, 0, height - 1).astype(np.int64) - block.at[1]
        inside = (gx >= 0) & (gy >= 0) & (gx < block.known.shape[1]) & (gy < block.known.shape[0])
        gx, gy = np.where(inside, gx, 0), np.where(inside, gy, 0)
        hit = inside & block.known[gy, gx]
        any_known |= hit
        for v in values:
            out[v] += np.where(hit, w * block.values[v][gy, gx], 0)
    return out, any_known
