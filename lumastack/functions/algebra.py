"""Small dense algebra: on the driver over aggregated matrices of a few hundred rows, or batched over pixels in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinv(a: np.ndarray) -> np.ndarray:
    """(A'A)^-1 A', or by singular values where A'A is singular."""
    gram = a.T @ a
    if np.linalg.matrix_rank(gram) == gram.shape[0]:
        return np.linalg.solve(gram, a.T)
    return np.linalg.pinv(a)


def stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length lists as a matrix: one view of their flat values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if len(values) % n or column.null_count or (np.diff(column.offsets.to_numpy()) != len(values) // n).any():
        raise ValueError("lists of unequal lengths")
    return values.reshape(n, -1)


def listed(v: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    n, d = v.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d) if d else np.zeros(n + 1), pa.int32()), pa.array(np.ascontiguousarray(v, float).ravel()))


def matmul(columns: list[str], matrix: np.ndarray, shift: np.ndarray | None = None) -> Column:
    """The rows' lists end to end, less ``shift``, times ``matrix`` (inputs x outputs): array<double>."""

    @F.arrow_udf("array<double>")
    def apply(*parts: pa.Array) -> pa.Array:
        if not len(parts[0]):
            return pa.array([], pa.list_(pa.float64()))
        v = np.hstack([stacked(p) for p in parts])
        return listed((v if shift is None else v - shift) @ matrix)

    return apply(*columns)


def grams(df: DataFrame, columns: list[str], rows_of: Callable[..., np.ndarray]) -> dict:
    """Of each dataset (n, sums, second moments) of the rows that ``rows_of(dataset, *matrices)`` makes of its lists.

    A task sums a small matrix for each dataset that it meets, Spark adds these up, and only the sums reach the driver.
    """

    def task(batches):
        kept: dict = {}
        for batch in batches:
            for name, part in by_dataset(batch):
                v = rows_of(name, *(stacked(part.column(c)) for c in columns))
                n, total, second = kept.get(name, (0, 0.0, 0.0))
                kept[name] = n + len(v), total + v.sum(axis=0), second + v.T @ v
        for name, (n, total, second) in kept.items():
            d = len(total)
            i, j = np.divmod(np.arange(d * d), d)
            cells = [np.concatenate((i, np.full(d, -1), [-2])), np.concatenate((j, np.arange(d), [0])), np.concatenate((second.ravel(), total, [float(n)]))]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells[0]), pa.string()), pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int32()), pa.array(cells[2], pa.float64())], ["dataset", "i", "j", "v"])

    out: dict = {}
    for c in df.select("dataset", *columns).mapInArrow(task, "dataset string, i int, j int, v double").groupBy("dataset", "i", "j").agg(F.sum("v").alias("v")).collect():
        out.setdefault(c["dataset"], []).append(c)
    for name, cells in out.items():
        d = 1 + max(c["j"] for c in cells if c["i"] == -1)
        n, total, second = 0.0, np.zeros(d), np.zeros((d, d))
        for c in cells:
            if c["i"] == -2:
                n = c["v"]
            elif c["i"] == -1:
                total[c["j"]] = c["v"]
            else:
                second[c["i"], c["j"]] = c["v"]
        out[name] = n, total, second
    return out


def gram(df: DataFrame, columns: list[str], shift: float = 0.0) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, sums, second moments) of all rows' lists end to end, less ``shift``."""
    found = grams(df.select(F.lit("all").alias("dataset"), *columns), columns, lambda _, *v: np.hstack(v) - shift)
    return found.get("all", (0.0, np.zeros(0), np.zeros((0, 0))))


def by_dataset(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Table]]:
    """The rows of each dataset in a batch."""
    if batch.num_rows:
        names = batch.column("dataset").dictionary_encode(null_encoding="encode")
        codes = names.indices.to_numpy()
        for i, name in enumerate(names.dictionary.to_pylist()):
            yield name, pa.Table.from_batches([batch]).filter(pa.array(codes == i))


def sorted_eigh(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues descending and unit columns whose largest entry is positive."""
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


def normal_rows(part: pa.RecordBatch | pa.Table, n: np.ndarray) -> pa.RecordBatch:
    """(dataset, x, y) of ``part`` with the rows of ``n`` as nx, ny, nz."""
    keys = [part.column(c) for c in ("dataset", "x", "y")]
    keys = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in keys]
    return pa.RecordBatch.from_arrays([*keys, *(pa.array(np.ascontiguousarray(c)) for c in n.T)], ["dataset", "x", "y", "nx", "ny", "nz"])


NORMALS = "dataset string, x int, y int, nx double, ny double, nz double"


def batched(pixels: DataFrame, solve: Callable[[np.ndarray], np.ndarray], columns: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Normals (dataset, x, y, nx, ny, nz) of ``solve``, which takes the grays of a batch of pixels, a row each."""

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                yield normal_rows(batch, solve(sum(stacked(batch.column(c)) for c in columns) / len(columns)))

    return pixels.select("dataset", "x", "y", *columns).mapInArrow(task, NORMALS)
