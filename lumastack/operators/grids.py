"""Row-and-column passes over image grids: recursive Gaussian blur and two-dimensional Fourier transforms.

A pass groups a grid by its rows (or columns), whose length the image bounds, and hands each to NumPy; between the passes
lies one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def along(df: DataFrame, axis: str, values: list[str], line: Callable[[np.ndarray, int], np.ndarray], out: list[str] | None = None) -> DataFrame:
    """Apply ``line`` (values x length, line number -> outputs x length') to every row (axis "x") or column (axis "y")."""
    other = "y" if axis == "x" else "x"
    names = out or values

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(axis)
        at = int(pdf[other].iloc[0])
        got = line(pdf[values].to_numpy(float).T, at)
        return pd.DataFrame({"dataset": pdf["dataset"].iloc[0], axis: np.arange(got.shape[1]), other: at, **dict(zip(names, got, strict=True))})[["dataset", "x", "y", *names]]

    schema = "dataset string, x int, y int, " + ", ".join(f"{c} double" for c in names)
    return df.select("dataset", "x", "y", *values).groupBy("dataset", other).applyInPandas(group, schema)


def gaussian_coefficients(sigma: float) -> tuple[float, float, float, float]:
    """(gain, b1, b2, b3) of the third-order recursive Gaussian."""
    q = 0.98711 * sigma - 0.96330 if sigma >= 2.5 else 3.97156 - 4.14554 * np.sqrt(1 - 0.26891 * sigma)
    b0 = 1.57825 + 2.44413 * q + 1.4281 * q**2 + 0.422205 * q**3
    b1, b2, b3 = (2.44413 * q + 2.85619 * q**2 + 1.26661 * q**3) / b0, -(1.4281 * q**2 + 1.26661 * q**3) / b0, 0.422205 * q**3 / b0
    return 1 - (b1 + b2 + b3), b1, b2, b3


def _recursive(v: np.ndarray, sigma: float) -> np.ndarray:
    gain, b1, b2, b3 = gaussian_coefficients(sigma)
    for _ in range(2):
        out = np.empty_like(v)
        p1 = p2 = p3 = v[:, 0].copy()
        for i in range(v.shape[1]):
            now = gain * v[:, i] + b1 * p1 + b2 * p2 + b3 * p3
            out[:, i] = now
            p1, p2, p3 = now, p1, p2
        v = out[:, ::-1]
    return v


def gaussian_blur(df: DataFrame, values: list[str], sigma: float) -> DataFrame:
    """Forward and backward along rows, then along columns; below sigma 0.5 nothing changes."""
    if sigma < 0.5:
        return df.select("dataset", "x", "y", *values)
    line = lambda v, _: _recursive(v, sigma)
    return along(along(df, "x", values, line), "y", values, line)


def fft2(df: DataFrame, pairs: list[tuple[str, str]], pad: Callable[[np.ndarray, bool], np.ndarray] | None = None, inverse: bool = False, finish: Callable | None = None) -> DataFrame:
    """The 2-D transform of complex fields given as (real, imaginary) columns; ``pad`` lengthens lines (values, along rows?).

    ``finish`` may change a column's spectrum before it leaves the second pass: (fields, x) -> fields.
    """
    names = [c for p in pairs for c in p]
    transform = np.fft.ifft if inverse else np.fft.fft

    def line(rows: bool) -> Callable:
        def apply(v: np.ndarray, at: int) -> np.ndarray:
            if pad:
                v = pad(v, rows)
            z = transform(v[0::2] + 1j * v[1::2], axis=1)
            if finish and not rows:
                z = finish(z, at)
            out = np.empty((2 * len(z), z.shape[1]))
            out[0::2], out[1::2] = z.real, z.imag
            return out

        return apply

    return along(along(df, "x", names, line(True)), "y", names, line(False))
