"""Colour conversions and gray values as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]

# Linear RGB to XYZ (D65) of the two gamuts, and the reverse of the first.
SRGB_TO_XYZ = [[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]
P3_TO_XYZ = [[0.4865709, 0.2656677, 0.1982173], [0.2289746, 0.6917385, 0.0792869], [0.0000000, 0.0451134, 1.0439444]]


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> Triple:
    """On [0, 1], chroma around 0.5."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return y, (b - y) / 1.772 + 0.5, (r - y) / 1.402 + 0.5


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Triple:
    r, b = y + 1.402 * (cr - 0.5), y + 1.772 * (cb - 0.5)
    return r, (y - 0.299 * r - 0.114 * b) / 0.587, b


def to_ycc(r: Column, g: Column, b: Column) -> Triple:
    """Luma and two chroma differences by lifting."""
    co = r - b
    t = b + co / 2
    cg = g - t
    return t + cg / 2, co, cg


def ycc_to_rgb(y: Column, co: Column, cg: Column) -> Triple:
    t = y - cg / 2
    g = cg + t
    b = t - co / 2
    return b + co, g, b


def gray(r: Column, g: Column, b: Column, mode: str = "mean") -> Column:
    """The mean, or the integer gray (11 r + 16 g + 5 b) / 32."""
    if mode == "mean":
        return (r + g + b) / 3
    return F.floor((11 * r.cast("int") + 16 * g.cast("int") + 5 * b.cast("int")) / 32).cast("int")


def to_linear(v: Column) -> Column:
    """The sRGB transfer curve undone, on [0, 1]."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((F.greatest(v, F.lit(0.0)) + 0.055) / 1.055, F.lit(2.4)))


def from_linear(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


@dataclass(frozen=True)
class Profile:
    """A matrix and curve profile: the rows that take linear r, g, b to XYZ, and the exponent of the curve (None: that of sRGB)."""

    to_xyz: tuple[tuple[float, ...], ...]
    gamma: float | None = None

    def linear(self, v: Column) -> Column:
        return to_linear(v) if self.gamma is None else v if self.gamma == 1 else F.pow(F.greatest(v, F.lit(0.0)), F.lit(self.gamma))

    def coded(self, v: Column) -> Column:
        return from_linear(v) if self.gamma is None else v if self.gamma == 1 else F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / self.gamma))


def _rows(m) -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(map(float, r)) for r in m)


PROFILES = {"srgb": Profile(_rows(SRGB_TO_XYZ)), "linear-srgb": Profile(_rows(SRGB_TO_XYZ), 1.0), "display-p3": Profile(_rows(P3_TO_XYZ))}


def convert(r: Column, g: Column, b: Column, source: str | Profile, target: str | Profile) -> Triple:
    """8-bit samples from one space (a name of ``PROFILES`` or a profile) to another, quantised again; the same space is left."""
    if source == target:
        return r, g, b
    a, z = (PROFILES[p] if isinstance(p, str) else p for p in (source, target))
    rgb = [a.linear(c / 255.0) for c in (r, g, b)]
    m = (np.linalg.inv(np.array(z.to_xyz)) @ np.array(a.to_xyz)).tolist()
    rgb = [z.coded(w[0] * rgb[0] + w[1] * rgb[1] + w[2] * rgb[2]) for w in m]
    return tuple(F.greatest(F.lit(0.0), F.least(F.round(c * 255.0), F.lit(255.0))) for c in rgb)
