"""Light bases as column expressions: the weights of a light direction in each reflectance basis."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def ptm_weights(lx: Column, ly: Column, n: int) -> Column:
    """The first ``n`` monomials of two variables by degree: 1, x, y, xx, xy, yy, xxx, ..."""
    terms, degree = [], 0
    while len(terms) < n:
        for k in range(degree + 1):
            term = F.lit(1.0)
            for _ in range(degree - k):
                term = term * lx
            for _ in range(k):
                term = term * ly
            terms.append(term)
        degree += 1
    return F.array(*terms[:n])


def hsh_weights(lx: Column, ly: Column, lz: Column, n: int = 9) -> Column:
    """Hemispherical harmonics up to the second order; the elevation stays 0.01 above the horizon."""
    phi = F.atan2(ly, lx)
    phi = F.when(phi < 0, phi + 2 * PI).otherwise(phi)
    c = F.cos(F.least(F.acos(F.greatest(F.lit(-1.0), F.least(lz, F.lit(1.0)))), F.lit(PI / 2 - 0.01)))
    s = F.sqrt(F.greatest(c - c * c, F.lit(0.0)))
    terms = [
        F.lit(1 / math.sqrt(2 * PI)), math.sqrt(6 / PI) * F.cos(phi) * s, math.sqrt(3 / (2 * PI)) * (2 * c - 1), math.sqrt(6 / PI) * F.sin(phi) * s,
        math.sqrt(30 / PI) * F.cos(2 * phi) * (c * c - c), math.sqrt(30 / PI) * F.cos(phi) * (2 * c - 1) * s, math.sqrt(5 / (2 * PI)) * (1 - 6 * c + 6 * c * c),
        math.sqrt(30 / PI) * F.sin(phi) * (2 * c - 1) * s, math.sqrt(30 / PI) * F.sin(2 * phi) * (c * c - c),
    ]
    return F.array(*terms[:n])


def sh_weights(lx: Column, ly: Column, lz: Column, n: int = 9) -> Column:
    """Real spherical harmonics up to the second order."""
    phi, ct = F.atan2(ly, lx), F.greatest(F.lit(-1.0), F.least(lz, F.lit(1.0)))
    st = F.sqrt(1 - ct * ct)
    a, b = 0.5 * math.sqrt(3 / PI), math.sqrt(15 / PI)
    terms = [
        F.lit(1 / (2 * math.sqrt(PI))), a * F.sin(phi) * st, a * ct, a * F.cos(phi) * st, 0.25 * b * F.sin(2 * phi) * st * st, 0.5 * b * st * ct * F.sin(phi),
        0.25 * math.sqrt(5 / PI) * (3 * ct * ct - 1), 0.5 * b * st * ct * F.cos(phi), 0.25 * b * st * st * F.cos(2 * phi),
    ]
    return F.array(*terms[:n])


def to_octa(x: Column, y: Column, z: Column, res: int) -> tuple[Column, Column]:
    """Where a direction falls on the ``res`` x ``res`` octahedral grid."""
    s = F.abs(x) + F.abs(y) + F.abs(z)
    inside = lambda v: F.greatest(F.lit(0.0), F.least(v, F.lit(float(res - 1))))
    return inside(((x + y) / s + 1) / 2 * (res - 1)), inside(((y - x) / s + 1) / 2 * (res - 1))


def from_octa(i: Column, j: Column, res: int) -> tuple[Column, Column, Column]:
    """The direction of a node of the octahedral grid."""
    o, p = 2.0 * i / (res - 1) - 1, 2.0 * j / (res - 1) - 1
    x, y = (o - p) / 2, (o + p) / 2
    z = F.greatest(F.lit(0.0), 1 - F.abs(x) - F.abs(y))
    n = F.sqrt(x * x + y * y + z * z)
    return x / n, y / n, z / n


def bilinear_weights(lx: Column, ly: Column, lz: Column, res: int) -> Column:
    """The four grid nodes around a direction with their weights: array of (node, weight)."""
    u, v = to_octa(lx, ly, lz, res)
    i, j = F.least(F.floor(u), F.lit(res - 2)).cast("int"), F.least(F.floor(v), F.lit(res - 2)).cast("int")
    a, b = u - i, v - j
    corner = lambda di, dj, w: F.struct(((j + dj) * res + i + di).cast("int").alias("node"), w.alias("weight"))
    return F.array(corner(0, 0, (1 - a) * (1 - b)), corner(1, 0, a * (1 - b)), corner(0, 1, (1 - a) * b), corner(1, 1, a * b))
