"""Heights from normals: Fourier integration, bilateral least squares in overlapping blocks, and a tiled solve on a scaffold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..shared import removed, shared_dir, stored
from .blocks import Axis, Block, blockwise
from .grids import fft2
from .normals import resize_grid, resize_normals

TILE, PAD, LAMBDA = 512, 32, 0.05
#: Weights that differ by no more than this are solved for as even ones first.
SPREAD = 100.0


def integrate_fft(normals: DataFrame, width: int, height: int, scale: str = "true") -> DataFrame:
    """Frankot-Chellappa integration of p = nx / nz, q = -ny / nz on a grid mirrored with changed sign by half its short side."""
    k = min(width, height) // 2
    p = normals.select("dataset", "x", "y", (F.col("nx") / F.col("nz")).alias("pr"), F.lit(0.0).alias("pi"), (-F.col("ny") / F.col("nz")).alias("qr"), F.lit(0.0).alias("qi"))

    def pad(v: np.ndarray, rows: bool) -> np.ndarray:
        n = v.shape[1]
        sides = [v[:, :k][:, ::-1].copy(), v[:, n - k :][:, ::-1].copy()]
        for s in sides:  # the slope along the line changes its sign in the mirror
            s[0 if rows else 2 :: 4] *= -1
            s[1 if rows else 3 :: 4] *= -1
        return np.hstack([sides[0], v, sides[1]])

    w, h = width + 2 * k, height + 2 * k

    def solve(z: np.ndarray, x: int) -> np.ndarray:
        wx, wy = np.fft.fftfreq(w)[x], np.fft.fftfreq(h)
        out = (-1j * wx * z[0] - 1j * wy * z[1]) / (wx * wx + wy * wy + 1e-12)
        return np.stack([out, np.zeros_like(out)])

    spectrum = fft2(p, [("pr", "pi"), ("qr", "qi")], pad=pad, finish=solve).select("dataset", "x", "y", "pr", "pi")
    back = fft2(spectrum, [("pr", "pi")], inverse=True)
    gain = 1 / (4 * np.sqrt(2)) if scale == "compat" else 1 / (2 * np.pi)
    inside = back.where((F.col("x") >= k) & (F.col("x") < k + width) & (F.col("y") >= k) & (F.col("y") < k + height))
    return inside.select("dataset", (F.col("x") - k).cast("int").alias("x"), (F.col("y") - k).cast("int").alias("y"), (F.col("pr") * float(gain)).alias("z"))


def _slopes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and slopes of the steps to the right and down of a field (h, w, 3): z(x+1) - z(x) = -nx / nz, image y down."""
    nz = np.maximum(np.abs(n[..., 2]), 1e-6)
    return nz, -n[..., 0] / nz, n[..., 1] / nz


def side_weights(z: np.ndarray, nz: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the sides (left, right) and (up, down) of every pixel, which add up to 1.

    They are logistics of the difference of the squared depth steps nz * (z(x+1) - z(x)) and nz * (z(x) - z(x-1)), without
    the slopes that the normals want; the side with the larger step counts less. A step over the border is 0.
    """
    right, left, down, up = (np.zeros(z.shape) for _ in range(4))
    right[:, :-1], left[:, 1:] = nz[:, :-1] * (z[:, 1:] - z[:, :-1]), nz[:, 1:] * (z[:, 1:] - z[:, :-1])
    down[:-1], up[1:] = nz[:-1] * (z[1:] - z[:-1]), nz[1:] * (z[1:] - z[:-1])
    sig = lambda t: 1 / (1 + np.exp(-np.clip(k * t, -50, 50)))
    return np.stack([sig(right**2 - left**2), sig(left**2 - right**2)]), np.stack([sig(down**2 - up**2), sig(up**2 - down**2)])


def _edges(wx: np.ndarray, wy: np.ndarray, nz: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weight, and weight times slope, of each step to the right and of each step down."""
    a, b = wx[1, :, :-1] * nz[:, :-1] ** 2, wx[0, :, 1:] * nz[:, 1:] ** 2
    c, d = wy[1, :-1] * nz[:-1] ** 2, wy[0, 1:] * nz[1:] ** 2
    return a + b, a * p[:, :-1] + b * p[:, 1:], c + d, c * q[:-1] + d * q[1:]


def _poured(fx: np.ndarray, fy: np.ndarray) -> np.ndarray:
    """What flows over the steps, added at their ends and taken at their starts."""
    out = np.zeros((fx.shape[0], fy.shape[1]))
    out[:, 1:] += fx
    out[:, :-1] -= fx
    out[1:] += fy
    out[:-1] -= fy
    return out


@lru_cache(maxsize=16)
def _modes(n: int, low: bool, high: bool) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors (columns) and eigenvalues of unit steps along ``n`` pixels, held beyond the first, the last, both or neither."""
    i, j = np.arange(n)[:, None], np.arange(n)[None]
    if low and high:
        angle = np.pi * (j + 1) / (n + 1)
        v = np.sin(angle * (i + 1))
    else:
        angle = np.pi * (j + 0.5) / (n + 0.5) if low or high else np.pi * j / n
        v = np.cos(angle * (i + 0.5))
        v = v[::-1] if low else v
    return np.ascontiguousarray(v / np.sqrt((v * v).sum(axis=0))), 2 - 2 * np.cos(angle[0])


def _even(edges: tuple[np.ndarray, ...], free: np.ndarray, strength: float) -> Callable[[np.ndarray], np.ndarray] | None:
    """The inverse of the stencil with the mean weights, on the rectangle of free pixels; None if the weights differ too much."""
    ys, xs = np.flatnonzero(free.any(axis=1)), np.flatnonzero(free.any(axis=0))
    if not len(ys) or not free[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1].all():
        return None
    y, x = slice(ys[0], ys[-1] + 1), slice(xs[0], xs[-1] + 1)
    used = edges[0][y, max(x.start - 1, 0) : x.stop], edges[2][max(y.start - 1, 0) : y.stop, x]
    weights = [e for e in used if e.size]
    if not weights or max(e.max() for e in weights) > SPREAD * min(e.min() for e in weights):
        return None
    mx, my = (float(e.mean()) if e.size else 0.0 for e in used)
    (vx, lx), (vy, ly) = _modes(len(xs), bool(x.start), x.stop < free.shape[1]), _modes(len(ys), bool(y.start), y.stop < free.shape[0])
    values = my * ly[:, None] + mx * lx[None] + strength
    inverse = np.where(values > 1e-14 * values.max(), 1 / np.maximum(values, 1e-300), 0)  # a constant is left alone if nothing holds it

    def solve(r: np.ndarray) -> np.ndarray:
        out = np.zeros(r.shape)
        out[y, x] = vy @ (inverse * (vy.T @ r[y, x] @ vx)) @ vx.T
        return out

    return solve


def _relaxed(z: np.ndarray, edges: tuple[np.ndarray, ...], steps: int, pull: np.ndarray | None = None, strength: float = 0.0, free: np.ndarray | None = None) -> np.ndarray:
    """Least-squares heights by conjugate gradients on the stencil; only ``free`` pixels move.

    The preconditioner is the stencil with even weights, or its diagonal where weights differ by more than ``SPREAD``.
    """
    ex, fx, ey, fy = edges
    free = np.ones(z.shape, bool) if free is None else free
    diagonal = np.zeros(z.shape) + (strength if pull is not None else 0)
    diagonal[:, 1:] += ex
    diagonal[:, :-1] += ex
    diagonal[1:] += ey
    diagonal[:-1] += ey
    scale = np.where(free, 1 / np.maximum(diagonal, 1e-300), 0)
    near = _even(edges, free, strength if pull is not None else 0.0) or (lambda v: scale * v)

    def apply(v: np.ndarray) -> np.ndarray:
        out = _poured(ex * (v[:, 1:] - v[:, :-1]), ey * (v[1:] - v[:-1]))
        return out + strength * v if pull is not None else out

    b = _poured(fx, fy)
    if pull is not None:
        b = b + strength * pull
    z = z.copy()
    r = np.where(free, b - apply(z), 0)
    d = near(r)
    rr, goal = float((r * d).sum()), 1e-18 * max(float((scale * b * b).sum()), 1e-30)
    for _ in range(steps):
        if rr <= goal:
            break
        ad = np.where(free, apply(d), 0)
        alpha = rr / max(float((d * ad).sum()), 1e-300)
        z += alpha * d
        r -= alpha * ad
        s = near(r)
        new = float((r * s).sum())
        d = s + new / rr * d
        rr = new
    return z


def solve_grid(n: np.ndarray, *, steps: int = 500, pull: np.ndarray | None = None, strength: float = 0.0, start: np.ndarray | None = None) -> np.ndarray:
    """Heights (h, w) of the normals (h, w, 3) of a tile, both sides of every pixel weighing the same; ``pull`` draws towards given heights."""
    nz, p, q = _slopes(n)
    half = np.full((2, *nz.shape), 0.5)
    return _relaxed(np.zeros(nz.shape) if start is None else start, _edges(half, half, nz, p, q), steps, pull, strength)


def _field(pdf: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, int, int]:
    x0, y0 = int(pdf["x"].min()), int(pdf["y"].min())
    out = np.zeros((int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1, len(names)))
    out[pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = pdf[names].to_numpy(float)
    return out, x0, y0


@dataclass(frozen=True)
class _Plan:
    """How a grid is cut: own pixels of a block, its window with a margin, and the coarse nodes around it."""

    width: int
    height: int
    block: int
    overlap: int
    k: float
    steps: int

    def window(self, col: int, row: int, margin: int) -> tuple[int, int, int, int]:
        """(left, top, right, bottom), the last two exclusive."""
        x, y = col * self.block, row * self.block
        return max(0, x - margin), max(0, y - margin), min(self.width, x + self.block + margin), min(self.height, y + self.block + margin)

    @property
    def gap(self) -> int:
        """Pixels between coarse nodes."""
        return max(1, self.block // 4)

    @property
    def counts(self) -> tuple[int, int]:
        return -(-self.width // self.block), -(-self.height // self.block)

    def hats(self, n: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the coarse nodes on an axis of ``n`` pixels that reach into a..b-1, and their values there."""
        nodes = np.unique([*range(0, n, self.gap), n - 1])
        at = np.arange(a, b)
        first = max(0, a // self.gap - 1)
        values = np.stack([np.interp(at, nodes, np.arange(len(nodes)) == i) for i in range(first, min(len(nodes), b // self.gap + 3))])
        hit = values.any(axis=1)
        return first + np.flatnonzero(hit), values[hit]


_STATE = "col int, row int, kind int, x0 int, y0 int, w int, h int, nz binary, p binary, q binary, z binary, zr binary, change double, energy double, nodes array<long>, matrix array<double>, rhs array<double>"


def _blob(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v, "<f8").tobytes()


def _opened(plan: _Plan, rows: list[dict]) -> dict:
    """A block's arrays on its window, with the heights that its neighbours sent."""
    body = next((r for r in rows if r["kind"] == 0), None)
    if body is None:
        return {}
    left, top, right, bottom = plan.window(body["col"], body["row"], plan.overlap + 2)
    shape = (bottom - top, right - left)
    b = {**body, **{c: np.frombuffer(body[c], "<f8").reshape(shape).copy() for c in ("nz", "p", "q", "z", "zr")}}
    for r in rows:
        if r["kind"] == 1:
            b["z"][r["y0"] - top : r["y0"] - top + r["h"], r["x0"] - left : r["x0"] - left + r["w"]] = np.frombuffer(r["z"], "<f8").reshape(r["h"], r["w"])
    b["inner"] = (slice(body["row"] * plan.block - top, min((body["row"] + 1) * plan.block, plan.height) - top), slice(body["col"] * plan.block - left, min((body["col"] + 1) * plan.block, plan.width) - left))
    return b


def _assembled(plan: _Plan, b: dict, renew: bool) -> dict:
    """Weights renewed if asked for, the block's share of the energy, and its share of the coarse system."""
    z, nz, p, q, (ys, xs) = b["z"], b["nz"], b["p"], b["q"], b["inner"]
    if renew:
        b["zr"] = z.copy()
    wx, wy = side_weights(b["zr"], nz, plan.k)
    b["edges"] = ex, fx, ey, fy = _edges(wx, wy, nz, p, q)
    dx, dy = z[:, 1:] - z[:, :-1], z[1:] - z[:-1]
    miss = np.zeros((4, *z.shape))
    miss[0, :, :-1], miss[1, :, 1:] = nz[:, :-1] * (dx - p[:, :-1]), nz[:, 1:] * (dx - p[:, 1:])
    miss[2, :-1], miss[3, 1:] = nz[:-1] * (dy - q[:-1]), nz[1:] * (dy - q[1:])
    b["energy"] = float((np.stack([wx[1], wx[0], wy[1], wy[0]]) * miss**2)[:, ys, xs].sum())
    left, top, right, bottom = plan.window(b["col"], b["row"], plan.overlap + 2)
    (ix, hx), (iy, hy) = plan.hats(plan.width, left, right), plan.hats(plan.height, top, bottom)
    mine = np.zeros(z.shape, bool)
    mine[ys, xs] = True
    matrix, rhs = np.zeros((len(iy), len(iy), len(ix), len(ix))), np.zeros((len(iy), len(ix)))
    pairs = lambda g: (g[:, None] * g[None]).reshape(len(g) ** 2, g.shape[1])
    for e, f, step, own, gx, gy in ((ex, fx, dx, mine[:, :-1], np.diff(hx), hy), (ey, fy, dy, mine[:-1], hx, np.diff(hy))):
        matrix += (pairs(gy) @ (e * own) @ pairs(gx).T).reshape(matrix.shape)
        rhs += gy @ ((f - e * step) * own) @ gx.T
    b["nodes"], b["matrix"], b["rhs"] = (iy[:, None] * (-(-plan.width // plan.gap) + 1) + ix).ravel(), matrix.transpose(0, 2, 1, 3).ravel(), rhs.ravel()
    return b


def _corrected(plan: _Plan, b: dict, nodes: np.ndarray | None) -> dict:
    """Heights after the coarse correction and a solve of the block and its overlap, held at what lies around."""
    left, top, right, bottom = plan.window(b["col"], b["row"], plan.overlap + 2)
    before = b["z"][b["inner"]].copy()
    if nodes is not None:
        (ix, hx), (iy, hy) = plan.hats(plan.width, left, right), plan.hats(plan.height, top, bottom)
        b["z"] += hy.T @ nodes.reshape(len(iy), len(ix)) @ hx
    edges = b.get("edges") or _edges(*side_weights(b["zr"], b["nz"], plan.k), b["nz"], b["p"], b["q"])
    a = plan.window(b["col"], b["row"], plan.overlap)
    free = np.zeros(b["z"].shape, bool)
    free[a[1] - top : a[3] - top, a[0] - left : a[2] - left] = True
    b["z"] = _relaxed(b["z"], edges, plan.steps, free=free)
    b["change"] = float(abs(b["z"][b["inner"]] - before).max())
    return b


def _rows_of(plan: _Plan, b: dict, strips: bool) -> list[dict]:
    """The block's row, and what it sends to the blocks around it."""
    out = [{**{c: b.get(c) for c in ("col", "row", "kind", "x0", "y0", "w", "h", "change", "energy", "nodes", "matrix", "rhs")}, **{c: _blob(b[c]) for c in ("nz", "p", "q", "z", "zr")}}]
    left, top, _, _ = plan.window(b["col"], b["row"], plan.overlap + 2)
    own = plan.window(b["col"], b["row"], 0)
    for row in range(max(0, b["row"] - 1), min(plan.counts[1], b["row"] + 2)) if strips else ():
        for col in range(max(0, b["col"] - 1), min(plan.counts[0], b["col"] + 2)):
            their = plan.window(col, row, plan.overlap + 2)
            x0, y0, x1, y1 = max(own[0], their[0]), max(own[1], their[1]), min(own[2], their[2]), min(own[3], their[3])
            if (col, row) != (b["col"], b["row"]) and x0 < x1 and y0 < y1:
                out.append({"col": col, "row": row, "kind": 1, "x0": x0, "y0": y0, "w": x1 - x0, "h": y1 - y0, "z": _blob(b["z"][y0 - top : y1 - top, x0 - left : x1 - left])})
    return out


def _coarse(table: pa.Table) -> list[dict]:
    """The coarse system of a dataset, a small matrix a block, solved by conjugate gradients; each block gets its nodes' values."""
    rows = table.to_pylist()
    ids, at = np.unique(np.concatenate([r["nodes"] for r in rows]), return_inverse=True)
    parts, i = [], 0
    b, diagonal = np.zeros(len(ids)), np.zeros(len(ids))
    for r in rows:
        n = len(r["nodes"])
        own, m = at[i : i + n], np.array(r["matrix"]).reshape(n, n)
        parts.append((own, m))
        np.add.at(b, own, r["rhs"])
        np.add.at(diagonal, own, np.diag(m))
        i += n

    def apply(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids))
        for own, m in parts:
            out[own] += m @ v[own]
        return out

    scale = np.where(diagonal > 0, 1 / np.maximum(diagonal, 1e-300), 0)
    z, r = np.zeros(len(ids)), b
    d = scale * r
    rr = float(r @ d)
    goal = 1e-20 * max(rr, 1e-30)
    for _ in range(4 * len(ids)):
        if rr <= goal:
            break
        ad = apply(d)
        curve = float(d @ ad)
        if curve <= 1e-12 * float(d @ (diagonal * d)):  # only the constant is left, or rounding
            break
        alpha = rr / curve
        z, r = z + alpha * d, r - alpha * ad
        new = float(r @ (scale * r))
        d, rr = scale * r + new / rr * d, new
    return [{"col": row["col"], "row": row["row"], "at": z[own]} for row, (own, _) in zip(rows, parts, strict=True)]


def integrate_bilateral(normals: DataFrame, width: int, height: int, k: float = 0.0, *, block: int = TILE, overlap: int = 2 * PAD, rounds: int = 10, tol: float = 1e-5, steps: int = 500, sweeps: int = 60, exact: float = 3e-5) -> DataFrame:
    """Heights with mean 0 of grids of any size: one-sided differences on both sides of every pixel, weighted by nz.

    With k > 0 the sides are weighed anew, by ``side_weights``, in up to ``rounds`` rounds, until the energy of all datasets
    changes by less than ``tol``. The least squares of a round are solved in blocks that overlap: a sweep solves each block
    with its overlap, held at the heights that its neighbours sent, and before that a coarse system with a node at each
    quarter of a block's sides moves all blocks against each other: what it does not reach is shorter than a block, and dies
    within the overlap. Sweeps end when no height changes by more than ``exact`` of the range. A block with its window is the
    largest group; the coarse system has some dozen nodes a block. State is written to the shared folder, and shuffled once a sweep. A grid of one block takes the same path, in which one sweep is enough.
    """
    overlap = min(overlap, block - 2)
    plan = _Plan(width, height, block, overlap, k, steps)
    many = plan.counts != (1, 1)
    spark, kind = normals.sparkSession, normals.schema["dataset"].dataType
    schema = StructType.fromDDL("dataset string, " + _STATE)
    schema["dataset"].dataType = kind
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def table(dataset: pa.Scalar, rows: list[dict]) -> pa.Table:
        return pa.Table.from_pylist([{"dataset": dataset.as_py(), **r} for r in rows], schema=arrow)

    def begin(b: Block) -> dict[str, object]:
        left, top, right, bottom = plan.window(b.col, b.row, overlap + 2)
        n = np.stack([np.where(b.known, b.values[c], 0) for c in ("nx", "ny", "nz")], axis=2)
        nz, p, q = _slopes(n)
        p, q = np.where(b.known, p, 0), np.where(b.known, q, 0)
        flat = {"nz": [_blob(nz)], "p": [_blob(p)], "q": [_blob(q)], "z": [_blob(np.zeros(nz.shape))], "zr": [_blob(np.zeros(nz.shape))]}
        nothing = {c: pa.nulls(1, arrow.field(c).type) for c in ("change", "energy", "nodes", "matrix", "rhs")}
        return {"col": [b.col], "row": [b.row], "kind": [0], "x0": [left], "y0": [top], "w": [right - left], "h": [bottom - top], **flat, **nothing}

    def exchanged(renew: bool):
        def one(key: tuple, t: pa.Table) -> pa.Table:
            b = _opened(plan, t.to_pylist())
            if not b:
                return table(key[0], [])
            b = _assembled(plan, b, renew)
            if not many:
                b = _corrected(plan, b, None)
            return table(key[0], _rows_of(plan, b, False))

        return one

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                rows = _rows_of(plan, _corrected(plan, _opened(plan, [r]), np.array(r["at"])), True)
                yield from table(batch.column("dataset")[i], rows).to_batches()

    def solved(key: tuple, t: pa.Table) -> pa.Table:
        rows = _coarse(t)
        columns = [pa.repeat(key[0].cast(arrow.field(0).type), len(rows)), pa.array([r["col"] for r in rows], pa.int32()), pa.array([r["row"] for r in rows], pa.int32())]
        return pa.table([*columns, pa.array([r["at"] for r in rows], pa.list_(pa.float64()))], names=["_d", "_c", "_r", "at"])

    axis = lambda n: Axis.near(n, block, overlap + 2)
    fields = normals.select("dataset", "x", "y", *(F.col(c).cast("double").alias(c) for c in ("nx", "ny", "nz")))
    keys = ["dataset", "col", "row"]
    path = shared_dir(spark)
    state, energy = stored(blockwise(fields, ["nx", "ny", "nz"], axis(width), axis(height), begin, _STATE), path), None
    span = lambda df: df.where("kind = 0").groupBy("dataset").agg(F.max("change").alias("change"), F.sum("energy").alias("energy"))

    def replaced(df: DataFrame, old: str) -> tuple[DataFrame, str]:
        new = shared_dir(spark)
        out = stored(df, new)
        removed(spark, old)
        return out, new

    largest = 0.0  # change of a height in any sweep so far: about the range of heights
    for turn in range(rounds if k > 0 else 1):
        for sweep in range(sweeps if many else 1):
            kept = shared_dir(spark)
            moved = stored(state.groupBy(*keys).applyInArrow(exchanged(sweep == 0), schema), kept)
            if sweep == 0:  # the energy of the heights of the last round under the weights that they give
                now = {r["dataset"]: r["energy"] for r in span(moved).collect()}
                if turn and all(abs(v - energy[d]) <= tol * max(abs(energy[d]), 1e-300) for d, v in now.items()):
                    removed(spark, kept)
                    return _heights(plan, state, path)
                energy = now
            if many:
                system = moved.select(*keys, "nodes", "matrix", "rhs").groupBy("dataset")
                nodes = system.applyInArrow(solved, f"_d {kind.simpleString()}, _c int, _r int, at array<double>")
                here = F.col("dataset").eqNullSafe(F.col("_d")) & (F.col("col") == F.col("_c")) & (F.col("row") == F.col("_r"))
                moved, kept = replaced(moved.join(F.broadcast(nodes), here).drop("_d", "_c", "_r").mapInArrow(swept, schema), kept)
            removed(spark, path)
            state, path = moved, kept
            change = max((r["change"] for r in span(state).collect()), default=0.0)
            largest = max(largest, change)
            if change <= exact * largest:
                break
    return _heights(plan, state, path)


def _heights(plan: _Plan, state: DataFrame, path: str) -> DataFrame:
    """(dataset, x, y, z) of the blocks' own pixels, with mean 0 in each dataset."""
    kind = state.schema["dataset"].dataType

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                left, top, right, bottom = plan.window(r["col"], r["row"], plan.overlap + 2)
                x0, y0, x1, y1 = plan.window(r["col"], r["row"], 0)
                z = np.frombuffer(r["z"], "<f8").reshape(bottom - top, right - left)[y0 - top : y1 - top, x0 - left : x1 - left].ravel()
                y, x = (v.ravel().astype(np.int32) for v in np.mgrid[y0:y1, x0:x1])
                yield pa.RecordBatch.from_arrays([pa.array([r["dataset"]] * len(z), to_arrow_type(kind)), pa.array(x), pa.array(y), pa.array(z)], ["dataset", "x", "y", "z"])

    rows = state.where("kind = 0").select("dataset", "col", "row", "z").mapInArrow(one, f"dataset {kind.simpleString()}, x int, y int, z double")
    mean = rows.groupBy("dataset").agg(F.avg("z").alias("mean"))
    joined = rows.join(F.broadcast(mean.withColumnRenamed("dataset", "_d")), F.col("dataset").eqNullSafe(F.col("_d")))
    return joined.select("dataset", "x", "y", (F.col("z") - F.col("mean")).alias("z"))


def integrate_tiled(normals: DataFrame, width: int, height: int, *, tile: int = TILE, pad: int = PAD, lam: float = LAMBDA) -> DataFrame:
    """Heights of a grid of any size: a coarse solve, then overlapping tiles drawn towards it and blended by smooth ramps."""
    shrink = max(1.0, max(width, height) / tile)
    small = (max(2, int(width / shrink)), max(2, int(height / shrink)))
    coarse = integrate_bilateral(resize_normals(normals, (width, height), small) if shrink > 1 else normals, *(small if shrink > 1 else (width, height)), block=max(small) if shrink > 1 else max(width, height))
    ratio = (width - 1) / (small[0] - 1) if shrink > 1 else 1.0
    scaffold = resize_grid(coarse, ["z"], small, (width, height)).withColumn("z", F.col("z") * ratio) if shrink > 1 else coarse
    step = tile - 2 * pad
    cols, rows = max(1, -(-(width - 2 * pad) // step)), max(1, -(-(height - 2 * pad) // step))
    span = lambda v, n: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(v) - tile + 1) / step)).cast("int"), F.least(F.lit(n - 1), F.floor(F.col(v) / step)).cast("int")))
    # the scaffold has a row a pixel, though Spark takes it to be as small as the coarse grid: it must not be broadcast
    dealt = normals.join(scaffold.hint("merge"), ["dataset", "x", "y"]).select("dataset", "x", "y", "nx", "ny", "nz", "z").withColumn("col", span("x", cols)).withColumn("row", span("y", rows))

    def ramp(n: int, before: bool, after: bool) -> np.ndarray:
        t = np.ones(n)
        edge = np.clip((np.arange(min(2 * pad, n)) + 0.5) / (2 * pad), 0, 1)
        smooth = edge**3 * (edge * (edge * 6 - 15) + 10)
        if before:
            t[: len(smooth)] *= smooth
        if after:
            t[n - len(smooth) :] *= smooth[::-1]
        return np.maximum(t, 1e-9)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        f, x0, y0 = _field(pdf, ["nx", "ny", "nz", "z"])
        pull = f[..., 3]
        z = solve_grid(f[..., :3], pull=pull, strength=lam * lam, start=pull)
        c, r = int(pdf["col"].iloc[0]), int(pdf["row"].iloc[0])
        w = ramp(z.shape[0], r > 0, r < rows - 1)[:, None] * ramp(z.shape[1], c > 0, c < cols - 1)[None]
        y, x = np.mgrid[: z.shape[0], : z.shape[1]]
        return pd.DataFrame({"dataset": pdf["dataset"].iloc[0], "x": x.ravel() + x0, "y": y.ravel() + y0, "zw": (z * w).ravel(), "w": w.ravel()})

    parts = dealt.groupBy("dataset", "col", "row").applyInPandas(solve, "dataset string, x int, y int, zw double, w double")
    return parts.groupBy("dataset", "x", "y").agg((F.sum("zw") / F.sum("w")).alias("z"))
