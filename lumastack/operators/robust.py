"""Robust normals: solvers batched over the pixels of an Arrow batch, and a distributed low-rank cleaning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import NORMALS, batched, by_dataset, grams, listed, normal_rows, pinv, stacked
from ..shared import removed, shared_dir, stored


def _unit(n: np.ndarray, least: float = 1e-10) -> np.ndarray:
    size = np.linalg.norm(n, axis=1, keepdims=True)
    return np.where(size > least, n / np.maximum(size, least), n)


def _weighted(lights: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The weighted least-squares solution of every row of v, by orthogonal factors; singular ones by a pseudoinverse."""
    root = np.sqrt(w)
    q, r = np.linalg.qr(root[:, :, None] * lights[None])
    b = np.einsum("pni,pn->pi", q, root * v)
    size = np.abs(np.diagonal(r, axis1=1, axis2=2))
    bad = size.min(axis=1) <= 1e-12 * np.maximum(size.max(axis=1), 1e-300)
    out = np.zeros_like(b)
    if (~bad).any():
        out[~bad] = np.linalg.solve(r[~bad], b[~bad][..., None])[..., 0]
    for i in np.flatnonzero(bad):
        out[i] = np.linalg.pinv(root[i][:, None] * lights) @ (root[i] * v[i])
    return out


def normals_robust(pixels: DataFrame, lights: np.ndarray, *, high: float = 255.0, low: float = 5.0, delta: float = 5.0, rounds: int = 10, tol: float = 1e-4) -> DataFrame:
    """Drop the values that violate [low, high] most while more than five stay, then reweight by Huber.

    With five or fewer left, one plain solve counts.
    """

    def solve(v: np.ndarray) -> np.ndarray:
        n = v.shape[1]
        violation = np.maximum(v - high, low - v)
        order = np.argsort(-violation, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[None].repeat(len(v), 0), axis=1)
        use = ((violation <= 0) | (rank >= max(n - 5, 0))).astype(float)
        x = _weighted(lights, use, v)
        live = use.sum(axis=1) > 5
        w = use.copy()
        for _ in range(rounds):
            if not live.any():
                break
            at = np.flatnonzero(live)
            res = np.abs(v[at] - x[at] @ lights.T)
            new = use[at] * np.where(res <= delta, 1.0, delta / np.maximum(res, 1e-6))
            moved = np.abs(new - w[at]).max(axis=1)
            w[at] = new
            x[at] = _weighted(lights, new, v[at])
            live[at] = moved >= tol
        return _unit(x)

    return batched(pixels, solve)


def normals_l1(pixels: DataFrame, lights: np.ndarray, *, rounds: int = 1000, tol: float = 1e-8) -> DataFrame:
    """Least absolute deviations by reweighting with 1 / |residual|."""

    def solve(v: np.ndarray) -> np.ndarray:
        x = _weighted(lights, np.ones_like(v), v)
        live = np.ones(len(v), bool)
        for _ in range(rounds):
            at = np.flatnonzero(live)
            if not len(at):
                break
            w = 1 / np.maximum(np.sqrt(np.abs(v[at] - x[at] @ lights.T)), 1e-8)
            new = _weighted(lights, w * w, v[at])
            live[at] = np.linalg.norm(new - x[at], axis=1) > tol
            x[at] = new
        return _unit(x)

    return batched(pixels, solve)


def normals_sbl(pixels: DataFrame, lights: np.ndarray, *, prior: float = 1.0, ridge: float = 1e-6, least: float = 1e-8, rounds: int = 1000, tol: float = 1e-8) -> DataFrame:
    """Sparse Bayesian errors: each light's error has a variance of its own, its squared residual plus the posterior's share."""
    eye = np.eye(3)

    def solve(v: np.ndarray) -> np.ndarray:
        x, variance, live = np.full((len(v), 3), 1000.0), np.ones_like(v), np.ones(len(v), bool)
        for _ in range(rounds):
            at = np.flatnonzero(live)
            if not len(at):
                break
            moments = np.einsum("pn,ni,nj->pij", 1 / variance[at], lights, lights)
            new = np.linalg.solve(moments + ridge * eye, np.einsum("pn,ni->pi", v[at] / variance[at], lights)[..., None])[..., 0]
            posterior = np.einsum("ni,pij,nj->pn", lights, np.linalg.inv(moments + prior * eye), lights)
            variance[at] = np.maximum((v[at] - new @ lights.T) ** 2 + posterior, least)
            live[at] = np.linalg.norm(new - x[at], axis=1) >= tol
            x[at] = new
        return _unit(x)

    return batched(pixels, solve)


#: Rounds of robust PCA that are made again from stored rows.
REMADE = 32


def _shrunk(m: np.ndarray, t: float) -> np.ndarray:
    return np.sign(m) * np.maximum(np.abs(m) - t, 0)


def normals_rpca(pixels: DataFrame, lights: np.ndarray, *, rounds: int = 100, tol: float = 1e-6, rho: float = 1.5) -> DataFrame:
    """Least squares on the low-rank part of each dataset's pixels x lights matrix (robust PCA, inexact augmented Lagrangian).

    Only the matrix is stored: what a round makes of a pixel's row follows from the row and from a small matrix and a penalty
    for each round before it, so a task makes these rounds again as it reads. A round takes the sparse part by soft thresholds,
    and the lights x lights second moments of what is left, whose eigenvectors give the singular vectors; only a matrix for
    each dataset, which holds the distance too, reaches the driver. After ``REMADE`` rounds the rows are stored as they are
    then, so that work a round is bounded. Each dataset has its own penalty and stops by itself; its result does not depend
    on the others.
    """
    spark = pixels.sparkSession
    n = len(lights)
    third = F.zip_with(F.zip_with("r", "g", lambda a, b: a + b), "b", lambda a, b: (a + b) / 3)
    path = shared_dir(spark)
    state = stored(pixels.select("dataset", "x", "y", third.alias("d")), path)
    tops = {r["dataset"]: r["m"] for r in state.groupBy("dataset").agg(F.max(F.array_max(F.transform("d", F.abs))).alias("m")).collect()}
    facts = {}
    for name, (rows, _, second) in grams(state, ["d"], lambda _, d: d).items():
        sigma, lam = float(np.sqrt(np.linalg.eigvalsh(second)[-1])), 1 / np.sqrt(max(rows, n))
        facts[name] = {"lam": lam, "mu": 1.25 / max(sigma, 1e-12), "most": 1.25e7 / max(sigma, 1e-12), "size": float(np.sqrt(np.trace(second))), "scale": max(sigma, tops[name] / lam, 1e-12)}
    if not facts:
        return batched(pixels, lambda v: np.zeros((len(v), 3)))
    schema = "dataset string, x int, y int, d array<double>, a array<double>, m array<double>, gap array<double>"
    columns = ["d"]

    def left(d: np.ndarray, a: np.ndarray, m: np.ndarray, mu: float, lam: float) -> np.ndarray:
        return d - _shrunk(d - a + m / mu, lam / mu) + m / mu

    def remaking(done: dict[str, list], lams: dict[str, float], scales: dict[str, float]) -> Callable:
        """What the rounds ``done`` (penalty, matrix) make of stored rows: (d, a, m, squared distance of the last)."""

        def made(name: str, d: np.ndarray, a: np.ndarray | None = None, m: np.ndarray | None = None, gap: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
            if a is None:
                a, m, gap = np.zeros_like(d), d / scales[name], np.zeros((len(d), 1))
            for mu, keep in done[name]:
                t = left(d, a, m, mu, lams[name])
                a = t @ keep
                z = t - m / mu - a  # d - e - a
                m, gap = m + mu * z, (z * z).sum(axis=1, keepdims=True)
            return d, a, m, gap

        return made

    done: dict[str, list] = {name: [] for name in facts}
    lams, scales = ({name: f[c] for name, f in facts.items()} for c in ("lam", "scale"))
    now = lambda: remaking({name: list(r) for name, r in done.items()}, lams, scales)
    live = set(facts)
    for turn in range(rounds):

        def moments(name: str, *v: np.ndarray, made: Callable = now(), mus: dict = {name: f["mu"] for name, f in facts.items()}) -> np.ndarray:
            d, a, m, gap = made(name, *v)
            return np.hstack((left(d, a, m, mus[name], lams[name]), np.sqrt(gap)))

        for name, (_, _, second) in grams(state.where(F.col("dataset").isin(sorted(live))), columns, moments).items():
            f = facts[name]
            if turn and np.sqrt(second[n, n]) < tol * f["size"]:
                live.discard(name)
                continue
            values, vectors = np.linalg.eigh(second[:n, :n])
            s, mu = np.sqrt(np.maximum(values, 0)), f["mu"]
            done[name].append((mu, vectors @ np.diag(np.where(s > 1 / mu, 1 - 1 / (mu * np.maximum(s, 1e-300)), 0)) @ vectors.T))
            f["mu"] = min(mu * rho, f["most"])
        if not live:
            break
        if turn % REMADE == REMADE - 1 and turn < rounds - 1:

            def kept(batches: Iterator[pa.RecordBatch], made: Callable = now(), read: tuple[str, ...] = tuple(columns)) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for name, part in by_dataset(batch):
                        values = made(name, *(stacked(part.column(c)) for c in read))
                        keys = [part.column(c).combine_chunks() for c in ("dataset", "x", "y")]
                        yield pa.RecordBatch.from_arrays([*keys, *map(listed, values)], ["dataset", "x", "y", "d", "a", "m", "gap"])

            new = shared_dir(spark)
            state = stored(state.mapInArrow(kept, schema), new)
            removed(spark, path)
            path, columns, done = new, ["d", "a", "m", "gap"], {name: [] for name in facts}
    solver = pinv(lights).T
    last, read = now(), list(columns)

    def normals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part in by_dataset(batch):
                yield normal_rows(part, _unit(last(name, *(stacked(part.column(c)) for c in read))[1] @ solver))

    return state.mapInArrow(normals, NORMALS)
