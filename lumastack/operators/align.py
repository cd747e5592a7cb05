"""Image alignment by mutual information and by normalised correlation, to the pixel and below.

A window and its reference are a row, so no pixel is multiplied by the offsets: correlations at all offsets come from Fourier
transforms and summed-area tables, histograms from NumPy. The best offset is then refined by gradients.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Axis, Block, blockwise

def _information(pairs: DataFrame) -> DataFrame:
    keys = ["dataset", "light_id", "dx", "dy"]
    joint = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    joint = joint.withColumns({"na": F.sum("n").over(w.partitionBy(*keys, "a")), "nb": F.sum("n").over(w.partitionBy(*keys, "b")), "all": F.sum("n").over(w)})
    p = F.col("n") / F.col("all")
    return joint.groupBy(*keys).agg(F.sum(p * F.log(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("score"))


def _windows(df: DataFrame, width: int, height: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, v, known): a row for each window, row by row."""

    def whole(block: Block) -> dict[str, object]:
        return {"v": [block.values["v"].ravel().astype(float)], "known": [block.known.ravel()]}

    across, down = Axis.near(width, width, 0), Axis.near(height, height, 0)
    return blockwise(df.select(*keys, "x", "y", "v"), ["v"], across, down, whole, "v array<double>, known array<boolean>", keys=keys)


def paired_windows(ref: DataFrame, other: DataFrame, width: int, height: int) -> DataFrame:
    """(dataset, light_id, av, ak, bv, bk): each image's window beside its reference; a window is a row, pixels are packed once."""
    a = _windows(ref, width, height, ("dataset",)).select("dataset", F.col("v").alias("av"), F.col("known").alias("ak"))
    b = _windows(other, width, height, ("dataset", "light_id")).select("dataset", "light_id", F.col("v").alias("bv"), F.col("known").alias("bk"))
    return b.join(a, "dataset")


def correlated(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """Sums of a(x, y) b(x + dx, y + dy) over a's inner part, for all offsets up to ``reach``, by Fourier transforms."""
    h, w = a.shape
    inner = np.zeros((h, w))
    inner[reach : h - reach, reach : w - reach] = a[reach : h - reach, reach : w - reach]
    product = np.fft.irfft2(np.conj(np.fft.rfft2(inner)) * np.fft.rfft2(b), s=(h, w))  # offsets inside never wrap round
    at = np.arange(-reach, reach + 1)
    return product[np.ix_(at % h, at % w)]


def boxed(b: np.ndarray, reach: int) -> np.ndarray:
    """Sums of b over the inner part moved by each offset, from a summed-area table."""
    h, w = b.shape
    table = np.zeros((h + 1, w + 1))
    table[1:, 1:] = b.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(2 * reach + 1)
    corner = lambda y, x: table[np.ix_(at + y, at + x)]
    return corner(h - 2 * reach, w - 2 * reach) - corner(0, w - 2 * reach) - corner(h - 2 * reach, 0) + corner(0, 0)


def ncc_surface(a: np.ndarray, ak: np.ndarray, b: np.ndarray, bk: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """sum(ab) / sqrt(sum(aa) sum(bb)) at all offsets (dy, dx), 0 where the denominator is, and the number of pairs."""
    a, b = np.where(ak, a, 0), np.where(bk, b, 0)
    exact = (lambda v: np.rint(v)) if (a == np.rint(a)).all() and (b == np.rint(b)).all() and max(abs(a).max(), abs(b).max()) < 1e4 else (lambda v: v)
    ab = exact(correlated(a, b, reach))
    if ak.all() and bk.all():
        aa, bb = exact(boxed(a * a, reach)[reach, reach]), exact(boxed(b * b, reach))
        n = np.full(ab.shape, (a.shape[0] - 2 * reach) * (a.shape[1] - 2 * reach))
    else:
        aa, bb, n = exact(correlated(a * a, bk.astype(float), reach)), exact(correlated(ak.astype(float), b * b, reach)), np.rint(correlated(ak.astype(float), bk.astype(float), reach))
    under = np.sqrt(np.maximum(aa * bb, 0))
    return np.divide(ab, under, out=np.zeros(ab.shape), where=under > 0), n


def mi_surface(a: np.ndarray, ak: np.ndarray, b: np.ndarray, bk: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Mutual information of the values themselves at all offsets (dy, dx), and the number of pairs."""
    h, w = a.shape
    levels_b, code_b = np.unique(b, return_inverse=True)
    levels_a, code_a = np.unique(a, return_inverse=True)
    code_a, code_b = code_a.reshape(h, w) * len(levels_b), code_b.reshape(h, w)
    inner = (slice(reach, h - reach), slice(reach, w - reach))
    score, n = np.zeros((2 * reach + 1,) * 2), np.zeros((2 * reach + 1,) * 2)
    for j in range(2 * reach + 1):
        for i in range(2 * reach + 1):
            there = (slice(j, j + h - 2 * reach), slice(i, i + w - 2 * reach))
            both = (code_a[inner] + code_b[there])[ak[inner] & bk[there]]
            n[j, i] = len(both)
            if len(both):
                pair, count = np.unique(both, return_counts=True)
                of_a, of_b = pair // len(levels_b), pair % len(levels_b)
                na, nb = np.bincount(of_a, count)[of_a], np.bincount(of_b, count)[of_b]
                score[j, i] = (count / len(both) * np.log(count * float(len(both)) / (na * nb))).sum()
    return score, n


# Cubic interpolation between samples: fixed weights (Catmull-Rom) of four taps by powers of the fraction.
CUBIC = np.array([[0, -0.5, 1, -0.5], [1, 0, -2.5, 1.5], [0, 0.5, 2, -1.5], [0, 0, -0.5, 0.5]])


def moved(b: np.ndarray, tx: float, ty: float, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """b(x + tx, y + ty) on the part inside ``margin``, and its slopes in x and y."""
    h, w = b.shape
    ix, iy = int(np.floor(tx)), int(np.floor(ty))
    value = lambda f: CUBIC @ np.array([1, f, f * f, f**3])
    slope = lambda f: CUBIC @ np.array([0, 1, 2 * f, 3 * f * f])
    rows = [b[np.clip(np.arange(margin, h - margin) + iy + t, 0, h - 1)] for t in (-1, 0, 1, 2)]
    cols = np.stack([np.clip(np.arange(margin, w - margin) + ix + t, 0, w - 1) for t in (-1, 0, 1, 2)])

    def taps(wy: np.ndarray, wx: np.ndarray) -> np.ndarray:
        line = sum(k * r for k, r in zip(wy, rows, strict=True))
        return sum(k * line[:, c] for k, c in zip(wx, cols, strict=True))

    fx, fy = tx - ix, ty - iy
    return taps(value(fy), value(fx)), taps(value(fy), slope(fx)), taps(slope(fy), value(fx))


def refine_ncc(a: np.ndarray, b: np.ndarray, dx: int, dy: int, reach: int, rounds: int = 30) -> tuple[float, float]:
    """The translation near (dx, dy) that makes the centred windows most alike, by Gauss-Newton steps; it stays within a pixel."""
    margin = reach + 2
    if min(a.shape) <= 2 * margin + 2:
        return float(dx), float(dy)
    a = a[margin : a.shape[0] - margin, margin : a.shape[1] - margin]
    a, t = a - a.mean(), np.array([dx, dy], float)
    for _ in range(rounds):
        v, gx, gy = moved(b, t[0], t[1], margin)
        v, g = v - v.mean(), np.stack([(gx - gx.mean()).ravel(), (gy - gy.mean()).ravel()])
        gain, system = float((a * v).sum()), g @ g.T
        if gain <= 0 or np.linalg.det(system) <= 1e-12 * max(np.trace(system) ** 2, 1e-300):
            break
        step = np.linalg.solve(system, g @ ((v * v).sum() / gain * a - v).ravel())
        t = np.clip(t + np.clip(step, -0.5, 0.5), [dx - 1, dy - 1], [dx + 1, dy + 1])
        if abs(step).max() < 1e-5:
            break
    return float(t[0]), float(t[1])


def smooth_information(a: np.ndarray, v: np.ndarray, slopes: tuple[np.ndarray, np.ndarray], bins: int) -> tuple[float, np.ndarray]:
    """Mutual information of ``a`` (bin numbers) and real values ``v`` in bins, by a cubic B-spline histogram, and its gradient."""
    at = np.floor(v).astype(np.int64)
    f = v - at
    spline = [(1 - f) ** 3 / 6, (3 * f**3 - 6 * f**2 + 4) / 6, (-3 * f**3 + 3 * f**2 + 3 * f + 1) / 6, f**3 / 6]
    slope = [-((1 - f) ** 2) / 2, (9 * f**2 - 12 * f) / 6, (-9 * f**2 + 6 * f + 3) / 6, f**2 / 2]
    width, n = bins + 4, v.size
    place = [a * width + np.clip(at + k, 0, width - 1) for k in range(4)]
    total = lambda weights: sum(np.bincount(p.ravel(), w.ravel(), minlength=bins * width) for p, w in zip(place, weights, strict=True)).reshape(bins, width) / n
    p = total(spline)
    pa_, pb = p.sum(axis=1, keepdims=True), p.sum(axis=0, keepdims=True)
    log = np.log(np.where(p > 0, p, 1) / np.where(p > 0, pa_ * pb, 1))
    rise = np.log(np.where(p > 0, p, 1) / np.where(p > 0, pb, 1))
    return float((p * log).sum()), np.array([(total([d * g for d in slope]) * rise).sum() for g in slopes])


def refine_mi(a: np.ndarray, b: np.ndarray, dx: int, dy: int, reach: int, bins: int = 24, rounds: int = 40) -> tuple[float, float]:
    """The translation near (dx, dy) of most mutual information: steps up the gradient of a smoothed histogram, halved when too long."""
    margin = reach + 2
    if min(a.shape) <= 2 * margin + 2 or a.max() <= a.min() or b.max() <= b.min():
        return float(dx), float(dy)
    low, high = float(b.min()), float(b.max())
    a = a[margin : a.shape[0] - margin, margin : a.shape[1] - margin]
    a = np.minimum((a - a.min()) / max(np.ptp(a), 1e-12) * bins, bins - 1).astype(np.int64)
    scale = (bins - 1) / (high - low)

    def at(t: np.ndarray) -> tuple[float, np.ndarray]:
        v, gx, gy = moved(b, t[0], t[1], margin)
        return smooth_information(a, (v - low) * scale, (gx * scale, gy * scale), bins)

    t, length = np.array([dx, dy], float), 0.25
    now, slope = at(t)
    for _ in range(rounds):
        size = float(np.hypot(*slope))
        if size < 1e-9 or length < 1e-3:
            break
        to = np.clip(t + length * slope / size, [dx - 1, dy - 1], [dx + 1, dy + 1])
        value, its = at(to)
        if value > now:
            t, now, slope = to, value, its
        else:
            length /= 2
    return float(t[0]), float(t[1])


SURFACES = {"mi": (mi_surface, refine_mi), "ncc": (ncc_surface, refine_ncc)}


def _surface_rows(pairs: DataFrame, width: int, height: int, reach: int, method: str, best: bool) -> DataFrame:
    """Scores at all offsets that have a pair, or the best of each image with its sub-pixel translation."""
    surface, refine = SURFACES[method]
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    at = np.arange(-reach, reach + 1)
    dy, dx = (v.ravel() for v in np.meshgrid(at, at, indexing="ij"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                arrays = [batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(height, width) for c in ("av", "ak", "bv", "bk")]
                score, n = (v.ravel() for v in surface(*arrays, reach))
                hit = np.flatnonzero(n > 0)
                if best:
                    hit = hit[score[hit] > 0] if method == "mi" else hit
                    hit = hit[np.lexsort((dx[hit], dy[hit], -np.round(score[hit], 9)))][:1]
                columns = [batch.column(c).slice(i, 1).take(pa.array(np.zeros(len(hit), np.int64))) for c in ("dataset", "light_id")]
                columns += [pa.array(dx[hit], pa.int32()), pa.array(dy[hit], pa.int32()), pa.array(score[hit])]
                if best:
                    a, ak, b, bk = arrays
                    fine = [refine(a, b, int(dx[h]), int(dy[h]), reach) if ak.all() and bk.all() else (float(dx[h]), float(dy[h])) for h in hit]
                    columns += [pa.array([f[k] for f in fine], pa.float64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["dataset", "light_id", "dx", "dy", "score", *(["tx", "ty"] if best else [])])

    schema = f"dataset {kinds['dataset']}, light_id {kinds['light_id']}, dx int, dy int, score double" + (", tx double, ty double" if best else "")
    return pairs.mapInArrow(task, schema)


def _aligned(ref: DataFrame, other: DataFrame, width: int, height: int, reach: int, method: str) -> tuple[DataFrame, DataFrame]:
    if 2 * reach >= min(width, height):
        raise ValueError("the window has no inner part: it must be wider and higher than twice the reach")
    pairs = paired_windows(ref, other, width, height)
    return _surface_rows(pairs, width, height, reach, method, True), _surface_rows(pairs, width, height, reach, method, False)


def mutual_information(ref: DataFrame, other: DataFrame, width: int, height: int, reach: int, dx: int, dy: int) -> DataFrame:
    """(dataset, light_id, dx, dy, score) at one offset."""
    return align_by_mi(ref, other, width, height, reach)[1].where((F.col("dx") == dx) & (F.col("dy") == dy))


def align_by_mi(ref: DataFrame, other: DataFrame, width: int, height: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """The best offset of each image, and the whole score surface.

    ``ref`` has (dataset, x, y, v), ``other`` (dataset, light_id, x, y, v). The first of equal scores by dy, then dx, counts;
    (tx, ty) is the translation refined below a pixel, which needs windows without gaps. Score is mutual information.
    """
    return _aligned(ref, other, width, height, reach, "mi")


def align_by_ncc(ref: DataFrame, other: DataFrame, width: int, height: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """As ``align_by_mi`` by sum(ab) / sqrt(sum(aa) sum(bb)), 0 where the denominator is; all offsets by transforms at once."""
    return _aligned(ref, other, width, height, reach, "ncc")


def offset_errors(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Accuracy of found offsets (dataset, light_id, dx, dy) against true ones."""
    t = truth.select("dataset", "light_id", F.col("dx").alias("tx"), F.col("dy").alias("ty"))
    rows = found.join(t, ["dataset", "light_id"]).withColumns({"ex": F.col("dx") - F.col("tx"), "ey": F.col("dy") - F.col("ty")})
    far = F.sqrt((F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")).cast("double"))
    over = {f"over{k}": F.sum(F.when(far >= k, 1).otherwise(0)) for k in (1, 2, 3)}
    out = rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("ex") * F.col("ex"))).alias("rmse_x"), F.sqrt(F.avg(F.col("ey") * F.col("ey"))).alias("rmse_y"),
        F.min(F.abs("ex")).alias("min_x"), F.max(F.abs("ex")).alias("max_x"), F.min(F.abs("ey")).alias("min_y"), F.max(F.abs("ey")).alias("max_y"),
        *(v.alias(k) for k, v in over.items()),
    )
    return out.withColumns({f"pct{k}": 100.0 * F.col(f"over{k}") / F.col("n") for k in (1, 2, 3)})


def detect_quarter_turn(target: DataFrame, thumbs: DataFrame, width: int, height: int) -> DataFrame:
    """(dataset, light_id, turn, score) of images that lie on their side.

    ``thumbs`` (dataset, light_id, x, y, v) are height x width; turned by +90 and -90 degrees each is compared with
    ``target`` (dataset, x, y, v) by mutual information, and the turn with more of it is taken.
    """
    plus = thumbs.select("dataset", "light_id", (width - 1 - F.col("y")).alias("x"), F.col("x").alias("y"), "v", F.lit(90).alias("turn"))
    minus = thumbs.select("dataset", "light_id", F.col("y").alias("x"), (height - 1 - F.col("x")).alias("y"), "v", F.lit(-90).alias("turn"))
    both = plus.union(minus).join(target.select("dataset", "x", "y", F.col("v").alias("a")), ["dataset", "x", "y"])
    scores = _information(both.select("dataset", "light_id", F.col("turn").alias("dx"), F.lit(0).alias("dy"), "a", F.col("v").alias("b")))
    w = Window.partitionBy("dataset", "light_id").orderBy(F.desc(F.round("score", 9)), F.desc("dx"))
    return scores.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("dataset", "light_id", F.col("dx").alias("turn"), "score")
