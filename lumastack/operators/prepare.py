"""Capture preparation: which images count, cropping, offsets, rotation, lens and light corrections."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as colors
from .blocks import SIZE, Axis, Block, bilinear, blockwise


def validate_images(images: DataFrame) -> DataFrame:
    """Keep the most frequent format; images of another size or 35mm focal length than most are invalid and skipped.

    Ties go to the value seen first by ``light_id``.
    """

    def mode(rows: DataFrame, keys: list[str]) -> DataFrame:
        counted = rows.groupBy("dataset", *keys).agg(F.count(F.lit(1)).alias("n"), F.min("light_id").alias("first"))
        w = Window.partitionBy("dataset").orderBy(F.desc("n"), "first")
        return counted.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("dataset", *(F.col(k).alias(f"top_{k}") for k in keys))

    rows = images.join(F.broadcast(mode(images, ["format"])), "dataset").where(F.col("format") == F.col("top_format")).drop("top_format")
    rows = rows.join(F.broadcast(mode(rows, ["width", "height"])), "dataset").join(F.broadcast(mode(rows, ["focal35"])), "dataset")
    sized = (F.col("width") == F.col("top_width")) & (F.col("height") == F.col("top_height"))
    good = sized & F.col("focal35").eqNullSafe(F.col("top_focal35"))
    return rows.withColumn("valid", good).withColumn("skip", F.col("skip") | ~sized).drop("top_width", "top_height", "top_focal35")


def select_images(images: DataFrame, lights: DataFrame) -> DataFrame:
    """Unskipped images numbered anew, joined by that number with their lights, then only the visible ones."""
    w = Window.partitionBy("dataset").orderBy("light_id")
    rows = images.where(~F.col("skip")).withColumn("slot", F.row_number().over(w) - 1).drop("light_id")
    rows = rows.join(lights, (rows["dataset"] == lights["dataset"]) & (rows["slot"] == lights["light_id"])).drop(lights["dataset"])
    rows = rows.where("visible").drop("light_id")
    return rows.withColumn("light_id", (F.row_number().over(Window.partitionBy("dataset").orderBy("slot")) - 1).cast("int")).drop("slot")


def check_counts(images: DataFrame, lights: DataFrame) -> DataFrame:
    """(dataset, n_images, n_lights, ok) for every dataset of either side."""
    a = images.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_images"))
    b = lights.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_lights"))
    zero = F.lit(0).cast("long")
    both = a.join(b, "dataset", "full_outer").select("dataset", F.coalesce("n_images", zero).alias("n_images"), F.coalesce("n_lights", zero).alias("n_lights"))
    return both.withColumn("ok", F.col("n_images") == F.col("n_lights"))


def drop_light(samples: DataFrame, k: int) -> DataFrame:
    """All samples but those of light ``k``."""
    return samples.where(F.col("light_id") != k)


def crop(df: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """The pixels of a rectangle, counted from its corner; its right and bottom edges are outside."""
    if left < 0 or top < 0 or width <= 0 or height <= 0:
        raise ValueError("the crop must have a corner in the image and a positive size")
    inside = (F.col("x") >= left) & (F.col("x") < left + width) & (F.col("y") >= top) & (F.col("y") < top + height)
    return df.where(inside).withColumns({"x": (F.col("x") - left).cast("int"), "y": (F.col("y") - top).cast("int")})


def apply_offsets(samples: DataFrame, offsets: DataFrame, width: int, height: int) -> DataFrame:
    """Samples read at (x + ox, y + oy) of their image, on the rectangle that all images share, from its corner."""
    edge = offsets.groupBy("dataset").agg(F.max(-F.col("ox")).alias("_l"), F.min(width - F.col("ox")).alias("_r"), F.max(-F.col("oy")).alias("_t"), F.min(height - F.col("oy")).alias("_b"))
    zero = F.lit(0)
    edge = edge.select("dataset", F.greatest(zero, "_l").alias("_l"), F.least(F.lit(width), "_r").alias("_r"), F.greatest(zero, "_t").alias("_t"), F.least(F.lit(height), "_b").alias("_b"))
    rows = samples.join(F.broadcast(offsets), ["dataset", "light_id"]).join(F.broadcast(edge), "dataset")
    rows = rows.withColumns({"x": F.col("x") - F.col("ox"), "y": F.col("y") - F.col("oy")})
    rows = rows.where((F.col("x") >= F.col("_l")) & (F.col("x") < F.col("_r")) & (F.col("y") >= F.col("_t")) & (F.col("y") < F.col("_b")))
    return rows.withColumns({"x": (F.col("x") - F.col("_l")).cast("int"), "y": (F.col("y") - F.col("_t")).cast("int")}).drop("ox", "oy", "_l", "_r", "_t", "_b")


@dataclass(frozen=True)
class Crop:
    """A rectangle in the bounding box of the image turned by ``angle`` degrees."""

    left: int
    top: int
    width: int
    height: int
    angle: float = 0.0

    def _turned(self, width: int, height: int) -> tuple[float, float, float, float]:
        a = math.radians(self.angle)
        c, s = math.cos(a), math.sin(a)
        return c, s, abs(c) * width + abs(s) * height, abs(s) * width + abs(c) * height


def img_to_crop(x: Column, y: Column, crop: Crop, width: int, height: int) -> tuple[Column, Column]:
    """Image to crop coordinates: about the image centre, turned, in the turned bounding box, from the crop's corner."""
    c, s, bw, bh = crop._turned(width, height)
    dx, dy = x - width / 2.0, y - height / 2.0
    return c * dx - s * dy + bw / 2 - crop.left, s * dx + c * dy + bh / 2 - crop.top


def crop_to_img(x: Column, y: Column, crop: Crop, width: int, height: int) -> tuple[Column, Column]:
    """Crop to image coordinates."""
    c, s, bw, bh = crop._turned(width, height)
    dx, dy = x + crop.left - bw / 2, y + crop.top - bh / 2
    return c * dx + s * dy + width / 2.0, -s * dx + c * dy + height / 2.0


def crop_bounding_rect(crop: Crop, width: int, height: int) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of the source pixels that a turned crop reads, inside the image."""
    c, s, bw, bh = crop._turned(width, height)
    xs, ys = [], []
    for px, py in ((0, 0), (crop.width, 0), (0, crop.height), (crop.width, crop.height)):
        dx, dy = px + crop.left - bw / 2, py + crop.top - bh / 2
        xs.append(c * dx + s * dy + width / 2)
        ys.append(-s * dx + c * dy + height / 2)
    return max(0, math.floor(min(xs))), max(0, math.floor(min(ys))), min(width, math.ceil(max(xs))), min(height, math.ceil(max(ys)))


def rotate_crop(normals: DataFrame, crop: Crop, width: int, height: int, values: tuple[str, ...] = ("nx", "ny", "nz"), *, size: int = SIZE) -> DataFrame:
    """A vector grid resampled on a turned crop.

    Blocks of the source and of the crop meet by their bounding boxes: a block of the source goes, packed, to the
    blocks of the crop whose box it touches, with what lies in that box. The boxes are two numbers a block and an axis.
    """
    names, types = list(values), {f.name: f.dataType.simpleString() for f in normals.schema}
    across, down = -(-crop.width // size), -(-crop.height // size)
    corners = [[crop_to_img(float(x), float(y), crop, width, height) for x in (c * size, min((c + 1) * size, crop.width) - 1) for y in (r * size, min((r + 1) * size, crop.height) - 1)] for r in range(down) for c in range(across)]
    box = np.array(corners).reshape(-1, 4, 2)
    ends = np.array([width - 1, height - 1])
    low, high = np.clip(np.floor(box.min(axis=1)), 0, ends), np.clip(np.floor(box.max(axis=1)) + 1, 0, ends)

    def deal(block: Block) -> dict[str, object] | None:
        x0, y0 = block.x0, block.y0
        hit = np.flatnonzero((low[:, 0] < x0 + block.w) & (high[:, 0] >= x0) & (low[:, 1] < y0 + block.h) & (high[:, 1] >= y0)).astype(np.int32)
        if not len(hit):
            return None
        parts = []
        for to in hit:
            a, b = np.maximum(low[to].astype(int) - (x0, y0), 0), np.minimum(high[to].astype(int) - (x0, y0), (block.w - 1, block.h - 1)) + 1
            inside = np.zeros_like(block.known)
            inside[a[1] : b[1], a[0] : b[0]] = True
            parts.append(np.flatnonzero((inside & block.known).ravel()).astype(np.int32))
        same = lambda v: np.full(len(hit), v, np.int32)
        return {"to": hit, "x0": same(x0), "y0": same(y0), "w": same(block.w), "at": parts, **{v: [block.values[v].ravel()[p] for p in parts] for v in names}}

    schema = "to int, x0 int, y0 int, w int, at array<int>, " + ", ".join(f"`{v}` array<double>" for v in names)
    (left, top), (right, bottom) = low.min(axis=0).astype(int).tolist(), high.max(axis=0).astype(int).tolist()
    read = normals.where(F.col("x").between(left, right) & F.col("y").between(top, bottom))
    sent = blockwise(read.select("dataset", "x", "y", *(F.col(v).cast("double").alias(v) for v in names)), names, Axis.near(width, size, 0), Axis.near(height, size, 0), deal, schema)

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        to = key[-1].as_py()
        left, top = low[to].astype(int)
        w, h = high[to].astype(int) - low[to].astype(int) + 1
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
        n = table.column("at").combine_chunks().value_lengths().to_numpy()
        at, wide, x0, y0 = flat("at").astype(np.int64), *(np.repeat(table.column(c).to_numpy(), n).astype(np.int64) for c in ("w", "x0", "y0"))
        x, y = x0 + at % wide - left, y0 + at // wide - top
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        known, arrays = np.zeros((h, w), bool), {v: np.zeros((h, w)) for v in names}
        known[y[inside], x[inside]] = True
        for v in names:
            arrays[v][y[inside], x[inside]] = flat(v)[inside]
        bx, by = to % across * size, to // across * size
        block = Block({}, to % across, to // across, bx, by, min(size, crop.width - bx), min(size, crop.height - by), (int(left), int(top)), arrays, known)
        gy, gx = np.mgrid[by : by + block.h, bx : bx + block.w]
        got, hit = bilinear(block, *crop_to_img(gx.astype(float), gy.astype(float), crop, width, height), width, height, names)
        columns = block.pixels(got, hit)
        return pa.table({"dataset": pa.repeat(key[0], int(hit.sum())), **columns})

    out = f"dataset {types['dataset']}, x int, y int, " + ", ".join(f"`{v}` double" for v in names)
    return sent.groupBy("dataset", "to").applyInArrow(draw, out)


def rotate_lights(lights: DataFrame, degrees: float) -> DataFrame:
    """Directions turned by -degrees about the viewing axis."""
    a = math.radians(-degrees)
    c, s = math.cos(a), math.sin(a)
    return lights.withColumns({"lx": c * F.col("lx") - s * F.col("ly"), "ly": s * F.col("lx") + c * F.col("ly")})


def quarter_turn_lights(lights: DataFrame, degrees: int) -> DataFrame:
    x, y = F.col("lx"), F.col("ly")
    to = {90: (-y, x), 180: (-x, -y), 270: (y, -x)}[degrees]
    return lights.withColumns({"lx": to[0], "ly": to[1]})


def rotate_raster(df: DataFrame, width: int, height: int, clockwise: bool = True) -> DataFrame:
    """A grid turned by a quarter."""
    x, y = F.col("x"), F.col("y")
    to = (height - 1 - y, x) if clockwise else (y, width - 1 - x)
    return df.withColumns({"x": to[0].cast("int"), "y": to[1].cast("int")})


def correct_vignetting(samples: DataFrame, *, width: int, height: int, focal: float, pixel: float) -> DataFrame:
    """Divide by the fourth power of the cosine of the view angle; without a focal length nothing changes."""
    if not focal:
        return samples
    dx, dy = (F.col("x") - (width - 1) / 2) * pixel, (F.col("y") - (height - 1) / 2) * pixel
    gain = 1 / F.pow(F.cos(F.atan2(F.sqrt(dx * dx + dy * dy), F.lit(float(focal)))), F.lit(4.0))
    return samples.withColumns({c: F.col(c) * gain for c in ("r", "g", "b")})


def relative_light(samples: DataFrame, lights: DataFrame, *, width: int, height: int, pixel: float, angle: float = 0.0) -> DataFrame:
    """Samples with the vector from their pixel to their light's position (rx, ry, rz), turned by -angle."""
    rows = samples.join(F.broadcast(lights.select("dataset", "light_id", "px", "py", "pz")), ["dataset", "light_id"])
    x = F.col("px") - pixel * (F.col("x") - width / 2)
    y = F.col("py") - pixel * (height - 1 - F.col("y") - height / 2)
    a = math.radians(-angle)
    c, s = math.cos(a), math.sin(a)
    return rows.withColumns({"rx": c * x - s * y, "ry": s * x + c * y, "rz": F.col("pz")}).drop("px", "py", "pz")


def mean_light_distance(lights: DataFrame) -> DataFrame:
    """(dataset, d2): the mean squared distance of the lights."""
    return lights.groupBy("dataset").agg(F.avg(F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz")).alias("d2"))


def correct_falloff(samples: DataFrame, lights: DataFrame, **geometry) -> DataFrame:
    """Multiply by the squared distance to the light over the mean squared distance."""
    rows = relative_light(samples, lights, **geometry).join(F.broadcast(mean_light_distance(lights)), "dataset")
    gain = (F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("rz") * F.col("rz")) / F.col("d2")
    return rows.withColumns({c: F.col(c) * gain for c in ("r", "g", "b")}).drop("rx", "ry", "rz", "d2")


DIAGONAL = 43.27  # fixed value: the diagonal of a 35mm frame, mm


def normalize_focal(images: DataFrame) -> DataFrame:
    """35mm-equivalent focal length and virtual pixel size from columns as cameras record them.

    Needs focal, focal35, plane_res_x, plane_res_y, plane_unit (3: cm, else inch), width, height, orig_width, orig_height.
    """
    unit = F.when(F.col("plane_unit") == 3, 10.0).otherwise(25.4)
    w, h = F.coalesce("orig_width", "width").cast("double"), F.coalesce("orig_height", "height").cast("double")
    sw, sh = F.try_divide(w, F.col("plane_res_x")) * unit, F.try_divide(h, F.col("plane_res_y")) * unit
    factor = F.try_divide(F.lit(DIAGONAL), F.sqrt(sw * sw + sh * sh))
    focal = F.coalesce(F.col("focal35"), F.col("focal") * factor, F.col("focal"))
    now = F.sqrt(F.col("width").cast("double") * F.col("width") + F.col("height").cast("double") * F.col("height"))
    return images.withColumns({"focal_eq": focal, "virtual_pixel": F.lit(DIAGONAL) / now})


def view_direction(df: DataFrame, *, width: int, height: int, focal_px: float) -> DataFrame:
    """The unit vector from each pixel's ray to the camera at (0, 0, focal_px), y up; orthographic without a focal length."""
    if not focal_px:
        return df.withColumns({"vx": F.lit(0.0), "vy": F.lit(0.0), "vz": F.lit(-1.0)})
    x, y = F.col("x") - (width - 1) / 2, (height - 1) / 2 - F.col("y")
    n = F.sqrt(x * x + y * y + focal_px * focal_px)
    return df.withColumns({"vx": x / n, "vy": y / n, "vz": -focal_px / n})


def rotate_normal(df: DataFrame) -> DataFrame:
    """Normals turned by the rotation that takes the view direction to (0, 0, -1); a short axis leaves them."""
    vx, vy, vz = F.col("vx"), F.col("vy"), F.col("vz")
    nx, ny, nz = F.col("nx"), F.col("ny"), F.col("nz")
    ax, ay = -vy, vx  # v x (0, 0, -1)
    s = F.sqrt(ax * ax + ay * ay)
    ux, uy, c = F.try_divide(ax, s), F.try_divide(ay, s), -vz
    dot = ux * nx + uy * ny
    turned = (nx * c + uy * nz * s + ux * dot * (1 - c), ny * c - ux * nz * s + uy * dot * (1 - c), nz * c + (ux * ny - uy * nx) * s)
    return df.withColumns({k: F.when(s < 1e-5, o).otherwise(t) for k, o, t in zip(("nx", "ny", "nz"), (nx, ny, nz), turned, strict=True)})


def convert_color(samples: DataFrame, source: str | colors.Profile, target: str | colors.Profile) -> DataFrame:
    """Samples in another colour space, by name or by a matrix and curve profile."""
    r, g, b = colors.convert(F.col("r"), F.col("g"), F.col("b"), source, target)
    return samples.withColumns({"r": r, "g": g, "b": b})


def check_profiles(images: DataFrame, profile: str = "profile") -> DataFrame:
    """(dataset, n_profiles, ok): whether all images of a dataset share one colour profile, null counting as one."""
    n = F.count_distinct(F.coalesce(F.col(profile), F.lit("")))
    return images.groupBy("dataset").agg(n.alias("n_profiles"), (n == 1).alias("ok"))


def apply_mask(normals: DataFrame, mask: DataFrame) -> DataFrame:
    """Normals outside the mask, or where it has no row, become (0, 0, 0)."""
    on = F.coalesce(F.col("mask") != 0, F.lit(False))
    rows = normals.join(mask.select("dataset", "x", "y", "mask"), ["dataset", "x", "y"], "left")
    return rows.withColumns({c: F.when(on, F.col(c)).otherwise(0.0) for c in ("nx", "ny", "nz")}).drop("mask")
