"""Legacy reflectance files whose planes are JPEG images predicted from one another.

Behind the header of a polynomial file stand a quality, and for each of its 9 (LRGB) or 18 (RGB) planes: a transform and a
motion in x and y (all 0), a rank of decoding, the plane it is predicted from (-1: none), the bytes of its JPEG image and
the bytes of its corrections; then image and corrections of each plane. A plane is its image, or its image - 128 + the plane
it is predicted from, modulo 256; a correction is a place (4 bytes, big end first) and the value there.

Spark's image source decodes the images; planes are then cut into bands of rows, and a band of all planes is a group, in
which planes are put together by rank. So no group holds more than ``BAND`` pixels of each plane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import removed, shared_dir, stored
from .images import FILE_TERMS, _numbers

BAND = 1 << 18
FORMATS = {"PTM_FORMAT_JPEG_LRGB": ("lrgb", 9), "PTM_FORMAT_JPEG_RGB": ("rgb", 18)}
HEADER = "type string, colorspace string, width int, height int, scale array<double>, bias array<double>"
_PLANES = "dataset string, plane int, rank int, base int, image binary, corrections binary"


def parse_compressed(data: bytes) -> tuple[dict, list[tuple[int, int, int, bytes, bytes]]]:
    """(header, planes): a plane is (number, rank, base or -1, image, corrections). Raises ValueError on what it can't read."""
    at = data.index(b"\n") + 1
    end = data.index(b"\n", at)
    kind, at = data[at:end].decode("latin-1").strip(), end + 1
    if not data.startswith(b"PTM_") or kind not in FORMATS:
        raise ValueError("not a compressed polynomial file")
    space, n = FORMATS[kind]
    (w, h), at = _numbers(data, at, 2)
    numbers, at = _numbers(data, at, 12)
    _, at = _numbers(data, at, 1)
    lists = []
    for _ in range(7):
        values, at = _numbers(data, at, n)
        lists.append([int(v) for v in values])
    transform, motion_x, motion_y, rank, base, images, corrections = lists
    if any(transform) or any(motion_x) or any(motion_y):
        raise ValueError("transforms and motions are not known")
    if sorted(rank) != list(range(n)) or any(not -1 <= b < n or (b >= 0 and rank[b] >= rank[i]) for i, b in enumerate(base)):
        raise ValueError("planes are predicted in no order")
    if at + sum(images) + sum(corrections) > len(data) or any(c % 5 for c in corrections):
        raise ValueError("the file is cut off")
    planes = []
    for i in range(n):
        middle = at + images[i]
        planes.append((i, rank[i], base[i], data[at:middle], data[middle : middle + corrections[i]]))
        at = middle + corrections[i]
    scale, bias = ([v[t] for t in FILE_TERMS] for v in (numbers[:6], [b / 255 for b in numbers[6:]]))
    return {"type": "ptm", "colorspace": space, "width": int(w), "height": int(h), "scale": scale, "bias": bias}, planes


def _columns(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [parse_compressed(c.as_py())[0] for c in batch.column("content")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column("dataset"), *(pa.array([r[c] for r in rows], k) for c, k in zip(_columns(HEADER), kinds, strict=True))], ["dataset", *_columns(HEADER)])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    for batch in batches:
        for name, content in zip(batch.column("dataset").to_pylist(), batch.column("content"), strict=True):
            rows = [(name, *p) for p in parse_compressed(content.as_py())[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _columns(_PLANES))


_BANDS = "dataset string, band int, plane int, rank int, base int, width int, height int, first int, px binary, corrections binary"


def _banded(rows: int | None) -> object:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                w, h = r["width"], r["height"]
                px = np.frombuffer(r["data"], np.uint8).reshape(h, w, -1)[..., 0]  # a gray image, or equal channels
                fixes = np.frombuffer(r["corrections"], np.uint8).reshape(-1, 5)
                place = fixes[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
                step = rows or max(1, BAND // w)
                for band, first in enumerate(range(0, h, step)):
                    part = px[first : first + step]
                    here = (place >= first * w) & (place < first * w + part.size)
                    values = [r["dataset"], band, r["plane"], r["rank"], r["base"], w, h, first, part.tobytes(), fixes[here].tobytes()]
                    kinds = [pa.string(), *[pa.int32()] * 7, pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], _columns(_BANDS))

    return task


def _together(key: tuple, table: pa.Table) -> pa.Table:
    """Pixels of a band, in the library's order of terms; rows of a file run upwards."""
    rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
    w, h, first = rows[0]["width"], rows[0]["height"], rows[0]["first"]
    planes: dict[int, np.ndarray] = {}
    for r in rows:
        v = np.frombuffer(r["px"], np.uint8).astype(np.int64)
        if r["base"] >= 0:
            v = v - 128 + planes[r["base"]]
        v %= 256
        fixes = np.frombuffer(r["corrections"], np.uint8).reshape(-1, 5).astype(np.int64)
        v[fixes[:, :4] @ np.array([1 << 24, 1 << 16, 1 << 8, 1]) - first * w] = fixes[:, 4]
        planes[r["plane"]] = v
    order = [6, 7, 8, *FILE_TERMS] if len(planes) == 9 else [6 * c + t for t in FILE_TERMS for c in range(3)]
    q = np.stack([planes[p] for p in order], axis=1).astype(np.int32)
    y, x = np.divmod(np.arange(len(q)), w)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * len(order), pa.int32()), pa.array(q.ravel()))
    return pa.table({"dataset": pa.repeat(key[0], len(q)), "x": pa.array(x.astype(np.int32)), "y": pa.array((h - 1 - first - y).astype(np.int32)), "q": lists})


def compressed_tables(files: DataFrame, *, band_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (dataset, content) of compressed files to (headers, coefficients), as ``images.legacy_tables`` gives them."""
    spark, path, shelf = files.sparkSession, shared_dir(files.sparkSession), shared_dir(files.sparkSession)
    rows = files.select("dataset", "content")
    planes = stored(rows.mapInArrow(_split, _PLANES).withColumn("key", F.xxhash64("dataset", "plane")), path)
    # the committing text writer puts an image down as it is; decoders ignore the line end behind it
    planes.select("key", F.col("image").cast("string").alias("value")).repartition("key").write.mode("overwrite").partitionBy("key").text(shelf)
    decoded = spark.read.format("image").load(f"{shelf}/*").select(F.regexp_extract("image.origin", r"/key=(-?\d+)/", 1).cast("long").alias("key"), "image.width", "image.height", "image.data")
    joined = decoded.join(planes.drop("image"), "key").select("dataset", "plane", "rank", "base", "width", "height", "data", "corrections")
    bands = joined.mapInArrow(_banded(band_rows), _BANDS)
    out = stored(bands.groupBy("dataset", "band").applyInArrow(_together, "dataset string, x int, y int, q array<int>"))
    removed(spark, path, shelf)
    return rows.mapInArrow(_headers, f"dataset string, {HEADER}"), out


def read_compressed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.format("binaryFile").load(path)
    return compressed_tables(files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("dataset"), "content"))
