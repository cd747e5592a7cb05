"""Image stacks, coefficient planes and legacy reflectance files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.algebra import stacked

CHANNELS = ("r", "g", "b")
#: Pixels of a legacy file in a group.
BAND = 1 << 16


def decoded_stack(images: DataFrame) -> DataFrame:
    """Rows (dataset, light_id, width, height, channels, data) of decoded BGR, gray or BGRA bytes to samples, row by row."""

    def task(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                px = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                rgb = px[..., [0, 0, 0]] if row.channels == 1 else px[..., [2, 1, 0]]
                step = max(1, 1_000_000 // max(row.width, 1))
                for top in range(0, row.height, step):
                    part = rgb[top : top + step].astype(float)
                    y, x = np.mgrid[top : top + len(part), : row.width]
                    yield pd.DataFrame({"dataset": row.dataset, "light_id": row.light_id, "x": x.ravel(), "y": y.ravel(), "r": part[..., 0].ravel(), "g": part[..., 1].ravel(), "b": part[..., 2].ravel()})

    schema = "dataset string, light_id int, x int, y int, r double, g double, b double"
    return images.select("dataset", "light_id", "width", "height", "channels", "data").mapInPandas(task, schema)


def write_bitmaps(images: DataFrame, path: str) -> None:
    """Rows (name, width, height, data) of BGR bytes, row by row, as uncompressed bitmap files, one in a folder for each name."""

    @F.pandas_udf("binary")
    def coded(width: pd.Series, height: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for w, h, px in zip(width, height, data, strict=True):
            rows = np.zeros((h, -(-3 * w // 4) * 4), np.uint8)  # rows run upwards and end on four bytes
            rows[:, : 3 * w] = np.frombuffer(px, np.uint8).reshape(h, 3 * w)[::-1]
            out.append(struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes())
        return pd.Series(out)

    # the committing text writer puts the bytes down as they are; readers ignore the line end behind them
    images.select("name", coded("width", "height", "data").cast("string").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def read_stack(spark: SparkSession, folder: str, dataset: str, lights: DataFrame | None = None) -> DataFrame:
    """Samples of the images of a folder (JPEG, PNG, BMP, GIF), sorted by name and numbered; with ``lights``, directions joined.

    The at-scale form is Parquet samples; this source is for captures as they come from the camera.
    """
    rows = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.*")
    w = Window.orderBy("origin")  # a capture has at most a thousand images, and their bytes are not in this sort
    order = rows.select("origin", (F.row_number().over(w) - 1).cast("int").alias("light_id"))
    images = rows.join(F.broadcast(order), "origin").select(F.lit(dataset).alias("dataset"), "light_id", "width", "height", F.col("nChannels").alias("channels"), "data")
    samples = decoded_stack(images)
    if lights is None:
        return samples
    from ..operators.stack import attach_lights

    return attach_lights(samples, lights)


def plane_images(coded: DataFrame) -> DataFrame:
    """(dataset, plane_image, x, y, r, g, b): plane image j holds planes 3j to 3j + 2; a missing plane is 0."""
    n = F.ceil(F.size("q") / 3).cast("int")
    rows = coded.select("dataset", "x", "y", "q", F.explode(F.sequence(F.lit(0), n - 1)).alias("plane_image"))
    return rows.select("dataset", "plane_image", "x", "y", *(F.coalesce(F.get("q", 3 * F.col("plane_image") + i), F.lit(0)).alias(c) for i, c in enumerate(CHANNELS)))


def write_planes(coded: DataFrame, path: str) -> None:
    """Plane images as Parquet, a folder for each dataset and image."""
    plane_images(coded).write.mode("overwrite").partitionBy("dataset", "plane_image").parquet(path)


def planes_to_coefficients(planes: DataFrame, nplanes: int) -> DataFrame:
    """(dataset, x, y, q) of plane images."""
    rows = planes.groupBy("dataset", "x", "y").agg(F.sort_array(F.collect_list(F.struct("plane_image", F.array(*CHANNELS).alias("v")))).alias("s"))
    return rows.select("dataset", "x", "y", F.slice(F.flatten(F.transform("s", lambda e: e["v"])), F.lit(1), F.lit(nplanes)).alias("q"))


def read_planes(spark: SparkSession, path: str, nplanes: int) -> DataFrame:
    return planes_to_coefficients(spark.read.parquet(path), nplanes)


# Fixed value: the order of a polynomial file's six terms inside a dataset's planes.
FILE_TERMS = [5, 3, 4, 0, 2, 1]


def _numbers(data: bytes, at: int, count: int) -> tuple[list[float], int]:
    out: list[float] = []
    while len(out) < count:
        end = data.index(b"\n", at)
        out += [float(v) for v in data[at:end].split()]
        at = end + 1
    return out, at


def _layout(data: bytes) -> tuple[dict, list[int], list[int]]:
    """(header, places, widths) of a PTM (RGB or LRGB, not compressed) or an HSH file.

    A file is one or more sections behind its header, which start at ``places`` and hold so many bytes a pixel (``widths``).
    """
    if data.startswith(b"#HSH") or (not data.startswith(b"PTM_") and b"\n3\n" in data[:40]):
        at = data.index(b"\n") + 1
        _, at = _numbers(data, at, 1)
        (w, h, _), at = _numbers(data, at, 3)
        (terms, _, _), at = _numbers(data, at, 3)
        terms = int(terms)
        f = np.frombuffer(data, "<f4", 2 * terms, at).astype(float)
        scale, bias = f[:terms], -f[terms:] / f[:terms]
        head = {"type": "hsh", "colorspace": "rgb", "width": int(w), "height": int(h), "scale": scale.tolist(), "bias": bias.tolist()}
        return head, [at + 8 * terms], [3 * terms]
    at = data.index(b"\n")
    version, at = data[:at].decode().strip(), at + 1
    end = data.index(b"\n", at)
    kind, at = data[at:end].decode().strip(), end + 1
    (w, h), at = _numbers(data, at, 2)
    (*scale, b0, b1, b2, b3, b4, b5), at = _numbers(data, at, 12)
    bias = [b / 255 for b in (b0, b1, b2, b3, b4, b5)]
    scale, bias = [scale[t] for t in FILE_TERMS], [bias[t] for t in FILE_TERMS]
    head = {"type": "ptm", "colorspace": "rgb" if kind == "PTM_FORMAT_RGB" else "lrgb", "width": int(w), "height": int(h), "scale": scale, "bias": bias}
    n = head["width"] * head["height"]
    if kind == "PTM_FORMAT_RGB":
        return head, [at, at + 6 * n, at + 12 * n], [6, 6, 6]
    return head, *(([at, at + 6 * n], [6, 3]) if version.endswith("1.2") else ([at], [9]))


def _in_order(kind: str, sections: list[np.ndarray]) -> np.ndarray:
    """Pixels x planes in internal order, of the bytes of the same pixels in each section."""
    if kind == "hsh":
        n = len(sections[0])
        return sections[0].reshape(n, 3, -1).transpose(0, 2, 1).reshape(n, -1)
    if len(sections) == 3:
        return np.stack([s[:, FILE_TERMS] for s in sections], axis=2).reshape(-1, 18)
    both = np.concatenate(sections, axis=1)
    return np.concatenate([both[:, 6:], both[:, FILE_TERMS]], axis=1)


def parse_legacy(name: str, data: bytes) -> tuple[dict, np.ndarray]:
    """(header, bytes as height x width x planes) of a PTM (RGB or LRGB, not compressed) or an HSH file.

    Terms are in internal order with r, g, b in each; LRGB has r, g, b and then six luma terms. Scales and biases are a term's.
    """
    head, places, widths = _layout(data)
    w, h = head["width"], head["height"]
    q = _in_order(head["type"], [np.frombuffer(data, np.uint8, w * h * k, at).reshape(-1, k) for at, k in zip(places, widths, strict=True)])
    return head, q.reshape(h, w, -1)[::-1]


_HEAD = "dataset string, type string, colorspace string, width int, height int, scale array<double>, bias array<double>"


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_layout(c.as_py()) for c in batch.column("content")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        names = ["type", "colorspace", "width", "height", "scale", "bias"]
        out = [batch.column("dataset"), *(pa.array([r[0][c] for r in rows], k) for c, k in zip(names, kinds, strict=True))]
        out += [pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays(out, ["dataset", *names, "places", "widths"])


def legacy_piece_tables(pieces: DataFrame, *, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """Rows (dataset, at, content), each a file's bytes from ``at`` on, to (headers, coefficients) as ``legacy_tables``.

    The piece at 0 holds the whole header; others may be cut anywhere. Pieces are dealt out by bands of about ``band`` pixels,
    so a group is a band of a file, of whatever size the file is. Bytes that no piece holds are 0.
    """
    rows = pieces.select("dataset", F.col("at").cast("long").alias("at"), "content")
    heads = rows.where("at = 0").mapInArrow(_headers, f"{_HEAD}, places array<long>, widths array<long>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dataset", "type", "width", "height", "band", "section", "sections", "first", "part"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                name, at, kind, w, h, places, widths = (batch.column(c)[i].as_py() for c in ("dataset", "at", "type", "width", "height", "places", "widths"))
                content = memoryview(batch.column("content")[i].as_buffer())
                step = max(1, band // max(w, 1))
                for section, (start, k) in enumerate(zip(places, widths, strict=True)):
                    size = step * w * k  # bytes of a band in this section
                    a, b = max(at, start), min(at + len(content), start + w * h * k)
                    for n in range((a - start) // size, -(-(b - start) // size)) if a < b else ():
                        x, y = max(a, start + n * size), min(b, start + (n + 1) * size)
                        values = [name, kind, w, h, n, section, widths, x - start - n * size, bytes(content[x - at : y - at])]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

    def together(key: tuple, table: pa.Table) -> pa.Table:
        name, kind, w, h, n = (v.as_py() for v in key)
        step = max(1, band // max(w, 1))
        first = n * step
        count = min(step, h - first) * w
        widths = table.column("sections")[0].as_py()
        sections = [np.zeros(count * k, np.uint8) for k in widths]
        for i in range(table.num_rows):
            at, part = table.column("first")[i].as_py(), table.column("part")[i].as_buffer()
            sections[table.column("section")[i].as_py()][at : at + part.size] = np.frombuffer(part, np.uint8)
        q = _in_order(kind, [s.reshape(count, k) for s, k in zip(sections, widths, strict=True)])
        y, x = np.divmod(np.arange(count), w)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * q.shape[1], pa.int32()), pa.array(q.ravel().astype(np.int32)))
        return pa.table({"dataset": pa.repeat(pa.scalar(name, pa.string()), count), "x": pa.array(x.astype(np.int32)), "y": pa.array((h - 1 - first - y).astype(np.int32)), "q": lists})

    joined = rows.join(F.broadcast(heads.select("dataset", "type", "width", "height", "places", "widths")), "dataset")
    parts = joined.mapInArrow(cut, "dataset string, type string, width int, height int, band int, section int, sections array<long>, first long, part binary")
    q = parts.groupBy("dataset", "type", "width", "height", "band").applyInArrow(together, "dataset string, x int, y int, q array<int>")
    return heads.drop("places", "widths"), q


def legacy_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (dataset, content) to (headers, coefficients): a header has type, colorspace, width, height, scale and bias of terms."""
    return legacy_piece_tables(files.select("dataset", F.lit(0).alias("at"), "content"))


def read_legacy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.format("binaryFile").load(path)
    return legacy_tables(files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("dataset"), "content"))


def legacy_pieces(coded: DataFrame, headers: DataFrame, fmt: str, *, band: int = BAND) -> DataFrame:
    """(dataset, at, content): the pieces of files of rgb datasets, ``fmt`` ptm (18 planes) or hsh, and where they start.

    Rows go bottom up; scale and bias of a term hold for r, g and b. The header is a piece, and so is each section of a band
    of about ``band`` pixels, so no row holds a whole file. Every header makes a file; pixels that are missing are 0.
    """
    order = [FILE_TERMS.index(i) for i in range(6)]

    @F.pandas_udf("binary")
    def head(w: pd.Series, h: pd.Series, scale: pd.Series, bias: pd.Series) -> pd.Series:
        out = []
        for a, b, s, o in zip(w, h, scale, bias, strict=True):
            s, o = list(s), list(o)
            if fmt == "ptm":
                text = f"PTM_1.2\nPTM_FORMAT_RGB\n{a}\n{b}\n" + " ".join(repr(float(s[t])) for t in order) + "\n" + " ".join(str(int(np.floor(255 * o[t] + 0.5))) for t in order) + "\n"
                out.append(text.encode())
            else:
                text = f"#HSH1.2\n3\n{a} {b} 3\n{len(s)} 2 1\n".encode()
                out.append(text + np.array(s, "<f4").tobytes() + np.array([-x * y for x, y in zip(o, s, strict=True)], "<f4").tobytes())
        return pd.Series(out)

    def body(key: tuple, table: pa.Table) -> pa.Table:
        name, w, h, terms, start, n = (v.as_py() for v in key)
        step = max(1, band // max(w, 1))
        first = n * step
        px = np.zeros((min(step, h - first), w, 3 * terms), np.uint8)
        known = table.filter(table.column("q").is_valid())
        if known.num_rows:
            x, y = (known.column(c).to_numpy() for c in ("x", "y"))
            if x.min() < 0 or x.max() >= w or y.min() < 0 or y.max() >= h:
                raise ValueError(f"{name} has pixels outside of its {w} x {h}")
            px[h - 1 - y - first, x] = stacked(known.column("q"))
        px = px.reshape(-1, terms, 3)
        if fmt == "ptm":
            parts = [(start + (c * h + first) * w * 6, px[:, order, c].tobytes()) for c in range(3)]
        else:
            parts = [(start + first * w * 3 * terms, px.transpose(0, 2, 1).tobytes())]
        return pa.table({"dataset": pa.array([name] * len(parts), pa.string()), "at": pa.array([a for a, _ in parts], pa.int64()), "content": pa.array([b for _, b in parts], pa.binary())})

    heads = headers.select("dataset", "width", "height", "scale", "bias").withColumn("content", head("width", "height", "scale", "bias"))
    sizes = heads.select("dataset", F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"), F.size("scale").alias("terms"), F.length("content").cast("long").alias("start"))
    step = F.greatest(F.lit(1), F.floor(F.lit(band) / F.greatest("w", F.lit(1)))).cast("int")
    last = F.floor((F.col("h") - 1) / step).cast("int")
    every = sizes.select("*", F.explode(F.sequence(F.lit(0), last)).alias("band"), *(F.lit(None).cast(t).alias(c) for c, t in (("x", "int"), ("y", "int"), ("q", "array<int>"))))
    of = F.least(F.greatest(F.floor((F.col("h") - 1 - F.col("y")) / step).cast("int"), F.lit(0)), last)
    rows = coded.select("dataset", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("q").cast("array<int>").alias("q"))
    rows = rows.join(F.broadcast(sizes), "dataset").withColumn("band", of).select(every.columns).union(every)
    pieces = rows.groupBy("dataset", "w", "h", "terms", "start", "band").applyInArrow(body, "dataset string, at long, content binary")
    return heads.select("dataset", F.lit(0).cast("long").alias("at"), "content").union(pieces)


def write_legacy(coded: DataFrame, headers: DataFrame, fmt: str) -> DataFrame:
    """(dataset, content): the files of ``legacy_pieces``, a row each; for files that a row can hold."""
    pieces = legacy_pieces(coded, headers, fmt)

    @F.pandas_udf("binary")
    def file(parts: pd.Series) -> pd.Series:
        return pd.Series([b"".join(e["content"] for e in p) for p in parts])

    return pieces.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("at", "content"))).alias("parts")).select("dataset", file("parts").alias("content"))
