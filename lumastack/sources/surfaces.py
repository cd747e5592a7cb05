"""Height maps and meshes as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def height_summary(heights: DataFrame) -> DataFrame:
    return heights.groupBy("dataset").agg(F.min("z").alias("zmin"), F.max("z").alias("zmax"), (F.max("z") - F.min("z")).alias("zrange"))


def heightmap(heights: DataFrame, normalize: bool = False) -> DataFrame:
    """Heights, or with ``normalize`` (z - min) / (max - min), 0 for a flat field."""
    if not normalize:
        return heights.select("dataset", "x", "y", "z")
    rows = heights.join(F.broadcast(height_summary(heights)), "dataset")
    return rows.select("dataset", "x", "y", F.coalesce(F.try_divide(F.col("z") - F.col("zmin"), F.nullif("zrange", F.lit(0.0))), F.lit(0.0)).alias("z"))


def invert_z(heights: DataFrame) -> DataFrame:
    rows = heights.join(F.broadcast(height_summary(heights)), "dataset")
    return rows.select("dataset", "x", "y", (F.col("zmax") - (F.col("z") - F.col("zmin"))).alias("z"))


def height_tiles(heights: DataFrame, side: int = 256) -> DataFrame:
    """(dataset, col, row, n, payload): square tiles of 4-byte floats, zero where there is no pixel."""

    @F.arrow_udf("binary")
    def pack(px: pa.Array) -> pa.Array:
        flat, cuts = px.flatten(), np.cumsum(np.concatenate(([0], px.value_lengths().to_numpy()))).tolist()
        at, z = flat.field("at").to_numpy(), flat.field("z").to_numpy()
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            tile = np.zeros(side * side, "<f4")
            tile[at[a:b]] = z[a:b]
            out.append(tile.tobytes())
        return pa.array(out, pa.binary())

    rows = heights.groupBy("dataset", F.floor(F.col("x") / side).cast("int").alias("col"), F.floor(F.col("y") / side).cast("int").alias("row"))
    place = (F.pmod("y", F.lit(side)) * side + F.pmod("x", F.lit(side))).alias("at")
    return rows.agg(F.collect_list(F.struct(place, "z")).alias("px")).select("dataset", "col", "row", F.size("px").alias("n"), pack("px").alias("payload"))


def tile_heights(tiles: DataFrame, width: int, height: int, side: int = 256) -> DataFrame:
    """(dataset, x, y, z) of the tiles of ``height_tiles``: all pixels of the grid that a tile covers, those that it lacked as 0."""
    kind = tiles.schema["dataset"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                z = np.frombuffer(batch.column("payload")[i].as_buffer(), "<f4")
                col, row = (batch.column(c)[i].as_py() for c in ("col", "row"))
                at = np.arange(side * side)
                at = at[(col * side + at % side < width) & (row * side + at // side < height)]
                x, y = (col * side + at % side).astype(np.int32), (row * side + at // side).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("dataset").slice(i, 1).take(pa.array(np.zeros(len(at), np.int64))), pa.array(x), pa.array(y), pa.array(z[at].astype(float))], ["dataset", "x", "y", "z"])

    return tiles.select("dataset", "col", "row", "payload").mapInArrow(task, f"dataset {kind}, x int, y int, z double")


def mesh(heights: DataFrame, width: int, height: int, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a height grid: centred, y up, z away, with texture coordinates; two triangles a cell."""
    p = (F.col("y") * width + F.col("x")).cast("long")
    at = {"vx": F.col("x") - (width - 1) / 2, "vy": (height - 1 - F.col("y")) - (height - 1) / 2, "vz": -F.col("z")}
    vertices = heights.select("dataset", p.alias("vertex"), *((v * scale).alias(k) for k, v in at.items()), (F.col("x") / (width - 1)).alias("s"), ((height - 1 - F.col("y")) / (height - 1)).alias("t"))
    cell = heights.where((F.col("x") < width - 1) & (F.col("y") < height - 1)).select("dataset", p.alias("p"))
    tri = lambda *k: F.struct(*((F.col("p") + v).alias(n) for v, n in zip(k, "abc", strict=True)))
    faces = cell.select("dataset", F.explode(F.array(tri(0, width, width + 1), tri(0, width + 1, 1))).alias("f")).select("dataset", "f.*")
    return vertices, faces
